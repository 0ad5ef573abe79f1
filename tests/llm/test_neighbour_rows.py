"""Neighbours among rows that repeat ids, with large norms, and where hashing does not reach the recall."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.llm import neighbours


def exact(rows, asked, k):
    """Neighbours of every asked row, each row a candidate but the asked one itself: sorted lists of ids and scores."""
    out = []
    for n in asked:
        q = np.array(rows[n][1])
        scored = [(-float((q * np.array(v)).sum()), i is None, i or 0) for m, (i, v) in enumerate(rows) if m != n]
        out.append((rows[n][0], [(None if none else i, -s) for s, none, i in sorted(scored)[:k]]))
    return sorted(out, key=str)


def found(frame, queries, **options):
    got = defaultdict(list)
    for r in neighbours.nearest(frame, queries, **options).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return got


def made(rng, n, scale=1.0):
    return [(i, [float(x) for x in scale * rng.standard_normal(12)]) for i in range(n)]


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(1)
    rows = made(rng, 80)
    rows[7] = (7, [3 * x for x in rows[7][1]])
    rows += [(7, rows[7][1]), (7, [-x for x in rows[7][1]]), (None, rows[7][1]), (None, rows[3][1]), (20, rows[21][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(frame, F.col("vec_id").isin(7, 20), k=84)
    want = exact(rows, [n for n, (i, _) in enumerate(rows) if i in (7, 20)], 84)
    for i in (7, 20):
        own = [t for j, w in want if j == i for t in enumerate(w, 1)]
        assert sorted(((r, v) for r, v, _ in got[i]), key=str) == sorted(((r, v) for r, (v, _) in own), key=str)
        assert np.allclose(sorted(s for *_, s in got[i]), sorted(s for _, (_, s) in own))
    assert (1, 7) in [(r, v) for r, v, _ in got[7]]  # the other row of that id and vector
    outside = found(frame, frame.where("vec_id = 20").limit(1), k=84)
    assert len(outside[20]) == 83 and all(v != 20 for _, v, _ in outside[20])


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e-9])
def test_ties_are_kept_at_any_norm(spark, scale):
    rng = np.random.default_rng(2)
    rows = made(rng, 60, scale)
    rows += [(100 + i, [2 * x for x in rows[5][1]]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = found(frame, F.col("vec_id") == 5, k=30)
    assert [v for _, v, _ in sorted(got[5])] == [100 + i for i in range(30)]


def test_bounds_from_elsewhere_lose_no_tie():
    """Scores that were added up in another order bound what a part returns."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    vector = 1e6 * rng.standard_normal(64)
    n = 101
    rows = pa.table({"row": range(n), "id": range(n), "bucket": [0] * n, "vector": [vector.tobytes()] * n})
    enough = float(sum(float(x) * float(x) for x in vector[::-1])) * (1 + 1e-15)
    asked = pa.table(
        {"query": [-1], "query_id": [500], "by_id": [True], "vector": [vector.tobytes()], "buckets": pa.array([[0]], pa.list_(pa.int64())), "enough": [enough]}
    )
    assert neighbours._nearest(64, 20)(asked, rows).column("vec_id").to_pylist() == list(range(20))


def test_everything_is_compared_where_probes_do_not_reach_the_recall(spark):
    rng = np.random.default_rng(4)
    rows = made(rng, 300)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [n for n in range(300) if n % 30 == 0]
    want = dict(exact(rows, asked, 10))
    # cells so small that neighbours are many steps away, beyond what single steps reach
    got = found(frame, F.col("vec_id") % 30 == 0, k=10, cell=0.01, tables=1, projections=4)
    assert {i: [v for _, v, _ in sorted(g)] for i, g in got.items()} == {i: [v for v, _ in w] for i, w in want.items()}
    # more probes than are tried at first
    plan = neighbours.Hashing(12, 10.0, tables=2, projections=6, cell=1.5, probes=2)
    stored = neighbours.usable_vectors(frame, "vec_id", "embedding").withColumn("row", F.col("id"))
    queries = stored.where("id % 30 = 0").select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.lit(False).alias("by_id"), "vector")
    needed = neighbours.probes_needed(stored, queries, plan, 10, 0.3, 64, 10**6)
    assert needed > 2 and plan.probes >= needed


def test_queries_that_find_too_few_are_compared_with_everything(spark):
    rng = np.random.default_rng(5)
    near = rng.standard_normal(12)
    rows = [(i, [float(x) for x in near + 0.01 * rng.standard_normal(12)]) for i in range(200)]
    rows += [(1000 + i, [float(x) for x in -9 * near + rng.standard_normal(12)]) for i in range(5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(frame, (F.col("vec_id") % 10 == 0) | (F.col("vec_id") == 1001), k=20, recall=0.5)
    assert all(len(g) == 20 for g in got.values()) and len(got) == 22
    assert [v for _, v, _ in sorted(got[1001])] == [v for v, _ in exact(rows, [201], 20)[0][1]]
