"""Product codes against k-means by all distances."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import connect, difference
from tillsight.llm import queries
from tillsight.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, codes string, row int"


def brute(rows, scale=1024, parts=4, entries=256, rounds=4, width=None):
    """``(ids, codes, errors, books)`` in the order of the kept rows."""
    kept = []
    for i, v, *_ in rows:
        if v and all(x is not None and np.isfinite(x) and abs(x) * scale < vc.LIMIT for x in v) and width in (None, len(v)):
            kept.append((i, [int(np.floor(scale * x)) for x in v]))
    width = len(kept[0][1])
    size = -(-width // parts)
    x = np.array([v + [0] * (size * parts - width) for _, v in kept], object).reshape(len(kept), parts, size)
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][1]))[:entries]
    books = [[list(x[n][p]) for n in first] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(books[p]))

    for r in range(rounds + 1):
        found = [[near(p, v[p]) for p in range(parts)] for v in x]
        if r == rounds:
            break
        for p in range(parts):
            for e in range(len(first)):
                own = [x[n][p] for n in range(len(kept)) if found[n][p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    return [i for i, _ in kept], [[e for _, e in f] for f in found], [sum(d for d, _ in f) for f in found], books


def same(spark, rows, **options):
    got, books = vc.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), **{k: v for k, v in options.items() if k != "width"})
    ids, codes, errors, want = brute(rows, **{k: v for k, v in options.items() if k != "length"})
    key = lambda t: (t[0] is None, t)
    assert sorted(((r["vec_id"], list(r["codes"]), r["error"]) for r in got.collect()), key=key) == sorted(zip(ids, codes, errors), key=key)
    assert books.entries.tolist() == want
    return got, books


def made(rng, n, width=8, spread=0.3):
    middles = rng.standard_normal((7, width))
    vectors = middles[rng.integers(0, 7, n)] + spread * rng.standard_normal((n, width))
    return [(int(i), [float(x) for x in v], int(i) % 3, "c", 1) for i, v in enumerate(vectors)]


@pytest.mark.parametrize(("entries", "length"), [(12, 4), (12, 12), (1, 4), (40, 2), (40, 1)])
def test_codes_are_those_of_all_distances(spark, entries, length):
    rows = made(np.random.default_rng(entries), 160)
    same(spark, rows, entries=entries, length=length, rounds=5)


def test_ties_repeated_rows_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in v], None if i % 5 == 0 else 1, "c", 1) for i, v in enumerate(rng.integers(-2, 3, (120, 8)) / 1024)]
    rows += [rows[4]] * 40 + [(3, rows[8][1], 1, "c", 1), (None, rows[9][1], 1, "c", 1), (None, None, 1, "c", 1)]
    rows += [(-1, [], 1, "c", 1), (-2, [1.0, None] * 4, 1, "c", 1), (-3, [float("nan")] * 8, 1, "c", 1), (-4, [float("inf")] * 8, 1, "c", 1)]
    rows += [(-5, [1.0] * 5, 1, "c", 1), (-6, [1e30] * 8, 1, "c", 1), (-7, [0.0] * 8, 1, "c", 1)]
    got, _ = same(spark, rows, entries=16, length=3, width=8)
    assert got.columns == ["vec_id", "label", "row", "codes", "error"]


def test_parts_that_cannot_be_equal_and_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in v], 1, "c", 1) for i, v in enumerate(rng.uniform(-16000, 16000, (70, 7)))]
    same(spark, rows, entries=9, length=3)


def test_tables_without_rows(spark):
    frame = spark.createDataFrame([(1, None, 1, "c", 1)], SCHEMA)
    for none in (frame, frame.limit(0)):
        got, books = vc.compress(none)
        assert got.collect() == [] and got.columns == ["vec_id", "label", "row", "codes", "error"]
        assert books.sha256() == hashlib.sha256(b"").hexdigest()


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(3)
    x = (1024 * (rng.standard_normal((20, 16))[rng.integers(0, 20, 4000)] + 0.3 * rng.standard_normal((4000, 16)))).astype(np.int64)
    book, near, taken, length = x[:64], None, [], 16
    for _ in range(6):
        near = vc.Nearest.first(x, book, length) if near is None else near.moved(x, book, moves, length)  # noqa: F821
        true = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (near.entries[:, 0] == true.argmin(axis=1)).all()
        roots = np.sqrt(true)
        own = np.take_along_axis(roots, near.entries.astype(int), 1)
        assert (near.bounds[:, 0] >= own[:, 0]).all() and (near.bounds[:, 1:-1] <= own[:, 1:]).all()
        np.put_along_axis(roots, near.entries.astype(int), np.inf, 1)
        assert (near.bounds[:, -1] <= roots.min(axis=1)).all()
        taken.append(near.distances)
        moved = np.array([x[near.entries[:, 0] == e].sum(axis=0) // max(1, (near.entries[:, 0] == e).sum()) for e in range(64)])
        moves, book, length = np.sqrt(((moved - book) ** 2).sum(axis=1)), moved, max(2, length - 3)
    assert taken[0] == 4000 * 64 and sum(taken[2:]) < 0.3 * 4 * taken[0]


def test_lists_are_shortened(spark):
    rows = made(np.random.default_rng(5), 600, spread=0.05)
    frame = spark.createDataFrame(rows, SCHEMA)
    state = vc.Nearest.first(np.zeros((3, 2), np.int64), np.arange(20).reshape(10, 2), 4)
    assert state.reach.tolist() == [10] * 3
    needs = spark.createDataFrame([([0, 10],)] * 97 + [([3, 10],)] * 3, "reach array<smallint>")
    assert vc._lengths(needs, [8, 8], 10) == [4, 8]
    assert vc._lengths(needs.limit(97), [8, 8], 10)[0] == vc.SHORTEST + 1
    got, books = vc.compress(frame, entries=32)
    rows = got.select("vec_id", "codes", "error").orderBy("vec_id").collect()
    restored = books.restore(np.array([r["codes"] for r in rows]))
    vectors = np.array([r["embedding"] for r in frame.orderBy("vec_id").collect()])
    assert ((restored - vectors) ** 2).sum() < 0.1 * ((vectors - vectors.mean(axis=0)) ** 2).sum()


def test_vector_codes_query(spark, sf_dir):
    sql = queries.ORACLE_SQL["op13_vector_codes"]
    assert difference(spark, connect(sf_dir), queries.op13_vector_codes, sql, sf_dir) is None
    nulls = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", F.when(F.col("label") > 4, F.col("label")))
    got, _ = vc.compress(nulls)
    assert got.where("label is null").count() > 0
