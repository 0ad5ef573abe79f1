"""What the pipeline does with columns of its own names, the order of the curriculum, and inner tables."""

from __future__ import annotations

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tillsight.llm import curriculum, sharding
from tillsight.plans.materialize import materialize, only_kept, shared_folder

#: Names that the stages and their operators use inside.
INNER = (
    "copies copy uses use of row document order size __size __order position target epoch_ evidence quality_score path_rate host_rate "
    "n_words items hits __features __key __label __host __path __n __s __hn __hs __document __again component_id n_shingles node keys cluster "
    "unnamed id first stays n column_0 column_1 _metadata __source __of __part __words __before __start __schedule source_size schedule weight "
    "__number __row file at __nth __copies __uses __taker __text file_path"
).split()


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_columns_of_any_name_come_through_unchanged(spark, sf_dir, documents):
    marked = documents.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in INNER])
    plain = documents
    for name, stage in corpus_pipeline.STAGES:
        marked, plain = [materialize(stage(spark, d, sf_dir)) for d in (marked, plain)]
        rows = marked.collect()
        own = [f"{c}-{r['doc_id']}" for c in INNER if c != "position" or name != "sharding" for r in rows]
        assert own == [r[c] for c in INNER if c != "position" or name != "sharding" for r in rows]
        assert Counter(tuple(r[c] for c in plain.columns) for r in rows) == Counter(map(tuple, plain.collect())), name


def test_shards_follow_the_curriculum(spark, sf_dir, documents):
    mixed = materialize(corpus_pipeline.mix_sources(spark, documents, sf_dir))
    rows = corpus_pipeline.shard(spark, mixed, sf_dir).collect()
    assert sorted(r["place"] for r in rows) == list(range(len(rows)))
    assert all(r["shard"] == r["place"] % 8 and r["slot"] == r["place"] // 8 for r in rows)
    # positions are those of the streams: epochs of a document follow each other
    epochs = defaultdict(list)
    for r in rows:
        assert 0 <= r["position"] <= 1
        epochs[r["doc_id"]].append((r["epoch"], r["position"]))
    for found in epochs.values():
        assert [e for e, _ in sorted(found)] == list(range(len(found))) and sorted(found) == sorted(found, key=lambda f: f[1])
    # a source's words before a moment are its share of the schedule by then
    sizes = sorted((r["position"], r["source"], len(brute.words(r["text"]))) for r in rows)
    totals, done = Counter(), Counter()
    for _, source, words in sizes:
        totals[source] += words
    names = sorted(totals)
    for position, source, words in sizes:
        schedule = curriculum.SCHEDULES[names.index(source) % 3]
        area = sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))
        passed = 0.0
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            x = min(max(position - t0, 0), t1 - t0)
            passed += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        assert abs(done[source] / totals[source] - passed / area) < 1e-6
        done[source] += words


def test_windows_are_shuffled_and_keep_the_order(spark):
    frame = spark.range(1000).select("id", (F.col("id") / 1000).alias("t")).repartition(5)
    frame = materialize(frame.unionByName(spark.createDataFrame([(2000 + i, None) for i in range(3)], frame.schema)))
    rows = sharding.shard_in_order(frame, "t", ["id"], shards=4, window=64).collect()
    number = {r["id"]: i for i, r in enumerate(sorted(rows, key=lambda r: (r["t"] is None, r["t"] or 0, r["id"])))}
    assert sorted(r["place"] for r in rows) == list(range(1003))
    assert all(r["place"] // 64 == number[r["id"]] // 64 for r in rows)
    assert sum(r["place"] != number[r["id"]] for r in rows) > 900
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    assert sharding.shard_in_order(frame.limit(0), "t", ["id"]).collect() == []


def test_repeated_rows_and_an_empty_table(spark, sf_dir, documents):
    few = documents.orderBy("doc_id").limit(10)
    again = few.unionByName(few).unionByName(few.limit(2))
    got = corpus_pipeline.drop_near_copies(spark, again, sf_dir)
    assert len(got.collect()) == len({r["doc_id"] for r in got.collect()})
    for stage in (corpus_pipeline.mix_sources, corpus_pipeline.shard):
        done = materialize(stage(spark, again, sf_dir))
        assert set(done.select(*documents.columns).distinct().collect()) <= set(again.collect())
    assert done.count() == again.count()
    none = documents.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = materialize(stage(spark, none, sf_dir))
        assert none.collect() == [] and none.columns[:5] == documents.columns, name


def test_nothing_but_the_result_is_left(spark, sf_dir):
    folder = shared_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    result = corpus_pipeline.run(spark, sf_dir)
    assert len(set(os.listdir(folder)) - before) == 1 and result.count() > 0
    one = materialize(spark.range(3))
    with only_kept() as keep:
        two, three = materialize(one), keep(materialize(one))
    assert one.count() == three.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        two.collect()


def test_cycles_beyond_the_rows_do_not_matter(spark):
    """Row counts for which some cells beyond the rows only lead to each other."""
    for rows in range(2, 60):
        a, b = sharding._sides(rows)
        assert 1 <= sharding.walk_steps(spark, rows, 0) <= max(1, a * b - rows), rows
    for rows in (17, 43, 52):
        at = spark.range(rows).select(sharding.place(spark, F.col("id"), rows).alias("at")).collect()
        assert sorted(r["at"] for r in at) == list(range(rows))
