from __future__ import annotations

import itertools
import random
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tillsight import plans


def ntile(ordered, k):
    """Buckets of a list by definition: sizes differ by one, larger ones first."""
    size, larger = divmod(len(ordered), k)
    buckets = {}
    position = 0
    for bucket in range(1, k + 1):
        for _ in range(size + (bucket <= larger)):
            buckets[ordered[position]] = bucket
            position += 1
    return buckets


@pytest.mark.parametrize("count", [0, 1, 3, 4, 5, 6, 11, 1000])
@pytest.mark.parametrize("ranges", [2, 64])
def test_exact_tiles_match_definition(spark, count, ranges):
    rng = random.Random(count)
    data = [(i, rng.choice([1, 1, 1, 2, 7, None]), rng.random()) for i in range(count)]
    df = spark.createDataFrame(data, "id long, m int, x double").repartition(5)
    measures = {"up": ("m", True), "down": ("m", False), "fine": ("x", True)}
    got = {r["id"]: (r["up"], r["down"], r["fine"]) for r in plans.exact_tiles(df, measures, "id", 4, ranges).collect()}
    low = lambda m: -1 if m is None else m
    up = ntile([i for i, _, _ in sorted(data, key=lambda r: (low(r[1]), r[0]))], 4)
    down = ntile([i for i, _, _ in sorted(data, key=lambda r: (-low(r[1]), r[0]))], 4)
    fine = ntile([i for i, _, _ in sorted(data, key=lambda r: r[2])], 4)
    assert got == {i: (up[i], down[i], fine[i]) for i, _, _ in data}


def single_partition_inputs(df):
    """What stands below each exchange to a single partition."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [lines[i + 1] for i, line in enumerate(lines) if "Exchange SinglePartition" in line]


def test_tiles_bring_only_aggregates_to_one_task(spark):
    df = spark.range(5000).withColumn("m", F.col("id") % 7)
    out = plans.exact_tiles(df, {"t": ("m", True)}, "id", 4)
    assert all("partial_" in below for below in single_partition_inputs(out))
    assert sorted(r["count"] for r in out.groupBy("t").count().collect()) == [1250] * 4


def test_the_registered_rfm_brings_only_aggregates_to_one_task(spark, sf_dir):
    from __spark_entry__ import analytics

    assert all("partial_" in below for below in single_partition_inputs(analytics()["rfm"](spark, sf_dir)))


@given(st.integers(0, 300), st.integers(1, 9))
def test_tiles_by_formula(count, k):
    buckets = ntile(list(range(count)), k)
    size, larger = divmod(count, k)
    for at, bucket in buckets.items():
        by_formula = at // (size + 1) if at < larger * (size + 1) else larger + (at - larger * (size + 1)) // max(size, 1)
        assert by_formula + 1 == bucket


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("k", [1, 2, 3, 50])
def test_dense_rank_top_matches_definition(spark, ascending, k):
    values = [5, 5, 5, 2, 2, 9, None, None, 1]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int")
    got = {(r["id"], r["v"], r["rk"]) for r in plans.dense_rank_top(df, "v", k, "rk", ascending).collect()}
    low = lambda v: -1 if v is None else v
    distinct = sorted(set(values), key=low, reverse=not ascending)
    expected = {(i, v, distinct.index(v) + 1) for i, v in enumerate(values) if distinct.index(v) < k}
    assert got == expected


def test_first_n_settles_ties_by_key(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 1), ("d", 0)], "k string, v int")
    assert rows(plans.first_n(df, "v", 2, ["k"])) == [("a", 1), ("b", 1)]
    assert rows(plans.first_n(df, "v", 2, ["k"], ascending=True)) == [("d", 0), ("a", 1)]


def test_roll_up_keeps_unmatched_in_one_group(spark):
    fact = spark.createDataFrame([(1, 10), (1, 5), (2, 7), (8, 1), (9, 2), (None, 4)], "key long, x long")
    dim = spark.createDataFrame([(1, "A"), (2, "B")], "key long, name string")
    assert set(rows(plans.roll_up(fact, dim, "key", ["name"], {"t": "x"}))) == {("A", 15), ("B", 7), (None, 7)}
    assert set(rows(plans.roll_up(fact, dim, "key", ["key", "name"], {"t": "x"}))) == {
        (1, "A", 15),
        (2, "B", 7),
        (None, None, 7),
    }


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, v int").groupBy("k").agg(F.sum("v").alias("v"))
    assert set(rows(df.select("k", plans.share_of_total(df, "v")))) == {("a", 25.0), ("b", 75.0)}
    zero = df.filter("v > 9")
    assert rows(zero.select(plans.share_of_total(zero, "v"))) == []


def brute_pairs(lines, names):
    """Count label pairs line by line: lower key first."""
    counts = Counter()
    groups = {}
    for group, item in lines:
        if group is not None and item is not None:
            groups.setdefault(group, []).append(item)
    for members in groups.values():
        for a, b in itertools.product(members, members):
            if a < b:
                counts[(names.get(a), names.get(b))] += 1
    return counts


def basket_lines(seed, hot):
    rng = random.Random(seed)
    items = list(range(1, 41))
    weights = [1 / i for i in items]
    lines = [(f"o{rng.randrange(150)}", rng.choices(items, weights)[0]) for _ in range(600)]
    lines += [("hot", rng.choices(items, weights)[0]) for _ in range(hot)]
    lines += [(None, 1), ("o1", None), ("o2", 99), ("o2", 3), ("o2", 3)]
    rng.shuffle(lines)
    return lines


NAMES = {i: f"n{i % 29}" for i in range(1, 41)}  # some keys share a name, 99 has none


@pytest.mark.parametrize("hot", [0, 300])
@pytest.mark.parametrize("block", [4, 512])
@pytest.mark.parametrize("per_task", [50, 10**6])
def test_pair_counts_match_brute_force(spark, monkeypatch, hot, block, per_task):
    monkeypatch.setattr("tillsight.plans.pairs._PAIRS_PER_TASK", per_task)
    lines = basket_lines(1, hot)
    df = plans.distinct_lines(spark.createDataFrame(lines, "g string, i long"), "g", "i")
    df = df.withColumn("_label", F.col("_item"))
    got = {(r["label_a"], r["label_b"]): r["times"] for r in plans.pair_counts(df, block).collect()}
    assert got == dict(brute_pairs(lines, {i: i for i in range(100)}))


@pytest.mark.parametrize("seed,hot,n", [(1, 0, 3), (1, 300, 3), (2, 300, 20), (3, 300, 2000)])
def test_top_label_pairs_match_brute_force(spark, seed, hot, n):
    lines = basket_lines(seed, hot)
    df = plans.distinct_lines(spark.createDataFrame(lines, "g string, i long"), "g", "i")
    labels = spark.createDataFrame(list(NAMES.items()), "_item long, _label string")
    counted = plans.top_label_pairs(df, labels, n, block=8)
    got = [(r["label_a"], r["label_b"], r["times"]) for r in plans.first_n(counted, "times", n, ["label_a", "label_b"]).collect()]
    wanted = sorted(
        ((a, b, t) for (a, b), t in brute_pairs(lines, NAMES).items()), key=lambda r: (-r[2], r[0] or "", r[1] or "")
    )
    assert got == wanted[:n]


def test_copied_lines_are_never_broadcast(spark):
    """The copies of a wide group's lines are larger than Spark's estimate of them."""
    df = plans.distinct_lines(spark.range(400).selectExpr("'wide' as g", "id as i"), "g", "i")
    pairs = plans.pair_counts(df.withColumn("_label", F.col("_item") % 3), block=8)
    text = pairs._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in text.splitlines() if "_from" in line and "_to" in line and "Join" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert sum(r["times"] for r in pairs.collect()) == 400 * 399 // 2


def test_pruning_leaves_out_weak_pairs(spark):
    """Two strong items in many groups, and one wide group of weak ones."""
    lines = [(f"o{i}", item) for i in range(200) for item in (1, 2)] + [("wide", item) for item in range(1, 300)]
    df = plans.distinct_lines(spark.createDataFrame(lines, "g string, i long"), "g", "i")
    labels = spark.createDataFrame([(i, f"n{i:03}") for i in range(1, 300)], "_item long, _label string")
    counted = plans.top_label_pairs(df, labels, 1, block=16)
    # 299 items of the wide group make 44551 pairs; the bound leaves the strong pair
    assert rows(counted) == [("n001", "n002", 201)]


def test_sparse_baskets_name_only_the_pairs_that_tie_with_the_last(spark):
    """Nearly all counts are one or two; ranking distinct counts would name every pair."""
    rng = random.Random(9)
    lines = [(f"o{i}", item) for i in range(4000) for item in rng.sample(range(1000), 3)]
    df = plans.distinct_lines(spark.createDataFrame(lines, "g string, i long"), "g", "i")
    labels = spark.createDataFrame([(i, f"n{i:04}") for i in range(1000)], "_item long, _label string")
    got = sorted((r["times"] for r in plans.top_label_pairs(df, labels, 5).collect()), reverse=True)
    every = sorted(brute_pairs(lines, {i: i for i in range(1000)}).values(), reverse=True)
    assert got == [t for t in every if t >= every[4]] and len(got) < len(every) / 4


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_partitioned_table_is_read_by_directory(spark, sf_dir):
    from __spark_entry__ import analytics

    assert "PartitionFilters: [isnotnull(order_year#" in plan_of(analytics()["partitioned_sink"](spark, sf_dir))
    plans.drop_materialized(spark)


def test_an_exact_profile_reads_each_table_once(spark, sf_dir):
    from pyspark.sql import types as T

    from tillsight.operators import profiling

    wide = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = plan_of(profiling.column_profile({"orders": wide}))
    assert plan.count("Scan parquet") == 1
    odd = T.StructType([T.StructField(n, t) for n, t in
                        [("a.b", T.DoubleType()), ("list", T.ArrayType(T.LongType())), ("x", T.DoubleType()), ("none", T.LongType())]])
    nan = float("nan")
    df = spark.createDataFrame([(0.0, [1], nan, None), (-0.0, [1], nan, None), (None, None, 2.0, None), (1.5, [], 2.0, None)], odd)
    got = rows(profiling.column_profile({"t": df}), "column_name", "data_type", "null_count", "distinct_count")
    assert got == [("a.b", "double", 1, 2), ("list", "array<bigint>", 1, 2), ("x", "double", 0, 2), ("none", "bigint", 4, 0)]


def test_a_stored_table_is_dropped_by_itself(spark):
    from tillsight.plans.materialize import drop

    one, two = plans.materialize(spark.range(5)), plans.materialize(spark.range(7))
    place = Path(one.inputFiles()[0].removeprefix("file:")).parent
    drop(one)
    drop(one)  # nothing left to do
    assert not place.exists() and two.count() == 7
    drop(two)


def test_materialize_uses_the_sessions_folder(spark):
    from tillsight.plans.materialize import shared_folder

    folder = shared_folder(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or folder.startswith(configured)
    stored = plans.materialize(spark.range(10))
    assert sorted(r["id"] for r in stored.collect()) == list(range(10))
    local = Path(folder.removeprefix("file:"))
    assert all(str(local) in f for f in stored.inputFiles())
    plans.drop_materialized(spark)
    assert not local.exists()


def test_a_wide_group_meets_by_label(spark):
    """Across the blocks of a wide group sums by label are joined, so far fewer rows meet than there are item pairs."""
    from tillsight.plans import pairs

    rng = random.Random(4)
    items, of = list(range(3000)), {i: rng.choice([None, 1, 2, 5]) for i in range(3000)}
    rng.shuffle(items)
    made = [("wide", i, i % 3 + 1, of[i]) for i in items] + [("thin", i, 1, of[i]) for i in items[:5]]
    lines = spark.createDataFrame(made, "_group string, _item long, _lines long, _label long")
    counts = {(r["label_a"], r["label_b"]): r["times"] for r in pairs.pair_counts(lines, block=16).collect()}
    wanted, before = Counter(), Counter()
    for i in sorted(items):
        for label, n in before.items():
            wanted[label, of[i]] += n * (i % 3 + 1)
        before[of[i]] += i % 3 + 1
    for a, b in itertools.combinations(sorted(items[:5]), 2):
        wanted[of[a], of[b]] += 1
    assert counts == dict(wanted)

    cut = pairs._blocks(lines.where("_group = 'wide'"), 16, 3000)
    met = pairs._far_pairs(cut, None).count() + pairs._near_pairs(cut, ["_group", "_block"], 0, None).count()
    assert met < 3000 * 16 < 3000 * 2999 / 2 / 90
