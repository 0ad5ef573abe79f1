"""Distinct counts by group from one pass, against plain Python, on hot, shared and unknown keys."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tillsight.plans import distinct_by_group


def made(rng, n, hot):
    rows = []
    for _ in range(n):
        key = hot if rng.random() < 0.35 else rng.choice([None, *range(40), *range(900, 905)])
        rows.append((key, rng.choice([None, f"o{rng.randrange(60)}"]), rng.choice([None, rng.randrange(30)]), rng.choice([None, rng.randrange(9)])))
    return rows


def brute(rows, group_of):
    orders, items, sums = defaultdict(set), defaultdict(set), defaultdict(list)
    for key, order, item, amount in rows:
        group = group_of.get(key)
        orders[group].add(order)
        items[group].add(item)
        sums[group].append(amount)

    def total(values):
        known = [v for v in values if v is not None]
        return (sum(known), min(known), max(known)) if known else (None, None, None)

    return {g: (*total(sums[g]), len(orders[g] - {None}), len(items[g] - {None})) for g in orders}


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("hot", [3, None, 901])
@pytest.mark.parametrize("shared", [False, True])
def test_counts_match_brute_force(spark, adaptive, hot, shared):
    rows = made(random.Random(7), 1500, hot)
    fact = spark.createDataFrame(rows, "k long, o string, i int, amount long")
    group_of = {k: k // 4 if shared and k < 20 else k for k in range(40)}
    groups = spark.createDataFrame([(k, g) for k, g in group_of.items()], "_member long, _group long")
    measures = {"total": (F.sum, "amount"), "least": (F.min, "amount"), "most": (F.max, "amount")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = distinct_by_group(fact, "k", groups, measures, {"orders": "o", "items": "i"}, key_is_group=not shared).collect()
        counts = distinct_by_group(fact, "k", groups, {}, {"orders": "o"}, key_is_group=not shared).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = brute(rows, group_of)
    assert len(got) == len(want) and {r["_group"]: tuple(r)[1:] for r in got} == want
    assert {tuple(r) for r in counts} == {(g, w[3]) for g, w in want.items()}
    assert distinct_by_group(fact.limit(0), "k", groups, measures, {"orders": "o"}).collect() == []


def scans(df, file):
    """Scans of a file that the executed plan runs; a reused shuffle runs none."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return sum(line.count("FileScan parquet") for line in final.splitlines() if file in line)


@pytest.mark.parametrize("name", ["report_customers", "report_products", "bottom_customers_by_orders"])
def test_the_fact_is_scanned_once(spark, sf_dir, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert scans(queries()[name](spark, sf_dir), "lineitem") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_key_is_spread_without_adaptive_execution(spark):
    """With a third of all lines on an unknown key, no shuffle partition gets more than a few hundredths of the pairs."""
    n, parts = 60_000, 64
    lines = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000).alias("k"), F.col("id").cast("string").alias("o")
    )
    groups = spark.range(5000).select(F.col("id").alias("_member"), F.col("id").alias("_group"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": parts, "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        values = F.struct("o")
        counted = distinct_by_group(lines, "k", groups, {}, {"orders": "o"}, key_is_group=True)
        assert counted.where("_group is null").first()["orders"] == n // 3
        # the look-up's partitions: by key and salt
        lots = lines.select("k", F.pmod(F.xxhash64("o"), F.lit(32)).cast("int").alias("s"), values.alias("v")).repartition(parts, "k", "s")
        sizes = [r["count"] for r in lots.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(sizes) < 6 * n / parts
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shuffles(df):
    """Shuffles that deal pairs, and those read again, in the plan as executed."""
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [sum("REPARTITION_BY_NUM" in line and ("ReusedExchange" in line) == again for line in final.splitlines()) for again in (False, True)]


@pytest.mark.parametrize("name", ["report_customers", "report_products"])
def test_the_look_up_reads_the_same_shuffle(spark, sf_dir, name):
    """Measures too: a second shuffle of all pairs without them would be another plan."""
    assert shuffles(queries()[name](spark, sf_dir)) == [1, 1]


def test_pairs_are_not_folded_before_their_shuffle(spark, sf_dir):
    from tillsight.operators import kpi
    from tillsight.sources import bench_tables

    lines = spark.createDataFrame([("p", 1), ("p", 1), ("p", 2), ("p", None), (None, 2), ("q", None)], "pizza_name string, order_id long")
    assert {tuple(r) for r in kpi.top_by_orders(lines).collect()} == {("p", 2), (None, 1), ("q", 0)}
    assert [tuple(r) for r in kpi.top_by_orders(lines, 1, ascending=True).collect()] == [("q", 0)]
    top = kpi.top_by_orders(bench_tables.pizza_sales(spark, sf_dir))
    steps = top._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = next(i for i, line in enumerate(steps) if "REPARTITION_BY_NUM" in line)
    assert not any("Aggregate" in line for line in steps[dealt:])


def test_the_sketch_profile_joins_lines_and_orders_once(spark, sf_dir):
    text = queries()["sketch_profile"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in text and "o_orderkey" not in text
