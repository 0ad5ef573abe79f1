"""Saved models, permanent views, slicers through the model, sketches and running values over rows."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tillsight.operators import dashboard, profiling, reports
from tillsight.plans import new_path
from tillsight.plans.running import running_over_rows
from tillsight.sources import bench_tables, files, model


def test_views_outlive_their_session_and_pass_filters_on(spark, sf_dir, fact, customers, products):
    lines = [("o1", 1, 1, "2020-01-05", 10, 1), ("o2", 2, 1, "2021-03-05", 6000, 2), ("o2", 9, 1, "2021-03-05", None, 0)]
    lines += [("o3", 1, 8, "2021-01-31", 5, 1), ("o4", 1, None, "2021-02-01", 7, 1), ("o4", 2, 8, "2021-02-01", 1, 1), ("o5", 1, 2, None, 3, 1)]
    tables = {
        "fact_sales": fact(lines),
        "dim_customers": customers([(1, "A", None, 1990), (2, None, "B", None)]),
        "dim_products": products([(1, "one", "x", "2.00"), (2, "two", "y", None)]),
    }
    database = f"t_{uuid.uuid4().hex}"
    for _ in range(2):  # again over what is there
        model.save_model(spark, tables, database, new_path(spark))
        model.create_report_views(spark, database, "2024-06-15")
    other = spark.newSession()
    people = reports.report_customers(tables["fact_sales"], tables["dim_customers"], "2024-06-15")
    things = reports.report_products(tables["fact_sales"], tables["dim_products"], "2024-06-15")
    for view, own in (("report_customers", people), ("report_products", things)):
        read = other.table(f"{database}.{view}")
        assert read.columns == own.columns
        assert sorted(map(tuple, read.collect()), key=str) == sorted(map(tuple, own.collect()), key=str)
    filtered = other.sql(f"select * from {database}.report_customers where customer_key = 1")
    plan = filtered._jdf.queryExecution().optimizedPlan().toString()
    facts, = [line for line in plan.splitlines() if "order_number" in line and "Relation" in line]
    above = plan[: plan.index(facts)].splitlines()[-2:]  # the filter on the fact's own key, right above its scan
    assert any("Filter" in line and "= 1" in line and "isnotnull(order_date" in line for line in above), plan
    assert len(filtered.collect()) == 1
    assert {r["table_name"] for r in files.catalog_tables(other, database).collect()} >= {"fact_sales", "report_customers"}
    spark.sql(f"drop database {database} cascade")


def test_slicers_read_only_the_partitions_they_need(spark, sf_dir):
    path = new_path(spark)
    fact = bench_tables.fact_sales(spark, sf_dir).withColumn("order_year", F.year("order_date"))
    files.write_parquet(fact, path, partition_by=["order_year"])
    years = spark.createDataFrame([(y, y % 2) for y in range(1980, 2030)], "order_year int, odd int")
    stored = files.read_parquet(spark, path)
    sliced = dashboard.slice_model(stored, [(years, "order_year", {"odd": [1]})])
    assert "dynamicpruningexpression" in sliced._jdf.queryExecution().toString()
    assert sliced.count() == fact.where("order_year % 2 = 1").count() > 0
    assert dashboard.slice_model(stored, [(years, "order_year", {})]).count() == fact.count()
    assert dashboard.slice_model(stored, [(years, "order_year", {"odd": []})]).count() == 0


def test_sketches_of_parts_add_up(spark):
    rows = [(i % 7 if i % 50 else None, f"v{i % 3000}", None if i % 3 else i) for i in range(20_000)]
    frame = spark.createDataFrame(rows, "day int, a string, b long")
    whole = profiling.column_sketches(frame, "day", ["a", "b"])
    pieces = [profiling.column_sketches(frame.where(c), "day", ["a", "b"]) for c in ("day < 3", "day >= 3", "day is null")]
    stored = pieces[0].unionByName(pieces[1]).unionByName(pieces[2])
    assert whole.count() == stored.count() == 16
    one, two = [{r["column_name"]: tuple(r) for r in profiling.profile_from_sketches(s).collect()} for s in (whole, stored)]
    # the order of merging moves an estimate a little
    assert {c: r[:3] for c, r in one.items()} == {c: r[:3] for c, r in two.items()}
    assert all(abs(one[c][3] - two[c][3]) <= 0.01 * one[c][3] for c in one)
    for column, distinct in (("a", 3000), ("b", len({r[2] for r in rows} - {None}))):
        assert abs(one[column][3] - distinct) <= 0.05 * distinct
        assert one[column][1:3] == (20_000, sum(r[{"a": 1, "b": 2}[column]] is None for r in rows))
    assert profiling.profile_from_sketches(profiling.column_sketches(frame.limit(0), "day", ["a"])).collect() == []


def plain(values, window):
    out, total = [], None
    for i, v in enumerate(values):
        total = v if total is None else total + (v or 0)
        last = [x for x in values[max(0, i + 1 - window) : i + 1] if x is not None]
        out.append((total, sum(last) / len(last) if last else None))
    return out


@pytest.mark.parametrize(("part_rows", "window"), [(1000, 3), (17, 3), (5, 12), (2, 7), (40, 1)])
def test_running_values_match_one_pass(spark, part_rows, window):
    rng = random.Random(part_rows)
    rows = [(rng.choice([None, 1, 1, 1, 2, rng.randrange(50)]), i, rng.choice([None, rng.randrange(-9, 100)])) for i in range(200)]
    frame = spark.createDataFrame(rows, "k int, i int, v long").repartition(6)
    got = running_over_rows(frame, ["k", "i"], "v", "total", "mean", window, part_rows=part_rows)
    assert got.columns == ["k", "i", "v", "total", "mean"]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {(k, i): w for (k, i, _), w in zip(ordered, plain([v for *_, v in ordered], window))}
    assert {(r["k"], r["i"]): (r["total"], r["mean"]) for r in got.collect()} == want
    assert running_over_rows(frame.limit(0), ["k"], "v", "total", "mean", window).collect() == []


def test_running_values_never_send_all_rows_to_one_task(spark):
    frame = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("v"))  # one value of the order
    got = running_over_rows(frame, ["k"], "v", "total", "mean", 3, part_rows=500)
    assert got.agg(F.max("total")).first()[0] == 4999 * 5000 // 2
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and max(sizes) < 4000
