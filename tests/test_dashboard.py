from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillsight.operators import dashboard
from tillsight.sources import files, schemas

D = dt.date


def test_clean_table(spark):
    raw = spark.createDataFrame(
        [(" 1 ", " a ", "2024-01-01"), ("1", "a", "2024-01-01 "), ("x", "  ", "soon"), (None, "", None)],
        "id string, name string, day string",
    )
    types = {"id": "bigint", "day": "date"}
    cleaned = dashboard.clean_table(raw, types)
    assert dict(cleaned.dtypes) == {"id": "bigint", "name": "string", "day": "date"}
    assert set(rows(cleaned)) == {(1, "a", D(2024, 1, 1)), (None, None, None)}


def test_clean_table_keeps_one_row_per_key(spark):
    raw = spark.createDataFrame([("k", "b", 2), ("k", "a", 9), ("j", None, 1)], "k string, v string, n int")
    assert set(rows(dashboard.clean_table(raw, {}, key=["k"]))) == {("k", "a", 9), ("j", None, 1)}
    assert dashboard.clean_table(raw, {}, key=["k", "v", "n"]).count() == 3


def test_calendar(spark):
    df = spark.createDataFrame([(D(2023, 12, 30),), (D(2024, 1, 2),)], "d date")
    got = rows(dashboard.calendar_table(df, "d"))
    assert got[0] == (D(2023, 12, 30), 2023, 4, 12, "December", D(2023, 12, 24), 7, "Saturday", True)
    assert got[1] == (D(2023, 12, 31), 2023, 4, 12, "December", D(2023, 12, 31), 1, "Sunday", True)
    assert got[3] == (D(2024, 1, 2), 2024, 1, 1, "January", D(2023, 12, 31), 3, "Tuesday", False)
    monday = rows(dashboard.calendar_table(df, "d", week_start="monday", weekend_days=(6, 7)), "week_start", "weekday_no", "is_weekend")
    assert monday == [(D(2023, 12, 25), 6, True), (D(2023, 12, 25), 7, False), (D(2024, 1, 1), 1, False), (D(2024, 1, 1), 2, False)]


def test_attach_calendar_fills_quiet_days(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), 5), (D(2024, 1, 3), 7), (D(2024, 1, 3), 1)], "d date, x int")
    calendar = dashboard.calendar_table(df, "d").select("date", "weekday_name")
    got = rows(dashboard.attach_calendar(df, calendar, "d", {"n": F.count("*"), "s": F.sum("x")}).orderBy("date"))
    assert got == [(D(2024, 1, 1), "Monday", 1, 5), (D(2024, 1, 2), "Tuesday", 0, 0), (D(2024, 1, 3), "Wednesday", 2, 8)]


def test_attach_calendar_keeps_facts_it_cannot_place(spark):
    df = spark.createDataFrame([("2020-01-01", None), ("2020-01-03", 2), (None, 5), (None, 6)], "d string, x int")
    df = df.withColumn("d", F.col("d").cast("date"))
    calendar = dashboard.calendar_table(df, "d").where("date < '2020-01-03'")
    got = rows(dashboard.attach_calendar(df, calendar, "d", {"n": F.count("*"), "s": F.sum("x")}), "date", "n", "s")
    dated = {(str(d), n, x) for d, n, x in got if d}
    assert dated == {("2020-01-01", 1, None), ("2020-01-02", 0, 0)}
    assert sorted((n, x) for d, n, x in got if d is None) == [(1, 2), (2, 11)]


@pytest.mark.parametrize(
    "values,mean",
    [([4e-7, 4e-7], 4e-7), ([1e15, 3e15], 2e15), ([1e300, 1e300], 1e300), ([None, 2.0], 2.0), ([None], None),
     ([float("inf"), 1.0], float("inf")), ([float("nan"), 1.0], float("nan"))],
)
def test_means_of_doubles_are_plain_means(spark, values, mean):
    df = spark.createDataFrame([(i, v, 1, "a") for i, v in enumerate(values)], "patient_id int, wait_minutes double, satisfaction int, department string")
    for got in (rows(dashboard.er_kpis(df), "avg_wait_minutes"), rows(dashboard.wait_by(df, ["department"]), "avg_wait_minutes")):
        assert str(got[0][0]) == str(mean)


def test_import_reads_quoted_line_breaks(spark, tmp_path):
    from pyspark.sql import types as T

    from tillsight.sources.files import read_csv

    (tmp_path / "x.csv").write_text('city,n\n"A\nB",1\n"say ""hi"", ok",2\nC,many\n')
    schema = T.StructType([T.StructField("city", T.StringType()), T.StructField("n", T.IntegerType())])
    got = read_csv(spark, str(tmp_path / "x.csv"), schema, multi_line=True).collect()
    assert [(r["city"], r["n"]) for r in got] == [("A\nB", 1), ('say "hi", ok', 2), ("C", None)]
    assert [r["_corrupt_record"] is None for r in got] == [True, True, False]


def test_merge_append_slice_pivot(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (1, 11), (3, 30), (None, 0)], "k int, w int")
    assert dashboard.merge_tables(a, b, "k").count() == 6
    assert dashboard.merge_tables(a, b, "k", "inner").count() == 4
    with pytest.raises(ValueError):
        dashboard.merge_tables(a, b, "k", "cross")
    assert rows(dashboard.merge_counts(a, b, "k")) == [(4, 2, 2)]
    stacked = dashboard.append_tables(a, b, a)
    assert stacked.columns == ["k", "v", "w"] and stacked.count() == 12
    assert rows(dashboard.apply_slicers(a, {"k": [1, 2], "v": ["x", "z"]})) == [(1, "x"), (2, "z")]
    assert rows(dashboard.apply_slicers(a, {})) == rows(a)
    pivot = dashboard.pivot_table(a, ["k"], "v", ["x", "z"], F.count("v"))
    assert set(rows(pivot)) == {(1, 1, None), (2, None, 1), (None, None, None)}


@pytest.fixture
def visits(spark):
    data = [
        (1, 1, dt.datetime(2024, 1, 1, 5, 59), "er", 14.9, 4),
        (2, 1, dt.datetime(2024, 1, 1, 6, 0), "er", 15.0, None),
        (3, 2, dt.datetime(2024, 1, 1, 17, 0), None, 30.0, 2),
        (4, 3, dt.datetime(2024, 1, 2, 21, 0), "icu", 60.0, 0),
        (5, 3, dt.datetime(2024, 1, 3, 12, 0), "er", None, 5),
    ]
    return spark.createDataFrame(data, schemas.ER_VISITS)


def test_emergency_room(visits):
    assert rows(dashboard.er_kpis(visits)) == [(3, 119.9 / 4, 2.75)]
    assert rows(dashboard.daily_peaks(visits)) == [
        (D(2024, 1, 1), 2, 3, 1),
        (D(2024, 1, 2), 1, 1, 2),
        (D(2024, 1, 3), 1, 1, 2),
    ]
    assert set(rows(dashboard.wait_by(visits, ["department"]))) == {("er", 14.95, 3), (None, 30.0, 1), ("icu", 60.0, 1)}
    assert rows(dashboard.satisfaction_by_wait_band(visits)) == [
        ("under 15", 1, 4.0),
        ("15 to under 30", 1, None),
        ("30 to under 60", 1, 2.0),
        ("60 or more", 1, 0.0),
        ("unknown", 1, 5.0),
    ]
    assert rows(dashboard.department_referrals(visits)) == [("er", 3, 75.0), ("icu", 1, 25.0)]
    assert rows(dashboard.orders_by_hour(visits, "arrival_ts")) == [
        (5, 1, "Night"),
        (6, 1, "Morning"),
        (12, 1, "Afternoon"),
        (17, 1, "Evening"),
        (21, 1, "Night"),
    ]


@pytest.fixture
def orders(spark):
    def row(i, day, city, state, diet, amount, rating):
        return (i, day, city, state, "r", "c", diet, Decimal(amount), rating)

    return spark.createDataFrame(
        [
            row(1, D(2024, 1, 5), "A", "S", "Veg", 10, 4.5),  # Friday
            row(2, D(2024, 1, 6), "B", "S", "Veg", 20, None),  # Saturday
            row(3, D(2024, 1, 7), "C", "T", "Non-Veg", 30, 3.5),  # Sunday
            row(4, D(2024, 1, 8), "A", "S", "Veg", 40, 4.0),  # Monday
        ],
        schemas.FOOD_ORDERS,
    )


def test_food_delivery(orders):
    assert rows(dashboard.food_kpis(orders)) == [(Decimal(100), 4, 4.0, 25.0)]
    assert rows(dashboard.sales_by_place(orders, "state")) == [("S", Decimal(70), 3), ("T", Decimal(30), 1)]
    assert rows(dashboard.diet_distribution(orders)) == [("Veg", Decimal(70), 70.0), ("Non-Veg", Decimal(30), 30.0)]
    assert rows(dashboard.top_cities(orders, 2)) == [("A", Decimal(50)), ("C", Decimal(30))]
    assert rows(dashboard.weekend_share(orders)) == [("Weekday", Decimal(50), 2, 50.0), ("Weekend", Decimal(50), 2, 50.0)]
    assert rows(dashboard.weekend_share(orders, (6, 7)))[1] == ("Weekend", Decimal(30), 2, 30.0)


def test_csv_import_keeps_bad_lines(spark, tmp_path):
    path = tmp_path / "food_orders.csv"
    path.write_text(
        "order_id,order_date,city,state,restaurant,category,diet,amount,rating\n"
        "1,2024-01-05,A,S,r,c,Veg,10.50,4.5\n"
        "two,2024-01-06,B,S,r,c,Veg,20,\n"
    )
    df = files.read_table(spark, "food_orders", str(path), "csv").cache()
    assert rows(df.filter(f"{files.CORRUPT} is null"), "order_id", "amount") == [(1, Decimal("10.50"))]
    assert [r[0] for r in rows(df.filter(f"{files.CORRUPT} is not null"), files.CORRUPT)] == ["two,2024-01-06,B,S,r,c,Veg,20,"]
    df.unpersist()


def test_parquet_round_trip_views_and_catalog(spark, orders, tmp_path):
    path = str(tmp_path / "orders")
    files.write_parquet(orders, path, partition_by=["state"])
    back = files.read_table(spark, "food_orders", path)
    assert sorted(rows(back, "order_id", "state")) == [(1, "S"), (2, "S"), (3, "T"), (4, "S")]
    with pytest.raises(ValueError):
        files.read_table(spark, "food_orders", path, "xls")
    files.register_views({"food_orders_view": back})
    assert ("food_orders_view", "TEMPORARY", True) in rows(files.catalog_tables(spark))
    columns = rows(files.catalog_columns(spark, "food_orders_view"), "column_name", "data_type")
    assert ("amount", "decimal(18,2)") in columns and len(columns) == 9
