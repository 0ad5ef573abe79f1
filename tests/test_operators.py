from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillsight.operators import basket, cohort, exploration, kpi, profiling, quality, ranking, reports, segments
from tillsight.operators import timeseries

D = dt.date


def dec(x):
    return Decimal(str(x)).quantize(Decimal("0.01"))


# ---- profiles and quality ----


def test_profiles(spark):
    t = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, None, None)], "k int, s string, z double")
    tables = {"t": t, "none": t.filter("k > 9")}
    assert rows(profiling.table_profile(tables)) == [("none", 0), ("t", 3)]
    expected = [
        ("none", "k", 1, "int", 0, 0),
        ("none", "s", 2, "string", 0, 0),
        ("none", "z", 3, "double", 0, 0),
        ("t", "k", 1, "int", 0, 2),
        ("t", "s", 2, "string", 1, 2),
        ("t", "z", 3, "double", 3, 0),
    ]
    assert rows(profiling.column_profile(tables)) == expected
    assert rows(profiling.column_profile(tables, approx=True)) == expected
    assert rows(profiling.column_profile(tables, "t")) == expected[3:]


def test_quality_checks(fact, customers, products):
    f = fact(
        [
            ("A", 1, 1, None, 10, 1),
            ("A", 2, 1, "2024-01-01", 0, 1),
            ("B", 9, 2, "2024-01-01", 5, 0),
            ("C", None, None, "2024-01-01", -1, -1),
            ("D", 1, 7, "2024-01-01", None, None),
        ]
    )
    c = customers([(1, "a", "b", 1990), (2, "a", "b", 1990), (3, "a", "b", 1990), (None, "x", "y", 1990)])
    p = products([(1, "n1", "c", 1), (2, "n2", "c", 1)])
    assert rows(quality.null_count(f, "order_date", "n")) == [(1,)]
    assert rows(quality.duplicate_keys(f, "order_number")) == [("A", 2)]
    # NULL <= 0 is unknown, so line D is not counted
    assert rows(quality.non_positive_count(f, ["sales_amount", "quantity"], "n")) == [(3,)]
    # the customer without a key never matches, even though a sale has no customer
    assert rows(quality.unmatched_count(c, f, "customer_key", "n")) == [(2,)]
    assert rows(quality.unmatched_count(f, p, "product_key", "n")) == [(2,)]
    assert {r["order_number"] for r in quality.unmatched(f, p, "product_key").collect()} == {"B", "C"}
    empty = f.limit(0)
    assert rows(quality.unmatched_count(empty, p, "product_key", "n")) == [(0,)]


# ---- exploration ----


def test_date_coverage_and_ages(fact, customers):
    f = fact([("A", 1, 1, "2023-12-31", 1, 1), ("B", 1, 1, "2024-01-01", 1, 1), ("C", 1, 1, None, 1, 1)])
    assert rows(exploration.date_coverage(f)) == [(D(2023, 12, 31), D(2024, 1, 1), 1, 1)]
    c = customers([(1, "a", "b", 1950), (2, "a", "b", 2000), (3, "a", "b", None)])
    # the year difference counts before the birthday, too
    assert rows(exploration.age_extremes(c, "2020-01-01")) == [(D(2000, 6, 1), 20, D(1950, 6, 1), 70)]


def test_measure_summary(fact, customers, products):
    f = fact([("A", 1, 1, None, 10, 1), ("A", 2, 1, None, 20, 2), ("B", 1, 9, None, 30, 3)]).withColumn(
        "price", F.lit(2).cast("decimal(18,2)")
    )
    got = dict(rows(exploration.measure_summary(f, customers([(1, "a", "b", 1)]), products([(1, "n", "c", 1), (5, "n", "c", 1)]))))
    assert got == {
        "Total Sales": 60.0,
        "Total Quantity": 6.0,
        "Average Order Value": 20.0,
        "Average Unit Price": 2.0,
        "Total Orders": 2.0,
        "Total Products (Dim)": 2.0,
        "Total Products (Sold)": 2.0,
        "Total Customers (Dim)": 1.0,
        "Total Customers (Ordered)": 2.0,
    }


def test_orphans_share_one_nameless_customer(fact, customers):
    f = fact([("A", 1, 1, None, 10, 1), ("B", 1, 8, None, 5, 1), ("C", 1, 9, None, 6, 1), ("D", 1, None, None, 7, 1)])
    got = rows(exploration.revenue_per_customer(f, customers([(1, "Ann", None, 1990), (2, "Bo", "B", 1990)])))
    assert got == [(None, " ", dec(18)), (10, "Ann ", dec(10))]


def test_category_contribution(fact, products):
    f = fact([("A", 1, 1, None, 5, 1), ("B", 2, 1, None, 95, 1), ("C", 9, 1, None, 100, 1)])
    got = rows(exploration.category_contribution(f, products([(1, "a", "x", 1), (2, "b", "y", 1)])))
    assert got == [(None, dec(100), 50.0, "50%"), ("y", dec(95), 47.5, "47.5%"), ("x", dec(5), 2.5, "2.5%")]


# ---- rankings ----


def test_rankings_keep_ties(fact, customers, products):
    f = fact([("A", 1, 1, None, 5, 1), ("B", 2, 1, None, 5, 1), ("C", 3, 2, None, 4, 1), ("D", 4, 3, None, 9, 1)])
    p = products([(i, f"n{i}", "c", 1) for i in range(1, 5)])
    assert set(rows(ranking.top_products(f, p, k=2))) == {("n4", dec(9), 1), ("n1", dec(5), 2), ("n2", dec(5), 2)}
    assert set(rows(ranking.bottom_products(f, p, k=1))) == {("n3", dec(4), 1)}
    c = customers([(1, "a", "x", 1990), (2, "b", "x", 1990), (3, "c", "x", 1990)])
    assert set(rows(ranking.bottom_customers_by_orders(f, c, k=1))) == {(20, "b x", 1, 1), (30, "c x", 1, 1)}
    assert rows(ranking.top_customers(f, c, k=1)) == [(10, "a x", dec(10), 1)]


def test_orders_of_unknown_customers_are_counted_once(fact, customers):
    """Two unknown keys in one order are one order of the nameless customer."""
    f = fact([("A", 1, 8, None, 1, 1), ("A", 1, 9, None, 1, 1), ("B", 1, 1, None, 1, 1), ("C", 1, 1, None, 1, 1)])
    got = rows(ranking.bottom_customers_by_orders(f, customers([(1, "a", "x", 1990)])))
    assert set(got) == {(None, " ", 1, 1), (10, "a x", 2, 2)}


def test_top_n_is_exact_on_ties(spark):
    df = spark.createDataFrame([(n, 1) for n in "edcba"], "name string, v int")
    assert rows(ranking.top_n(df, "name", F.sum("v"), "s", 2)) == [("a", 1), ("b", 1)]


# ---- time series ----


def test_monthly_sales_in_calendar_order(fact):
    f = fact(
        [
            ("A", 1, 1, "2023-04-30", 1, 1),
            ("B", 1, 1, "2023-01-01", 2, 2),
            ("C", 1, 2, "2023-01-31", 3, 3),
            ("D", 1, 2, "2022-12-01", 4, 4),
            ("E", 1, 2, None, 9, 9),
        ]
    )
    assert rows(timeseries.monthly_sales(f)) == [
        (2022, "December", dec(4), 1, 4),
        (2023, "January", dec(5), 2, 5),
        (2023, "April", dec(1), 1, 1),
    ]


def test_moving_average_runs_over_present_months(fact):
    f = fact([(str(m), 1, 1, f"2023-{m:02}-15", m, 1) for m in (1, 2, 3, 7)])
    assert [tuple(r)[2:] for r in timeseries.running_and_moving(f).collect()] == [
        (dec(1), 1.0),
        (dec(3), 1.5),
        (dec(6), 2.0),
        (dec(13), 4.0),
    ]


def test_yoy_skips_missing_years_and_guards_zero(fact, products):
    f = fact(
        [
            ("A", 1, 1, "2011-05-05", 100, 1),
            ("B", 1, 1, "2013-05-05", 150, 1),
            ("C", 2, 1, "2011-05-05", 0, 1),
            ("D", 2, 1, "2012-05-05", 10, 1),
            ("E", 2, 1, "2013-05-05", 10, 1),
        ]
    )
    p = products([(1, "one", "c", 1), (2, "two", "c", 1)])
    by_key = rows(timeseries.yoy(f, p, "product_key"), "product_key", "order_year", "prior_year_sales", "yoy_change_abs", "yoy_change_pct", "yoy_direction")
    assert by_key == [
        (1, 2011, None, dec(100), None, "FIRST YEAR"),
        (1, 2013, dec(100), dec(50), 50.0, "GROWING"),
        (2, 2011, None, dec(0), None, "FIRST YEAR"),
        (2, 2012, dec(0), dec(10), None, "GROWING"),
        (2, 2013, dec(10), dec(0), 0.0, "FLAT"),
    ]
    by_name = rows(timeseries.yoy(f, p), "product_name", "order_year", "prior_year_sales", "yoy_change_pct", "yoy_direction", "avg_sales", "avg_performance_flag")
    assert by_name == [
        ("one", 2011, dec(0), None, "INCREASING", 125.0, "BELOW AVG"),
        ("one", 2013, dec(100), 50.0, "INCREASING", 125.0, "ABOVE AVG"),
        ("two", 2011, dec(0), None, "NO CHANGE", 20 / 3, "BELOW AVG"),
        ("two", 2012, dec(0), None, "INCREASING", 20 / 3, "ABOVE AVG"),
        ("two", 2013, dec(10), 0.0, "NO CHANGE", 20 / 3, "ABOVE AVG"),
    ]


def test_yoy_groups_by_name_or_key(fact, products):
    f = fact([("A", 1, 1, "2011-01-01", 1, 1), ("B", 2, 1, "2011-01-01", 2, 1), ("C", 9, 1, "2011-01-01", 4, 1), ("D", 8, 1, "2011-01-01", 8, 1)])
    p = products([(1, "same", "c", 1), (2, "same", "c", 1)])
    assert rows(timeseries.yoy_by_name(f, p), "product_name", "total_sales") == [(None, dec(12)), ("same", dec(3))]
    assert rows(timeseries.yoy_by_key(f, p), "product_key", "total_sales") == [(None, dec(12)), (1, dec(1)), (2, dec(2))]
    flags = rows(timeseries.yoy_by_name(f, p), "avg_performance_flag")
    assert flags == [("AT AVG",), ("AT AVG",)]


def test_sales_trend_grains(spark):
    df = spark.createDataFrame(
        [(1, D(2024, 1, 7), dec(1)), (2, D(2024, 1, 8), dec(2)), (2, D(2024, 1, 8), dec(4)), (3, D(2024, 2, 1), dec(8))],
        "order_id long, order_date date, amount decimal(18,2)",
    )
    assert rows(timeseries.sales_trend(df, "week")) == [
        (D(2024, 1, 1), dec(1), 1),
        (D(2024, 1, 8), dec(6), 1),
        (D(2024, 1, 29), dec(8), 1),
    ]
    assert rows(timeseries.sales_trend(df, "month")) == [(D(2024, 1, 1), dec(7), 2), (D(2024, 2, 1), dec(8), 1)]
    assert rows(timeseries.sales_trend(df, "day"))[0] == (D(2024, 1, 7), dec(1), 1)
    with pytest.raises(ValueError):
        timeseries.sales_trend(df, "minute")


# ---- segments ----


@pytest.mark.parametrize(
    "cost,label",
    [
        ("99.99", "BELOW $100"),
        ("100", "$100 - $499"),
        ("499", "$100 - $499"),
        ("499.50", "ABOVE $1000"),
        ("500", "$500 - $999"),
        ("999", "$500 - $999"),
        ("999.50", "ABOVE $1000"),
        ("1000", "ABOVE $1000"),
        (None, "ABOVE $1000"),
    ],
)
def test_cost_tiers(products, cost, label):
    assert rows(segments.cost_segments(products([(1, "n", "c", cost)]))) == [(label, 1)]


@pytest.mark.parametrize(
    "months,spend,label",
    [(11, "9999", "NEW"), (12, "5000", "REGULAR"), (12, "5000.01", "VIP"), (None, "1", "NEW"), (12, None, "NEW")],
)
def test_customer_segment(spark, months, spend, label):
    df = spark.createDataFrame([(months, spend and Decimal(spend))], "m int, s decimal(18,2)")
    assert rows(df.select(segments.customer_segment(F.col("m"), F.col("s")))) == [(label,)]


def test_customer_segments_counts_and_tenure(fact):
    f = fact(
        [
            ("A", 1, 1, "2020-01-31", 6000, 1),
            ("B", 1, 1, "2021-01-01", 1, 1),
            ("C", 1, 2, "2020-01-01", 6000, 1),
            ("D", 1, 2, "2021-02-01", 1, 1),
            ("E", 1, 3, "2020-01-01", 5, 1),
            ("F", 1, None, "2020-01-01", 15, 1),
        ]
    )
    assert rows(segments.customer_segments(f)) == [("VIP", 2, 6001.0, 12), ("NEW", 1, 10.0, 0)]
    assert rows(segments.customer_segments(f, tenure_avg="mean"))[0] == ("VIP", 2, 6001.0, 12.5)
    with pytest.raises(ValueError):
        segments.customer_segments(f, tenure_avg="median")


@pytest.mark.parametrize(
    "total,label",
    [(3, "LOST"), (4, "LOST"), (5, "AT RISK"), (6, "AT RISK"), (7, "LOYAL"), (9, "LOYAL"), (10, "CHAMPION"), (12, "CHAMPION")],
)
def test_rfm_segment(spark, total, label):
    assert rows(spark.range(1).select(segments.rfm_segment(F.lit(total)))) == [(label,)]


def test_rfm_directions(fact):
    f = fact(
        [("A", 1, 1, "2001-12-01", 100, 1), ("B", 1, 1, "2001-12-05", 1, 1), ("C", 1, 2, "2001-06-01", 50, 1)]
        + [("D", 1, 3, "2000-01-01", 20, 1), ("E", 1, 4, "1999-01-01", 10, 1), ("F", 1, 5, None, 10**6, 1)]
    )
    got = rows(segments.rfm(f, "2002-01-01"))
    assert got == [
        (1, 1, 2, dec(101), 4, 4, 4, 12, "CHAMPION"),
        (2, 7, 1, dec(50), 3, 1, 3, 7, "LOYAL"),
        (3, 24, 1, dec(20), 2, 2, 2, 6, "AT RISK"),
        (4, 36, 1, dec(10), 1, 3, 1, 5, "AT RISK"),
    ]


def test_rfm_scores_are_quartiles(spark, sf_dir):
    from tillsight.sources import bench_tables

    scored = segments.rfm(bench_tables.fact_sales(spark, sf_dir), "2002-01-01")
    totals = [r["rfm_total_score"] for r in scored.collect()]
    assert min(totals) >= 3 and max(totals) <= 12
    for score in ("r_score", "f_score", "m_score"):
        sizes = [r["count"] for r in scored.groupBy(score).count().collect()]
        assert max(sizes) - min(sizes) <= 1


# ---- cohorts and baskets ----


def test_cohort_retention(fact):
    f = fact(
        [
            ("A", 1, 1, "2020-01-31", 10, 1),
            ("B", 1, 1, "2020-02-01", 5, 1),
            ("B", 2, 1, "2020-02-01", 5, 1),
            ("C", 1, 2, "2020-01-01", 1, 1),
            ("D", 1, 3, "2020-02-10", 7, 1),
            ("E", 1, 1, None, 99, 1),
            ("F", 1, None, "2020-01-01", 99, 1),
        ]
    )
    assert rows(cohort.cohort_retention(f)) == [
        (D(2020, 1, 1), 0, 2, dec(11), 100.0),
        (D(2020, 1, 1), 1, 1, dec(10), 50.0),
        (D(2020, 2, 1), 0, 1, dec(7), 100.0),
    ]


@pytest.mark.parametrize("block", [2, 512])
def test_affinity_counts_lines_and_shared_names(fact, products, block):
    f = fact(
        [
            ("A", 1, 1, None, 1, 1),
            ("A", 1, 1, None, 1, 1),  # the same product twice
            ("A", 2, 1, None, 1, 1),
            ("B", 2, 1, None, 1, 1),
            ("B", 3, 1, None, 1, 1),  # same name as 1
            ("C", 1, 1, None, 1, 1),
            ("C", 3, 1, None, 1, 1),
            ("D", 9, 1, None, 1, 1),  # not in the catalogue
            ("D", 1, 1, None, 1, 1),
        ]
    )
    p = products([(1, "x", "c", 1), (2, "y", "c", 1), (3, "x", "c", 1)])
    got = rows(basket.product_affinity(f, p, block=block))
    assert got == [("x", "y", 2), ("x", None, 1), ("x", "x", 1), ("y", "x", 1)]
    assert rows(basket.product_affinity(f, p, n=1, block=block)) == got[:1]


# ---- reports ----


@pytest.mark.parametrize(
    "age,label",
    [(19, "UNDER 20"), (20, "20-29"), (29, "20-29"), (30, "30-39"), (39, "30-39"), (40, "40-49"), (49, "40-49"), (50, "50+"), (None, "50+")],
)
def test_age_groups(spark, age, label):
    df = spark.createDataFrame([(age,)], "a int")
    assert rows(df.select(reports.age_group(F.col("a")))) == [(label,)]


@pytest.mark.parametrize(
    "sales,label",
    [("9999.99", "LOW"), ("10000", "MID"), ("50000", "MID"), ("50000.01", "HIGH"), (None, "LOW")],
)
def test_product_tiers(spark, sales, label):
    df = spark.createDataFrame([(sales and Decimal(sales),)], "s decimal(18,2)")
    assert rows(df.select(reports.product_tier(F.col("s")))) == [(f"{label} PERFORMER",)]


def test_customer_report(fact, customers):
    f = fact(
        [
            ("A", 1, 1, "2000-01-31", 3000, 2),
            ("A", 2, 1, "2000-01-31", 3000, 1),
            ("B", 1, 1, "2001-01-01", 60, 1),
            ("C", 1, 2, "2001-12-31", 10, 1),
            ("D", 1, 8, "2001-12-31", 1, 1),
            ("D", 1, 9, "2001-12-31", 2, 1),
            ("E", 1, 1, None, 999, 1),
        ]
    )
    c = customers([(1, "Ann", "Lee", 1980), (2, "Bo", None, None), (3, "Never", "Ordered", 1980)])
    got = {r["customer_key"]: r for r in reports.report_customers(f, c, "2002-01-01").collect()}
    assert set(got) == {1, 2, None}
    assert tuple(got[1]) == (
        1, "C1", "Ann Lee", 22, "20-29", "VIP", 2, dec(6060), 4, 2, D(2000, 1, 31), D(2001, 1, 1), 12, 12, 3030.0, 505.0,
    )
    assert tuple(got[2]) == (
        2, "C2", "Bo ", None, "50+", "NEW", 1, dec(10), 1, 1, D(2001, 12, 31), D(2001, 12, 31), 0, 1, 10.0, 10.0,
    )
    # unknown customers share one row, and one order of two of them counts once
    assert got[None]["customer_name"] == " " and got[None]["total_orders"] == 1 and got[None]["total_sales"] == dec(3)


def test_product_report_guards_divisions(fact, products):
    f = fact(
        [
            ("A", 1, 1, "2000-01-31", 100, 4),
            ("B", 1, 2, "2000-03-01", 100, 4),
            ("C", 2, 1, "2000-01-01", 50, 0),
            ("D", 3, 1, "2000-01-01", 0, 5),
            ("E", 4, 1, "2000-01-01", 10, None),
            ("F", 9, 1, "2000-01-01", 10, 1),
        ]
    )
    p = products([(1, "a", "c", 20), (2, "b", "c", 20), (3, "d", "c", 20), (4, "e", "c", None)])
    got = {r["product_key"]: r for r in reports.report_products(f, p, "2002-01-01").collect()}
    assert tuple(got[1])[5:] == (
        "LOW PERFORMER", D(2000, 1, 31), D(2000, 3, 1), 2, 22, 2, 2, dec(200), 8, 100.0, 100.0, 25.0, 20.0,
    )
    assert (got[2]["avg_revenue_per_unit"], got[2]["estimated_margin_pct"]) == (0.0, None)
    assert (got[3]["avg_revenue_per_unit"], got[3]["estimated_margin_pct"]) == (0.0, None)
    assert (got[4]["avg_revenue_per_unit"], got[4]["estimated_margin_pct"]) == (None, None)
    assert got[None]["total_sales"] == dec(10)


def test_reports_as_views(spark, fact, customers, products):
    f = fact([("A", 1, 1, "2000-01-31", 100, 4)])
    reports.register_reports(f, customers([(1, "a", "b", 1990)]), products([(1, "n", "c", 1)]), "2002-01-01")
    assert rows(spark.sql("select customer_name from report_customers where customer_key = 1")) == [("a b",)]
    assert rows(spark.sql("select product_name from report_products")) == [("n",)]


# ---- order-line KPIs ----


@pytest.fixture
def lines(spark):
    data = [
        (1, D(2023, 1, 1), "p", "c1", "S", 2, dec(10)),
        (1, D(2023, 1, 1), "q", "c2", "L", 1, dec(20)),
        (2, D(2024, 1, 7), "p", "c1", "S", 3, dec(30)),
        (3, D(2024, 2, 6), "r", "c1", "M", 4, dec(40)),
    ]
    return spark.createDataFrame(
        data,
        "order_id long, order_date date, pizza_name string, pizza_category string, pizza_size string, "
        "quantity int, total_price decimal(18,2)",
    )


def test_kpi_cards_agree_with_single_kpis(lines):
    single = [kpi.total_revenue, kpi.avg_order_value, kpi.total_quantity, kpi.total_orders, kpi.items_per_order]
    cards = rows(kpi.kpi_cards(lines))[0]
    assert cards == tuple(rows(f(lines))[0][0] for f in single)
    assert cards == (dec(100), 100 / 3, 10, 3, dec("3.33"))


def test_kpis_of_no_lines(lines):
    assert rows(kpi.kpi_cards(lines.limit(0))) == [(None, None, None, 0, None)]


def test_order_rhythm(lines):
    assert rows(kpi.orders_by_weekday(lines)) == [("Sunday", 2), ("Tuesday", 1)]
    assert rows(kpi.orders_by_weekday(lines, "monday")) == [("Tuesday", 1), ("Sunday", 2)]
    assert rows(kpi.orders_by_month_name(lines)) == [("January", 2), ("February", 1)]


def test_shares(lines):
    assert set(rows(kpi.share_by_category(lines))) == {("c1", 80.0, dec(80)), ("c2", 20.0, dec(20))}
    assert rows(kpi.share_by_size(lines)) == [
        ("M", dec(40), dec(40)),
        ("S", dec(40), dec(40)),
        ("L", dec(20), dec(20)),
    ]


def test_best_and_worst(lines):
    assert rows(kpi.top_by_revenue(lines, 1)) == [("p", dec(40))]
    assert rows(kpi.top_by_quantity(lines, 1)) == [("p", 5)]
    assert rows(kpi.top_by_orders(lines, 2)) == [("p", 2), ("q", 1)]
    assert rows(kpi.top_by_revenue(lines, 1, ascending=True)) == [("q", dec(20))]
