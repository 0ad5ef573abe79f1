"""Every registered query against DuckDB, identities between queries, and plan shapes."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest

from __spark_entry__ import analytics, entry, oracle_sql, queries
from checks.compare import connect, difference
from tests.conftest import rows

QUERIES = analytics()
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLE) and set(ORACLE) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, sf_dir, name):
    assert difference(spark, con, QUERIES[name], ORACLE[name], sf_dir) is None


def test_comparison_notices_differences(spark, con, sf_dir):
    wrong = ORACLE["kpi_total_orders"].replace("count(distinct order_id)", "count(order_id)")
    assert difference(spark, con, QUERIES["kpi_total_orders"], wrong, sf_dir) is not None
    renamed = ORACLE["kpi_total_orders"].replace("as total_order", "as orders_total")
    assert difference(spark, con, QUERIES["kpi_total_orders"], renamed, sf_dir) is not None
    retyped = f"select cast(total_order as double) as total_order from ({ORACLE['kpi_total_orders']})"
    assert difference(spark, con, QUERIES["kpi_total_orders"], retyped, sf_dir) is not None


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_no_order_line_is_left_out(spark, scale):
    from tillsight.sources import bench_tables as t

    folder = f"/root/testdata/{scale}"
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert t.fact_sales(spark, folder).count() == t.pizza_sales(spark, folder).count() == lines


def test_entry(spark):
    assert entry(spark).count() > 0


# ---- identities ----


def test_reports_and_series_agree_on_dated_revenue(spark, sf_dir):
    def cents(name, column):
        return sum(round(r[0] * 100) for r in rows(QUERIES[name](spark, sf_dir), column))

    dated = cents("monthly_sales", "total_sales")
    assert dated == cents("report_customers", "total_sales") == cents("report_products", "total_sales")
    running = rows(QUERIES["running_total_moving_avg"](spark, sf_dir), "running_total_sales")
    assert round(running[-1][0] * 100) == dated


def test_cohort_rates(spark, sf_dir):
    got = QUERIES["cohort_retention"](spark, sf_dir).collect()
    assert all(r["retention_rate_pct"] == 100 for r in got if r["months_since_acquisition"] == 0)
    assert all(0 < r["retention_rate_pct"] <= 100 for r in got)


def test_customers_without_orders_are_the_rest(spark, sf_dir):
    from tillsight.sources import bench_tables as t

    known = t.dim_customers(spark, sf_dir).select("customer_key")
    ordered = t.fact_sales(spark, sf_dir).select("customer_key").distinct().join(known, "customer_key").count()
    never = rows(QUERIES["dq_customers_no_orders"](spark, sf_dir))[0][0]
    assert never == known.count() - ordered > 0


def test_shares_add_up(spark, sf_dir):
    shares = rows(QUERIES["revenue_share_by_category"](spark, sf_dir), "pct_of_total_revenue")
    assert abs(sum(s[0] for s in shares) - 100) < 0.01 * len(shares)


# ---- plans ----


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_existence_checks_are_anti_joins(spark, sf_dir):
    for name in ("dq_customers_no_orders", "dq_sales_no_product"):
        assert "LeftAnti" in plan(QUERIES[name](spark, sf_dir))


def test_top_n_is_not_a_full_sort(spark, sf_dir):
    for name in ("top5_by_revenue", "top_cities"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_rankings_window_only_the_k_values(spark, sf_dir):
    """Below the rank window stands a top-k, never the ranked table itself."""
    text = plan(QUERIES["bottom_customers_by_orders"](spark, sf_dir))
    below = text[text.index("Window [dense_rank") :].splitlines()[1:4]
    assert any("TakeOrderedAndProject" in line for line in below)


def test_distinct_counts_do_not_multiply_rows(spark, sf_dir):
    for name in ("measure_summary", "report_customers", "report_products", "monthly_sales"):
        assert "gid" not in plan(QUERIES[name](spark, sf_dir)), name


def test_scans_read_only_needed_columns(spark, sf_dir):
    text = plan(QUERIES["cohort_retention"](spark, sf_dir))
    assert "p_name" not in text and "l_quantity" not in text
    scan = next(line for line in text.splitlines() if "FileScan" in line and "l_orderkey" in line)
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in scan


def test_no_query_plans_a_cross_join(spark, sf_dir):
    for name, query in QUERIES.items():
        text = plan(query(spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """The star model as Parquet, the way a warehouse keeps it."""
    from tillsight.sources import bench_tables as t
    from tillsight.sources.files import read_table, write_parquet

    folder = tmp_path_factory.mktemp("stored")
    write_parquet(t.fact_sales(spark, sf_dir, with_price=True), f"{folder}/fact_sales")
    write_parquet(t.dim_customers(spark, sf_dir), f"{folder}/dim_customers")
    write_parquet(t.dim_products(spark, sf_dir), f"{folder}/dim_products")
    return {n: read_table(spark, n, f"{folder}/{n}") for n in ("fact_sales", "dim_customers", "dim_products")}


def scans(text, table):
    return [line for line in text.splitlines() if "FileScan" in line and f"{table}]" in line]


def test_date_guard_and_columns_reach_the_stored_fact(stored):
    from tillsight.operators import cohort

    (scan,) = scans(plan(cohort.cohort_retention(stored["fact_sales"])), "fact_sales")
    assert "PushedFilters: [IsNotNull(order_date), IsNotNull(customer_key)]" in scan
    assert "ReadSchema: struct<customer_key:bigint,order_date:date,sales_amount:decimal(18,2)>" in scan


def test_filter_on_a_report_view_reaches_the_stored_fact(spark, stored):
    from tillsight.operators import reports

    reports.register_reports(stored["fact_sales"], stored["dim_customers"], stored["dim_products"], "2002-01-01")
    one = spark.sql("select * from report_customers where customer_key = 5")
    found = scans(plan(one), "fact_sales")
    assert found and all("EqualTo(customer_key,5)" in scan for scan in found)
    every = spark.table("report_customers").filter("customer_key <=> 5")
    assert rows(one) == rows(every) and one.count() == 1


def test_distinct_counts_read_one_column_each(stored):
    from tillsight.operators import exploration

    text = plan(exploration.measure_summary(stored["fact_sales"], stored["dim_customers"], stored["dim_products"]))
    assert sorted(scan.split("ReadSchema: ")[1] for scan in scans(text, "fact_sales")) == [
        "struct<customer_key:bigint>",
        "struct<order_number:string>",
        "struct<product_key:bigint>",
        "struct<sales_amount:decimal(18,2),quantity:int,price:decimal(18,2)>",
    ]
