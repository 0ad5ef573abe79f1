"""Registered queries and the SQL they are checked against.

Every query runs over whole tables. Money stays decimal inside the operators;
``queries()`` hands it out as double so that both engines return plain numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.oracle import oracle_statements
from tillsight.operators import basket, cohort, dashboard, exploration, kpi, profiling, quality, ranking
from tillsight.operators import reports, segments, timeseries
from tillsight.plans import materialize, new_path
from tillsight.sources import bench_tables as tables
from tillsight.sources import files, model

AS_OF = tables.AS_OF

# Cuts that split the test data at its price level (FIXTURES.md).
VIP_SPEND = 2_000_000
HIGH_SALES = 1_700_000
MID_SALES = 1_400_000

Query = Callable[[SparkSession, str], DataFrame]


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles; everything else unchanged."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _on(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """Feed the named tables to an operator and return its result with plain numbers."""

    def bind(operator: Callable[..., DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain(operator(*[getattr(tables, name)(spark, sf_dir) for name in names]))

        return run

    return bind


_fact = _on("fact_sales")
_customers = _on("dim_customers")
_people = _on("dim_customers_without_country")
_products = _on("dim_products")
_fact_customers = _on("fact_sales", "dim_customers")
_fact_people = _on("fact_sales", "dim_customers_without_country")
_fact_products = _on("fact_sales", "dim_products")
_lines = _on("pizza_sales")
_visits = _on("er_visits")
_food = _on("food_orders")
_orders = _on("food_orders_without_place")


def _table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lookups by a unique key change no count
    lean = {
        "fact_sales": tables.fact_sales(spark, sf_dir),
        "dim_customers": tables.dim_customers_without_country(spark, sf_dir),
        "food_orders": tables.food_orders_without_place(spark, sf_dir),
    }
    return profiling.table_profile(tables.model_tables(spark, sf_dir) | lean)


def _column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.column_profile(tables.model_tables(spark, sf_dir))


def _column_profile_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.column_profile({"dim_customers": tables.dim_customers(spark, sf_dir)}, "dim_customers")


def _measure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploration.measure_summary(
        tables.fact_sales(spark, sf_dir, with_price=True),
        tables.dim_customers_without_country(spark, sf_dir),
        tables.dim_products(spark, sf_dir),
    )


def _clean(raw: DataFrame) -> DataFrame:
    return dashboard.clean_table(raw, {"order_id": "bigint", "order_date": "date", "amount": "decimal(18,2)"})


def _clean_by_key(raw: DataFrame) -> DataFrame:
    types = {"order_id": "bigint", "order_date": "date", "amount": "decimal(18,2)"}
    return dashboard.clean_table(raw, types, key=["category", "order_date"])


def _attach_calendar(fact: DataFrame) -> DataFrame:
    calendar = dashboard.calendar_table(fact, "order_date")
    measures = {"lines": F.count(F.lit(1)), "total_sales": F.sum("sales_amount")}
    return dashboard.attach_calendar(fact, calendar, "order_date", measures)


def _rounded(df: DataFrame) -> DataFrame:
    """Means of doubles, whose last digits depend on the order of addition."""
    means = [f.name for f in df.schema.fields if f.name.startswith("avg_") and f.dataType == T.DoubleType()]
    return df.withColumns({name: F.round(name, 6) for name in means if name not in ("avg_satisfaction", "avg_order_value")})


def _positioned(df: DataFrame) -> DataFrame:
    """A sorted result of a few rows with each row's position, so that its order is compared as well."""
    return df.coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1)


def _merge_tables(fact: DataFrame, customers: DataFrame) -> DataFrame:
    lines = fact.select("order_number", "customer_key", "sales_amount")
    return dashboard.merge_tables(lines, customers.select("customer_key", "country"), "customer_key")


def _append_tables(lines: DataFrame, orders: DataFrame) -> DataFrame:
    counter = lines.select("order_id", "order_date", "quantity", F.lit("counter").alias("channel"))
    delivery = orders.select("order_id", "order_date", "city", F.lit("delivery").alias("channel"))
    return (
        dashboard.append_tables(counter, delivery)
        .groupBy("channel", F.year("order_date").alias("order_year"))
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count("quantity").alias("with_quantity"),
            F.count("city").alias("with_city"),
        )
    )


def _apply_slicers(orders: DataFrame) -> DataFrame:
    months = orders.withColumn("month", F.month("order_date"))
    chosen = {"month": [1, 7], "diet": ["Veg"], "restaurant": ["FURNITURE", "MACHINERY"]}
    return dashboard.sales_by_place(dashboard.apply_slicers(months, chosen), "city")


def _report_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered report view, with the default thresholds."""
    reports.register_reports(
        tables.fact_sales(spark, sf_dir),
        tables.dim_customers_without_country(spark, sf_dir),
        tables.dim_products(spark, sf_dir),
        AS_OF,
    )
    return _plain(
        spark.sql(
            """select customer_key, customer_name, total_orders, total_sales, recency_months
               from report_customers where customer_segment = 'VIP' and age_group = '30-39'"""
        )
    )


def _csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    files.write_csv(tables.exported_orders(spark, sf_dir), path)
    schema = T.StructType.fromDDL(tables.EXPORTED_ORDERS)
    imported = files.read_csv(spark, path, schema, multi_line=True)
    return _plain(
        imported.groupBy("category").agg(
            F.count(F.lit(1)).alias("imported_rows"),
            F.count(files.CORRUPT).alias("corrupt_rows"),
            F.count_if(F.contains("note", F.lit('",\n'))).alias("two_line_notes"),
            F.sum("amount").alias("total_amount"),
        )
    )


def _partitioned_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    fact = tables.fact_sales(spark, sf_dir)
    files.write_parquet(fact.withColumn("order_year", F.year("order_date")), path, partition_by=["order_year"])
    stored = files.read_parquet(spark, path).where("order_year = 1998")
    return _plain(
        stored.groupBy(F.month("order_date").alias("order_month")).agg(
            F.count(F.lit(1)).alias("total_lines"), F.sum("sales_amount").alias("total_sales")
        )
    )


def _permanent_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer report by name, filtered, in another session than the one that saved the model and made the view."""
    database = f"tillsight_{uuid.uuid4().hex}"
    saved = {
        "fact_sales": tables.fact_sales(spark, sf_dir),
        "dim_customers": tables.dim_customers_without_country(spark, sf_dir),
        "dim_products": tables.dim_products(spark, sf_dir),
    }
    model.save_model(spark, saved, database, new_path(spark))
    model.create_report_views(spark, database, AS_OF, products={"high": HIGH_SALES, "mid": MID_SALES})
    other = spark.newSession()
    return _plain(
        other.sql(
            f"""select 'customer' as report, customer_key as key, customer_segment as class, total_orders, total_sales, total_products as others
                from {database}.report_customers where age_group = '30-39'
                union all
                select 'product', product_key, product_performance, total_orders, total_sales, total_customers
                from {database}.report_products where category like 'STANDARD%'"""
        )
    )


def _slice_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales by customer gender, for some quarters, categories and kinds of customers, from a fact stored by month."""
    path = new_path(spark)
    fact = tables.fact_sales(spark, sf_dir).withColumn("order_month", F.trunc("order_date", "month"))
    files.write_parquet(fact, path, partition_by=["order_month"])
    stored = files.read_parquet(spark, path)
    months = dashboard.calendar_table(fact, "order_date").select(
        F.trunc("date", "month").alias("order_month"), F.quarter("date").alias("quarter"), F.year("date").alias("year")
    ).distinct()
    people = tables.dim_customers_without_country(spark, sf_dir)
    sliced = dashboard.slice_model(
        stored,
        [
            (months, "order_month", {"quarter": [1, 3], "year": [1996, 1997]}),
            (tables.dim_products(spark, sf_dir), "product_key", {"subcategory": ["Brand#11", "Brand#23", "Brand#45"]}),
            (people, "customer_key", {"gender": ["Male", "Female"]}),
        ],
    )
    return _plain(
        sliced.join(people.select("customer_key", "gender"), "customer_key")
        .groupBy("gender", F.quarter("order_date").alias("quarter"))
        .agg(F.count(F.lit(1)).alias("total_lines"), F.sum("sales_amount").alias("total_sales"))
    )


def _sketch_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of the fact from sketches by year, those of the last year added to the ones stored before."""
    # stored once, as three passes read it: lines and orders are joined and shuffled once
    fact = materialize(tables.fact_sales(spark, sf_dir)).withColumn("order_year", F.year("order_date"))
    columns = ["order_number", "product_key", "customer_key", "order_date", "quantity", "sales_amount"]
    path = new_path(spark)
    for part in ("order_year < 1998 or order_year is null", "order_year >= 1998"):
        sketches = profiling.column_sketches(fact.where(part), "order_year", columns)
        files.write_parquet(sketches, path, mode="append")
    told = profiling.profile_from_sketches(files.read_parquet(spark, path))
    exact = profiling.column_profile({"fact_sales": fact.select(*columns)}).select(
        F.col("column_name").alias("of"), F.col("distinct_count")
    )
    error = F.abs(F.col("distinct_estimate") - F.col("distinct_count")) / F.greatest("distinct_count", F.lit(1))
    return told.join(exact, F.col("column_name") == F.col("of")).select(
        "column_name", "row_count", "null_count", "distinct_count", (error <= 0.05).alias("estimate_within_5_pct")
    )


def _training_data() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the training-data operators; none where that subpackage is not installed."""
    try:
        import corpus_pipeline
        from tillsight.llm.queries import ORACLE_SQL, QUERIES
    except ModuleNotFoundError as missing:
        if not (missing.name or "").startswith(("tillsight.llm", "corpus_pipeline")):
            raise
        return {}, {}
    pipeline_sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**QUERIES, "pipeline": corpus_pipeline.run}, {**ORACLE_SQL, **pipeline_sql}


def queries() -> dict[str, Query]:
    return analytics() | _training_data()[0]


def analytics() -> dict[str, Query]:
    """The queries of the rest of the package."""
    return {
        # profiles and data quality
        "table_profile": _table_profile,
        "column_profile": _column_profile,
        "column_profile_one": _column_profile_one,
        "sketch_profile": _sketch_profile,
        "dq_null_dates": _fact(lambda f: quality.null_count(f, "order_date", "null_order_dates")),
        "dq_duplicate_orders": _fact(lambda f: quality.duplicate_keys(f, "order_number")),
        "dq_bad_amounts": _fact(
            lambda f: quality.non_positive_count(f, ["sales_amount", "quantity"], "bad_sales_records")
        ),
        "dq_customers_no_orders": _fact_people(
            lambda f, c: quality.unmatched_count(c, f, "customer_key", "customers_with_no_orders")
        ),
        "dq_sales_no_product": _fact_products(
            lambda f, p: quality.unmatched_count(f, p, "product_key", "sales_with_no_product")
        ),
        # exploration
        "distinct_countries": _customers(lambda c: exploration.distinct_values(c, ["country"])),
        "product_hierarchy": _products(
            lambda p: exploration.distinct_values(p, ["category", "subcategory", "product_name"])
        ),
        "date_coverage": _fact(exploration.date_coverage),
        "age_extremes": _people(lambda c: exploration.age_extremes(c, AS_OF)),
        "measure_summary": _measure_summary,
        "customers_by_country": _customers(lambda c: exploration.customers_by(c, "country")),
        "customers_by_gender": _people(lambda c: exploration.customers_by(c, "gender")),
        "products_by_category": _products(lambda p: exploration.products_by(p, "category")),
        "avg_cost_by_category": _products(exploration.avg_cost_by),
        "revenue_share_by_category": _fact_products(exploration.revenue_share_by_category),
        "revenue_per_customer": _fact_people(exploration.revenue_per_customer),
        "quantity_by_country": _fact_customers(exploration.quantity_by_country),
        # rankings with ties
        "top_products": _fact_products(ranking.top_products),
        "bottom_products": _fact_products(ranking.bottom_products),
        "top_customers": _fact_people(ranking.top_customers),
        "bottom_customers_by_orders": _fact_people(ranking.bottom_customers_by_orders),
        # time series and segments
        "monthly_sales": _fact(timeseries.monthly_sales),
        "running_total_moving_avg": _fact(timeseries.running_and_moving),
        "running_by_line": _fact(timeseries.running_by_line),
        "running_by_customer_day": _fact(timeseries.running_by_customer_day),
        "yoy_product_by_name": _fact_products(timeseries.yoy_by_name),
        "category_contribution": _fact_products(exploration.category_contribution),
        "cost_segments": _products(segments.cost_segments),
        "customer_segments": _fact(lambda f: segments.customer_segments(f, vip_spend=VIP_SPEND)),
        "customer_segments_mean_tenure": _fact(
            lambda f: segments.customer_segments(f, vip_spend=VIP_SPEND, tenure_avg="mean")
        ),
        "rfm": _fact(lambda f: segments.rfm(f, AS_OF)),
        "report_customers": _fact_people(lambda f, c: reports.report_customers(f, c, AS_OF, vip_spend=VIP_SPEND)),
        "report_products": _fact_products(
            lambda f, p: reports.report_products(f, p, AS_OF, high=HIGH_SALES, mid=MID_SALES)
        ),
        "yoy_product_by_key": _fact_products(timeseries.yoy_by_key),
        # cohorts and baskets
        "cohort_retention": _fact(cohort.cohort_retention),
        "product_affinity": _fact_products(basket.product_affinity),
        "product_affinity_by_customer": _fact_products(
            lambda f, p: basket.product_affinity(f, p, group="customer_key", block=64)
        ),
        # order-line KPIs
        "kpi_total_revenue": _lines(kpi.total_revenue),
        "kpi_avg_order_value": _lines(kpi.avg_order_value),
        "kpi_total_quantity": _lines(kpi.total_quantity),
        "kpi_total_orders": _lines(kpi.total_orders),
        "kpi_items_per_order": _lines(kpi.items_per_order),
        "kpi_cards": _lines(kpi.kpi_cards),
        "orders_by_weekday": _lines(kpi.orders_by_weekday),
        "orders_by_month_name": _lines(kpi.orders_by_month_name),
        "weekday_positions": _lines(lambda s: _positioned(kpi.orders_by_weekday(s))),
        "month_positions": _lines(lambda s: _positioned(kpi.orders_by_month_name(s))),
        "size_positions": _lines(lambda s: _positioned(kpi.share_by_size(s))),
        "order_trend_day": _lines(lambda s: timeseries.sales_trend(s, "day", amount="total_price")),
        "order_trend_month": _lines(lambda s: timeseries.sales_trend(s, "month", amount="total_price")),
        "share_by_category": _lines(kpi.share_by_category),
        "share_by_size": _lines(kpi.share_by_size),
        "top5_by_revenue": _lines(kpi.top_by_revenue),
        "top5_by_quantity": _lines(kpi.top_by_quantity),
        "top5_by_orders": _lines(kpi.top_by_orders),
        "bottom5_by_revenue": _lines(lambda s: kpi.top_by_revenue(s, ascending=True)),
        "bottom5_by_quantity": _lines(lambda s: kpi.top_by_quantity(s, ascending=True)),
        "bottom5_by_orders": _lines(lambda s: kpi.top_by_orders(s, ascending=True)),
        # import, sinks, model and slicing
        "csv_import": _csv_import,
        "report_view": _report_view,
        "permanent_views": _permanent_views,
        "slice_model": _slice_model,
        "partitioned_sink": _partitioned_sink,
        "clean_table": _on("raw_food_orders")(_clean),
        "clean_table_by_key": _on("raw_food_orders")(_clean_by_key),
        "calendar_table": _orders(lambda o: dashboard.calendar_table(o, "order_date")),
        "attach_calendar": _fact(_attach_calendar),
        "merge_tables": _fact_customers(_merge_tables),
        "merge_counts": _fact_people(lambda f, c: dashboard.merge_counts(f, c, "customer_key")),
        "append_tables": _on("pizza_sales", "food_orders")(_append_tables),
        "apply_slicers": _food(_apply_slicers),
        "pivot_table": _food(
            lambda o: dashboard.pivot_table(o, ["state"], "diet", ["Veg", "Non-Veg"], F.sum("amount"))
        ),
        # emergency room
        "er_kpis": _visits(lambda v: _rounded(dashboard.er_kpis(v))),
        "patients_per_day": _visits(dashboard.daily_peaks),
        "wait_by_department": _visits(lambda v: _rounded(dashboard.wait_by(v, ["department"]))),
        "wait_by_day": _visits(
            lambda v: _rounded(dashboard.wait_by(v, [F.col("arrival_ts").cast("date").alias("visit_date")]))
        ),
        "satisfaction_by_wait_band": _visits(dashboard.satisfaction_by_wait_band),
        "department_referrals": _visits(dashboard.department_referrals),
        "orders_by_hour": _visits(lambda v: dashboard.orders_by_hour(v, "arrival_ts")),
        # food delivery
        "food_kpis": _orders(lambda o: _rounded(dashboard.food_kpis(o))),
        "sales_trend_day": _orders(lambda o: timeseries.sales_trend(o, "day")),
        "sales_trend_week": _orders(lambda o: timeseries.sales_trend(o, "week")),
        "sales_trend_month": _orders(lambda o: timeseries.sales_trend(o, "month")),
        "sales_by_city": _food(lambda o: dashboard.sales_by_place(o, "city")),
        "sales_by_state": _food(lambda o: dashboard.sales_by_place(o, "state")),
        "sales_by_food_category": _orders(lambda o: dashboard.sales_by_place(o, "category")),
        "diet_distribution": _orders(dashboard.diet_distribution),
        "top_cities": _food(dashboard.top_cities),
        "weekend_share": _orders(dashboard.weekend_share),
        "weekend_share_fri_sat": _orders(lambda o: dashboard.weekend_share(o, weekend_days=(6, 7))),
    }


def oracle_sql() -> dict[str, str]:
    return oracle_statements() | _training_data()[1]


def entry(spark: SparkSession) -> DataFrame:
    return queries()["rfm"](spark, "/root/testdata/sf0.001")
