"""Retention by month of first purchase."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import month_diff, month_start, ratio


def cohort_retention(fact: DataFrame) -> DataFrame:
    """Active customers, revenue and retention per cohort month and months since.

    The fact is folded to one row per customer and month. The first month of a
    customer is then a window minimum over those few rows, and an active
    customer is one row, so neither the self-join nor a distinct count is needed.
    """
    active = (
        fact.filter(F.col("order_date").isNotNull() & F.col("customer_key").isNotNull())
        .groupBy("customer_key", month_start("order_date").alias("_month"))
        .agg(F.sum("sales_amount").alias("_revenue"))
        .withColumn("cohort_month", F.min("_month").over(Window.partitionBy("customer_key")))
    )
    cohorts = active.groupBy(
        "cohort_month", month_diff("cohort_month", "_month").alias("months_since_acquisition")
    ).agg(F.count(F.lit(1)).alias("active_customers"), F.sum("_revenue").alias("cohort_revenue"))
    size = F.first("active_customers").over(Window.partitionBy("cohort_month").orderBy("months_since_acquisition"))
    return cohorts.withColumn(
        "retention_rate_pct", F.round(ratio("active_customers", size) * 100, 2)
    ).orderBy("cohort_month", "months_since_acquisition")
