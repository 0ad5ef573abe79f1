"""Sales over time and year-over-year comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight import labels
from tillsight.functions import first_matching_band, month_name, ratio
from tillsight.plans import roll_up
from tillsight.plans.running import running_over_rows


def _period(grain: str, column: str) -> Column:
    if grain not in ("day", "week", "month", "quarter", "year"):
        raise ValueError(f"unknown grain {grain!r}")
    return F.date_trunc(grain, F.col(column)).cast("date") if grain == "day" else F.trunc(column, grain)


def monthly_sales(fact: DataFrame) -> DataFrame:
    """Revenue, distinct customers and items per calendar month, in calendar order."""
    return (
        fact.filter(F.col("order_date").isNotNull())
        .groupBy(F.year("order_date").alias("year_name"), F.month("order_date").alias("_month"))
        .agg(
            F.sum("sales_amount").alias("total_sales"),
            F.countDistinct("customer_key").alias("total_customers"),
            F.sum("quantity").alias("total_items"),
        )
        .orderBy("year_name", "_month")
        .select("year_name", month_name("_month").alias("month_name"), "total_sales", "total_customers", "total_items")
    )


def running_and_moving(fact: DataFrame, grain: str = "month", window: int = 3) -> DataFrame:
    """Running total and moving mean over the periods that have sales.

    The window has no partition, but it runs on one row per period, which the
    calendar bounds.
    """
    per_period = (
        fact.filter(F.col("order_date").isNotNull())
        .groupBy(_period(grain, "order_date").alias("date"))
        .agg(F.sum("sales_amount").alias("total_sales"))
    )
    in_order = Window.orderBy("date")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    recent = in_order.rowsBetween(1 - window, Window.currentRow)
    return per_period.select(
        "date",
        "total_sales",
        F.sum("total_sales").over(so_far).alias("running_total_sales"),
        ratio(F.sum("total_sales").over(recent), F.count("total_sales").over(recent)).alias(
            f"moving_avg_{window}{grain[0]}"
        ),
    ).orderBy("date")


def running_by_line(fact: DataFrame, window: int = 3) -> DataFrame:
    """Running total and moving mean over dated order lines, by date, order, product and the rest of the line, NULLs last."""
    lines = fact.filter(F.col("order_date").isNotNull()).select(
        "order_date", "order_number", "product_key", "customer_key", "quantity", "sales_amount"
    )
    return running_over_rows(
        lines, lines.columns, "sales_amount", "running_total_sales", f"moving_avg_{window}", window, nulls_last=True
    )


def running_by_customer_day(fact: DataFrame, window: int = 3) -> DataFrame:
    """Running total and moving mean over the sales of each customer and day, by day and customer."""
    per_day = (
        fact.filter(F.col("order_date").isNotNull())
        .groupBy("order_date", "customer_key")
        .agg(F.sum("sales_amount").alias("total_sales"))
    )
    order = ["order_date", "customer_key"]
    return running_over_rows(per_day, order, "total_sales", "running_total_sales", f"moving_avg_{window}", window)


def _yearly_sales(fact: DataFrame, products: DataFrame, by: list[str]) -> DataFrame:
    dated = fact.filter(F.col("order_date").isNotNull())
    return roll_up(
        dated,
        products,
        "product_key",
        by,
        {"total_sales": "sales_amount"},
        also_by={"order_year": F.year("order_date")},
    )


def _change_pct() -> Column:
    sales, prior = F.col("total_sales"), F.col("_prior")
    return F.round(ratio((sales - prior) * 100, prior), 2)


def yoy_by_name(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Yearly sales per product name against its own mean and the year before.

    The year before is the previous year with sales. A first year counts as
    growth from zero, with no percentage.
    """
    yearly = _yearly_sales(fact, products, ["product_name"])
    whole = Window.partitionBy("product_name")
    by_year = whole.orderBy("order_year")
    sales, prior, change = F.col("total_sales"), F.col("prior_year_sales"), F.col("yoy_change_abs")
    # sales against the mean, multiplied out so that equality is exact
    scaled = sales * F.col("_years")
    return (
        yearly.withColumns(
            {
                "_all": F.sum("total_sales").over(whole),
                "_years": F.count("total_sales").over(whole),
                "_prior": F.lag("total_sales", 1).over(by_year),
                "prior_year_sales": F.lag("total_sales", 1, 0).over(by_year),
            }
        )
        .withColumns({"avg_sales": ratio("_all", "_years"), "yoy_change_abs": sales - prior})
        .select(
            "product_name",
            "order_year",
            "total_sales",
            "avg_sales",
            (sales.cast("double") - F.col("avg_sales")).alias("diff_vs_avg"),
            first_matching_band(
                [(scaled > F.col("_all"), labels.ABOVE_AVG), (scaled < F.col("_all"), labels.BELOW_AVG)], labels.AT_AVG
            ).alias("avg_performance_flag"),
            "prior_year_sales",
            "yoy_change_abs",
            _change_pct().alias("yoy_change_pct"),
            first_matching_band(
                [(change > 0, labels.INCREASING), (change < 0, labels.DECREASING)], labels.NO_CHANGE
            ).alias("yoy_direction"),
        )
        .orderBy("product_name", "order_year")
    )


def yoy_by_key(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Yearly sales per product key against the previous year with sales; first years are marked."""
    yearly = _yearly_sales(fact, products, ["product_key", "product_name", "category"])
    by_year = Window.partitionBy("product_key").orderBy("order_year")
    sales, prior, change = F.col("total_sales"), F.col("_prior"), F.col("yoy_change_abs")
    return (
        yearly.withColumns(
            {
                "_prior": F.lag("total_sales", 1).over(by_year),
                "_prior_or_zero": F.lag("total_sales", 1, 0).over(by_year),
            }
        )
        .withColumn("yoy_change_abs", sales - F.col("_prior_or_zero"))
        .select(
            "product_key",
            "product_name",
            "category",
            "order_year",
            "total_sales",
            prior.alias("prior_year_sales"),
            "yoy_change_abs",
            _change_pct().alias("yoy_change_pct"),
            first_matching_band(
                [(prior.isNull(), labels.FIRST_YEAR), (change > 0, labels.GROWING), (change < 0, labels.DECLINING)],
                labels.FLAT,
            ).alias("yoy_direction"),
        )
        .orderBy("product_name", "order_year", "product_key")
    )


def yoy(fact: DataFrame, products: DataFrame, entity: str = "product_name") -> DataFrame:
    """``yoy_by_name`` or ``yoy_by_key``; their columns and first-year rules differ."""
    return {"product_name": yoy_by_name, "product_key": yoy_by_key}[entity](fact, products)


def sales_trend(
    orders: DataFrame, grain: str = "month", date_col: str = "order_date", amount: str = "amount"
) -> DataFrame:
    """Sales and distinct orders per day, week (from Monday), month, quarter or year."""
    return (
        orders.groupBy(_period(grain, date_col).alias("period"))
        .agg(F.sum(amount).alias("total_sales"), F.countDistinct("order_id").alias("total_orders"))
        .orderBy("period")
    )
