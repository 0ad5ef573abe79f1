"""The customer and the product report: one row per entity with its measures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight import labels
from tillsight.functions import as_of_date, blank_concat, first_matching_band, month_diff, ratio, year_diff
from tillsight.operators.segments import customer_segment
from tillsight.plans import distinct_by_group
from tillsight.sources.files import register_views


def age_group(age: Column, cuts: tuple[int, int, int, int] = labels.AGE_CUTS) -> Column:
    """Gapless age bands; an unknown age falls into the last one."""
    edges = list(zip(cuts, cuts[1:]))
    bands = [(age < cuts[0], f"UNDER {cuts[0]}")]
    bands += [(age.between(low, high - 1), f"{low}-{high - 1}") for low, high in edges]
    return first_matching_band(bands, f"{cuts[-1]}+")


def product_tier(sales: Column, high: float = labels.HIGH_SALES, mid: float = labels.MID_SALES) -> Column:
    return first_matching_band(
        [(sales > high, labels.HIGH_PERFORMER), (sales >= mid, labels.MID_PERFORMER)], labels.LOW_PERFORMER
    )


def _spread_over_lifespan() -> Column:
    """Sales per month of lifespan; a single-month lifespan keeps the total."""
    sales, months = F.col("total_sales").cast("double"), F.col("lifespan_months")
    return F.when(months == 0, sales).otherwise(ratio(sales, months))


def report_customers(
    fact: DataFrame,
    customers: DataFrame,
    as_of: dt.date | str | Column | None = None,
    min_months: int = labels.MIN_MONTHS,
    vip_spend: float = labels.VIP_SPEND,
    age_cuts: tuple[int, int, int, int] = labels.AGE_CUTS,
) -> DataFrame:
    """One row per customer with dated sales; sales of unknown customers share one row."""
    today = as_of_date(as_of)
    dated = fact.filter(F.col("order_date").isNotNull()).select(
        "customer_key", "order_number", "product_key", "order_date", "quantity", "sales_amount"
    )
    keys = customers.select(F.col("customer_key").alias("_member"), F.col("customer_key").alias("_group"))
    totals = distinct_by_group(
        dated,
        "customer_key",
        keys,
        {
            "total_sales": (F.sum, "sales_amount"),
            "total_quantity": (F.sum, "quantity"),
            "first_order_date": (F.min, "order_date"),
            "last_order_date": (F.max, "order_date"),
        },
        {"total_orders": "order_number", "total_products": "product_key"},
        key_is_group=True,
    ).withColumn("lifespan_months", month_diff("first_order_date", "last_order_date"))
    attributes = customers.select(
        F.col("customer_key").alias("_key"),
        "customer_number",
        "first_name",
        "last_name",
        year_diff("birthdate", today).alias("age"),
    )
    return totals.join(attributes, F.col("_group") == F.col("_key"), "left").select(
        F.col("_group").alias("customer_key"),
        "customer_number",
        blank_concat("first_name", "last_name").alias("customer_name"),
        "age",
        age_group(F.col("age"), age_cuts).alias("age_group"),
        customer_segment(F.col("lifespan_months"), F.col("total_sales"), min_months, vip_spend).alias(
            "customer_segment"
        ),
        "total_orders",
        "total_sales",
        "total_quantity",
        "total_products",
        "first_order_date",
        "last_order_date",
        "lifespan_months",
        month_diff("last_order_date", today).alias("recency_months"),
        F.when(F.col("total_orders") == 0, F.lit(0.0))
        .otherwise(ratio("total_sales", "total_orders"))
        .alias("avg_order_value"),
        _spread_over_lifespan().alias("avg_monthly_spend"),
    )


def report_products(
    fact: DataFrame,
    products: DataFrame,
    as_of: dt.date | str | Column | None = None,
    high: float = labels.HIGH_SALES,
    mid: float = labels.MID_SALES,
) -> DataFrame:
    """One row per product with dated sales; sales of unknown products share one row."""
    today = as_of_date(as_of)
    dated = fact.filter(F.col("order_date").isNotNull()).select(
        "product_key", "order_number", "customer_key", "order_date", "quantity", "sales_amount"
    )
    keys = products.select(F.col("product_key").alias("_member"), F.col("product_key").alias("_group"))
    totals = distinct_by_group(
        dated,
        "product_key",
        keys,
        {
            "total_sales": (F.sum, "sales_amount"),
            "total_quantity": (F.sum, "quantity"),
            "first_sale_date": (F.min, "order_date"),
            "last_sale_date": (F.max, "order_date"),
        },
        {"total_orders": "order_number", "total_customers": "customer_key"},
        key_is_group=True,
    ).withColumn("lifespan_months", month_diff("first_sale_date", "last_sale_date"))
    attributes = products.select(
        F.col("product_key").alias("_key"), "product_name", "category", "subcategory", "cost"
    )
    no_units = F.col("total_quantity") == 0
    unit_price = ratio("total_sales", "total_quantity")
    return totals.join(attributes, F.col("_group") == F.col("_key"), "left").select(
        F.col("_group").alias("product_key"),
        "product_name",
        "category",
        "subcategory",
        "cost",
        product_tier(F.col("total_sales"), high, mid).alias("product_performance"),
        "first_sale_date",
        "last_sale_date",
        "lifespan_months",
        month_diff("last_sale_date", today).alias("recency_months"),
        "total_orders",
        "total_customers",
        "total_sales",
        "total_quantity",
        F.when(F.col("total_orders") == 0, F.lit(0.0))
        .otherwise(ratio("total_sales", "total_orders"))
        .alias("avg_order_revenue"),
        _spread_over_lifespan().alias("avg_monthly_revenue"),
        F.when(no_units, F.lit(0.0)).otherwise(F.round(unit_price, 2)).alias("avg_revenue_per_unit"),
        F.when(
            ~no_units | F.col("total_quantity").isNull(),
            F.round(ratio(unit_price - F.col("cost").cast("double"), unit_price) * 100, 2),
        ).alias("estimated_margin_pct"),
    )


def register_reports(
    fact: DataFrame, customers: DataFrame, products: DataFrame, as_of: dt.date | str | Column | None = None
) -> None:
    """Name both reports as views of the session."""
    register_views(
        {
            "report_customers": report_customers(fact, customers, as_of),
            "report_products": report_products(fact, products, as_of),
        }
    )
