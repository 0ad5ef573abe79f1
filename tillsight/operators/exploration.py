"""Dimension values, date spans, headline measures and magnitudes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight import labels
from tillsight.functions import as_of_date, blank_concat, exact_mean, month_diff, pct_text, year_diff
from tillsight.plans import roll_up, share_of_total


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)


def date_coverage(fact: DataFrame) -> DataFrame:
    """First and last order date and the years and months between them."""
    oldest, latest = F.col("oldest_order_date"), F.col("latest_order_date")
    return fact.agg(
        F.min("order_date").alias("oldest_order_date"), F.max("order_date").alias("latest_order_date")
    ).select(
        oldest,
        latest,
        year_diff(oldest, latest).alias("year_duration"),
        month_diff(oldest, latest).alias("month_duration"),
    )


def age_extremes(customers: DataFrame, as_of: dt.date | str | Column | None = None) -> DataFrame:
    today = as_of_date(as_of)
    return customers.agg(
        F.max("birthdate").alias("youngest_birthdate"), F.min("birthdate").alias("oldest_birthdate")
    ).select(
        "youngest_birthdate",
        year_diff("youngest_birthdate", today).alias("youngest_age"),
        "oldest_birthdate",
        year_diff("oldest_birthdate", today).alias("oldest_age"),
    )


def measure_summary(fact: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Nine headline measures as (measure_name, measure_value) rows.

    The sums and means of the fact share one pass. Each distinct count is an
    aggregate of its own that reads one column: in a single aggregate the three
    counts would make Spark write every fact row four times.
    """

    def distinct(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.agg(F.countDistinct(column).cast("double").alias(name))

    measures = [
        fact.agg(
            F.sum("sales_amount").cast("double").alias(labels.TOTAL_SALES),
            F.sum("quantity").cast("double").alias(labels.TOTAL_QUANTITY),
            exact_mean("sales_amount").alias(labels.AVERAGE_ORDER_VALUE),
            exact_mean("price").alias(labels.AVERAGE_UNIT_PRICE),
        ),
        distinct(fact, "order_number", labels.TOTAL_ORDERS),
        distinct(products, "product_key", labels.PRODUCTS_IN_DIMENSION),
        distinct(fact, "product_key", labels.PRODUCTS_SOLD),
        distinct(customers, "customer_key", labels.CUSTOMERS_IN_DIMENSION),
        distinct(fact, "customer_key", labels.CUSTOMERS_ORDERED),
    ]
    return reduce(DataFrame.unionByName, [m.unpivot([], m.columns, "measure_name", "measure_value") for m in measures])


def magnitude(df: DataFrame, by: str, measure: Column, name: str) -> DataFrame:
    """One aggregate per group, largest first."""
    return df.groupBy(by).agg(measure.alias(name)).orderBy(F.desc(name), F.asc(by))


def customers_by(customers: DataFrame, by: str) -> DataFrame:
    return magnitude(customers, by, F.count("customer_key"), "total_customers")


def products_by(products: DataFrame, by: str) -> DataFrame:
    return magnitude(products, by, F.count("product_key"), "total_products")


def avg_cost_by(products: DataFrame, by: str = "category") -> DataFrame:
    return magnitude(products, by, exact_mean("cost"), "avg_cost")


def quantity_by_country(fact: DataFrame, customers: DataFrame) -> DataFrame:
    return roll_up(fact, customers, "customer_key", ["country"], {"total_items_sold": "quantity"}).orderBy(
        F.desc("total_items_sold"), "country"
    )


def revenue_per_customer(fact: DataFrame, customers: DataFrame) -> DataFrame:
    return customer_revenue(fact, customers).orderBy(F.desc("total_revenue"), "customer_id")


def customer_revenue(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue per customer id and name, unordered."""
    totals = roll_up(
        fact,
        customers,
        "customer_key",
        ["customer_id", "first_name", "last_name"],
        {"total_revenue": "sales_amount"},
    )
    return totals.select("customer_id", blank_concat("first_name", "last_name").alias("customer_name"), "total_revenue")


def revenue_share(
    df: DataFrame,
    by: str,
    amount: str,
    total: str = "total_sales",
    pct: str = "pct_of_total",
    digits: int | None = 2,
    as_text: bool = False,
) -> DataFrame:
    """Sum per group and its percentage of the grand total, largest first.

    ``digits=None`` leaves the percentage unrounded; ``as_text`` adds it as text.
    """
    return _with_share(df.groupBy(by).agg(F.sum(amount).alias(total)), by, total, pct, digits, as_text)


def _with_share(
    totals: DataFrame, by: str, total: str, pct: str, digits: int | None = 2, as_text: bool = False
) -> DataFrame:
    share = share_of_total(totals, total)
    result = totals.withColumn(pct, share if digits is None else F.round(share, digits))
    if as_text:
        result = result.withColumn(f"{pct}_formatted", pct_text(pct))
    return result.orderBy(F.desc(total), by)


def revenue_share_by_category(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue per category and its share of all revenue, in percent with two digits."""
    totals = roll_up(fact, products, "product_key", ["category"], {"cat_revenue": "sales_amount"})
    return _with_share(totals, "category", "cat_revenue", "pct_of_total_revenue")


def category_contribution(fact: DataFrame, products: DataFrame) -> DataFrame:
    """The share per category as a number and as text."""
    totals = roll_up(fact, products, "product_key", ["category"], {"cat_sales": "sales_amount"})
    return _with_share(totals, "category", "cat_sales", "pct_of_total", as_text=True)
