"""Best and worst products, customers and places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.functions import blank_concat
from tillsight.operators.exploration import customer_revenue
from tillsight.plans import dense_rank_top, distinct_by_group, first_n, roll_up


def top_n(
    df: DataFrame,
    by: str,
    measure: Column,
    name: str,
    n: int = 5,
    ascending: bool = False,
    tiebreak: Sequence[str] | None = None,
) -> DataFrame:
    """Exactly ``n`` groups by an aggregate; equal values go by ``tiebreak``, the group itself by default."""
    return first_n(df.groupBy(by).agg(measure.alias(name)), name, n, tiebreak or [by], ascending)


def _ranked_products(fact: DataFrame, products: DataFrame, k: int, ascending: bool) -> DataFrame:
    revenue = roll_up(fact, products, "product_key", ["product_name"], {"total_revenue": "sales_amount"})
    return dense_rank_top(revenue, "total_revenue", k, "product_rank", ascending)


def top_products(fact: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    return _ranked_products(fact, products, k, ascending=False)


def bottom_products(fact: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    return _ranked_products(fact, products, k, ascending=True)


def top_customers(fact: DataFrame, customers: DataFrame, k: int = 10) -> DataFrame:
    return dense_rank_top(customer_revenue(fact, customers), "total_revenue", k, "customer_rank")


def bottom_customers_by_orders(fact: DataFrame, customers: DataFrame, k: int = 3) -> DataFrame:
    """Customers with the fewest distinct orders. At scale most customers may tie here.

    Keys that share id and names are one customer; orders of unknown customers count as those of one.
    """
    names = ("customer_id", "first_name", "last_name")
    known = customers.select(F.col("customer_key").alias("_member"), F.struct(*names).alias("_group"))
    orders = distinct_by_group(
        fact.select("customer_key", "order_number"), "customer_key", known, {}, {"total_orders": "order_number"}
    ).select(
        "_group.customer_id", blank_concat("_group.first_name", "_group.last_name").alias("customer_name"), "total_orders"
    )
    return dense_rank_top(orders, "total_orders", k, "order_rank", ascending=True)
