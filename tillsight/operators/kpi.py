"""KPI cards, order rhythm and shares of a flat order-line table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.functions import month_name, ratio, weekday_name, weekday_number
from tillsight.operators.exploration import revenue_share
from tillsight.operators.ranking import top_n
from tillsight.plans import distinct_count_by, first_n, share_of_total


def _revenue() -> Column:
    return F.sum("total_price")


def _orders() -> Column:
    return F.countDistinct("order_id")


def _units() -> Column:
    return F.sum("quantity")


def _order_value() -> Column:
    return ratio(_revenue(), _orders())


def _items_per_order() -> Column:
    return ratio(_units(), _orders()).cast("decimal(10,2)")


def total_revenue(lines: DataFrame) -> DataFrame:
    return lines.agg(_revenue().alias("total_revenue"))


def avg_order_value(lines: DataFrame) -> DataFrame:
    return lines.agg(_order_value().alias("average_order"))


def total_quantity(lines: DataFrame) -> DataFrame:
    return lines.agg(_units().alias("total_pizza_sold"))


def total_orders(lines: DataFrame) -> DataFrame:
    return lines.agg(_orders().alias("total_order"))


def items_per_order(lines: DataFrame) -> DataFrame:
    return lines.agg(_items_per_order().alias("average_pizza_sold"))


def kpi_cards(lines: DataFrame) -> DataFrame:
    """All five cards in one row and one pass."""
    return lines.agg(
        _revenue().alias("total_revenue"),
        _order_value().alias("average_order"),
        _units().alias("total_pizza_sold"),
        _orders().alias("total_order"),
        _items_per_order().alias("average_pizza_sold"),
    )


def orders_by_weekday(lines: DataFrame, week_start: str = "sunday") -> DataFrame:
    """Distinct orders per weekday, in week order."""
    return (
        lines.groupBy(weekday_number("order_date", week_start).alias("_day"))
        .agg(_orders().alias("total_order"))
        .orderBy("_day")
        .select(weekday_name("_day", week_start).alias("order_day"), "total_order")
    )


def orders_by_month_name(lines: DataFrame) -> DataFrame:
    """Distinct orders per month of the year, all years together, January first."""
    return (
        lines.groupBy(F.month("order_date").alias("_month"))
        .agg(_orders().alias("total_order"))
        .orderBy("_month")
        .select(month_name("_month").alias("order_month"), "total_order")
    )


def share_by_category(lines: DataFrame) -> DataFrame:
    """Unrounded percentage of revenue and revenue per category."""
    shares = revenue_share(lines, "pizza_category", "total_price", pct="pct", digits=None)
    return shares.select("pizza_category", "pct", "total_sales")


def share_by_size(lines: DataFrame) -> DataFrame:
    """Percentage of revenue with two digits and revenue per size, largest first."""
    totals = lines.groupBy("pizza_size").agg(_revenue().alias("total_sales"))
    return totals.select(
        "pizza_size", share_of_total(totals, "total_sales").cast("decimal(10,2)").alias("pct"), "total_sales"
    ).orderBy(F.desc("pct"), "pizza_size")


def top_by_revenue(lines: DataFrame, n: int = 5, ascending: bool = False) -> DataFrame:
    return top_n(lines, "pizza_name", _revenue(), "total_revenue", n, ascending)


def top_by_quantity(lines: DataFrame, n: int = 5, ascending: bool = False) -> DataFrame:
    return top_n(lines, "pizza_name", _units(), "total_quantity", n, ascending)


def top_by_orders(lines: DataFrame, n: int = 5, ascending: bool = False) -> DataFrame:
    orders = distinct_count_by(lines, "pizza_name", "order_id", "total_order")
    return first_n(orders, "total_order", n, ["pizza_name"], ascending)
