"""Schemas of the star model and of the flat operational tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


FACT_SALES = _schema(
    ("order_number", T.StringType()),
    ("product_key", T.LongType()),
    ("customer_key", T.LongType()),
    ("order_date", T.DateType()),
    ("sales_amount", MONEY),
    ("quantity", T.IntegerType()),
    ("price", MONEY),
)

DIM_CUSTOMERS = _schema(
    ("customer_key", T.LongType()),
    ("customer_id", T.LongType()),
    ("customer_number", T.StringType()),
    ("first_name", T.StringType()),
    ("last_name", T.StringType()),
    ("country", T.StringType()),
    ("gender", T.StringType()),
    ("birthdate", T.DateType()),
)

DIM_PRODUCTS = _schema(
    ("product_key", T.LongType()),
    ("product_id", T.LongType()),
    ("product_name", T.StringType()),
    ("category", T.StringType()),
    ("subcategory", T.StringType()),
    ("cost", MONEY),
)

PIZZA_SALES = _schema(
    ("order_id", T.LongType()),
    ("order_date", T.DateType()),
    ("pizza_name", T.StringType()),
    ("pizza_category", T.StringType()),
    ("pizza_size", T.StringType()),
    ("quantity", T.IntegerType()),
    ("total_price", MONEY),
)

ER_VISITS = _schema(
    ("visit_id", T.LongType()),
    ("patient_id", T.LongType()),
    ("arrival_ts", T.TimestampNTZType()),
    ("department", T.StringType()),
    ("wait_minutes", T.DoubleType()),
    ("satisfaction", T.IntegerType()),
)

FOOD_ORDERS = _schema(
    ("order_id", T.LongType()),
    ("order_date", T.DateType()),
    ("city", T.StringType()),
    ("state", T.StringType()),
    ("restaurant", T.StringType()),
    ("category", T.StringType()),
    ("diet", T.StringType()),
    ("amount", MONEY),
    ("rating", T.DoubleType()),
)

TABLES: dict[str, T.StructType] = {
    "fact_sales": FACT_SALES,
    "dim_customers": DIM_CUSTOMERS,
    "dim_products": DIM_PRODUCTS,
    "pizza_sales": PIZZA_SALES,
    "er_visits": ER_VISITS,
    "food_orders": FOOD_ORDERS,
}
