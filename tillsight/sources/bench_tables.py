"""The model's tables, mapped from the TPC-H-like Parquet files (see FIXTURES.md).

The files are cleaner than real data, so fixed modulo rules plant broken keys,
NULL dates, zero quantities and customers without orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.sources.schemas import DIM_CUSTOMERS

# Reporting date of all registered queries.
AS_OF = "2002-01-01"

CUSTOMER_COLUMNS = DIM_CUSTOMERS.fieldNames()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact_sales(spark: SparkSession, sf_dir: str, with_price: bool = False) -> DataFrame:
    """All order lines. The unit price needs one more join, so it is read on request.

    Customers without orders and customers of a single year come about by moving
    orders to a neighbouring customer and to another date; no line is left out.
    """
    placed = F.col("o_custkey")
    customer = F.when(placed % 25 == 24, placed - 1).otherwise(placed)
    day = F.col("o_orderdate").cast("date")
    moved = F.make_date(F.lit(1998), F.month(day), F.least(F.day(day), F.lit(28)))
    orders = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"),
        F.when(F.col("o_orderkey") % 223 == 0, F.lit(-1).cast("bigint")).otherwise(customer).alias("customer_key"),
        F.when(F.col("o_orderkey") % 101 != 0, F.when(customer % 7 == 0, moved).otherwise(day)).alias("order_date"),
    )
    lines = _table(spark, sf_dir, "lineitem")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    columns = [
        F.concat(F.lit("SO"), F.col("l_orderkey").cast("string")).alias("order_number"),
        F.when(F.col("l_partkey") % 97 == 0, -F.col("l_partkey") - 1)
        .otherwise(F.col("l_partkey"))
        .alias("product_key"),
        F.col("customer_key"),
        F.col("order_date"),
        F.when(F.col("l_orderkey") % 307 == 0, F.lit(0)).otherwise(F.col("l_quantity").cast("int")).alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("sales_amount"),
    ]
    if with_price:
        part = _table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
        joined = joined.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        columns.append(F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    return joined.select(*columns)


def dim_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return (
        _customers(spark, sf_dir)
        .join(nation, F.col("_nation") == F.col("n_nationkey"), "left")
        .select(*CUSTOMER_COLUMNS)
    )


def dim_customers_without_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For analyses that do not read the country, which costs a join."""
    return _customers(spark, sf_dir).select(*[c for c in CUSTOMER_COLUMNS if c != "country"])


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    born = F.date_add(F.lit("1950-01-01").cast("date"), ((key * 37) % 20000).cast("int"))
    return _table(spark, sf_dir, "customer").select(
        key.alias("customer_key"),
        key.alias("customer_id"),
        F.col("c_name").alias("customer_number"),
        F.substring("c_name", 1, 8).alias("first_name"),
        F.when(key % 41 != 0, F.substring("c_name", 10, 9)).alias("last_name"),
        F.when(key % 3 == 0, "Male").when(key % 3 == 1, "Female").otherwise("n/a").alias("gender"),
        F.when(key % 53 != 0, born).alias("birthdate"),
        F.col("c_nationkey").alias("_nation"),
    )


def dim_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    cost = (
        F.when(key % 59 == 0, F.lit(None).cast("decimal(18,2)"))
        .when(key % 4 == 0, size.cast("decimal(18,2)"))
        .when(key % 4 == 1, (size * 10 - F.lit(0.5)).cast("decimal(18,2)"))
        .when(key % 4 == 2, (size * 20).cast("decimal(18,2)"))
        .otherwise(F.col("p_retailprice").cast("decimal(18,2)"))
    )
    return _table(spark, sf_dir, "part").select(
        key.alias("product_key"),
        key.alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        cost.alias("cost"),
    )


def pizza_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"))
    size = F.col("p_size")
    part = _table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_name").alias("pizza_name"),
        F.col("p_type").alias("pizza_category"),
        F.when(size <= 10, "S").when(size <= 25, "M").when(size <= 40, "L").when(size > 40, "XL").alias("pizza_size"),
    )
    return (
        _table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .select(
            F.col("l_orderkey").alias("order_id"),
            "order_date",
            "pizza_name",
            "pizza_category",
            "pizza_size",
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("total_price"),
        )
    )


def er_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    visit = F.col("event_id")
    return _table(spark, sf_dir, "events").select(
        visit.alias("visit_id"),
        F.col("user_id").alias("patient_id"),
        F.col("ts").alias("arrival_ts"),
        F.when(visit % 10 != 0, F.col("event_type")).alias("department"),
        F.col("value").alias("wait_minutes"),
        F.when(visit % 4 != 0, F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 11).alias("satisfaction"),
    )


def food_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = _table(spark, sf_dir, "region")
    return (
        _table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .withColumns({"city": F.col("n_name"), "state": F.col("r_name"), "restaurant": F.col("c_mktsegment")})
        .select(*_order_columns()[:2], "city", "state", "restaurant", *_order_columns()[2:])
    )


def food_orders_without_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For analyses that read neither place nor restaurant, which cost three joins."""
    return _table(spark, sf_dir, "orders").select(*_order_columns())


def _order_columns() -> list[Column]:
    order = F.col("o_orderkey")
    return [
        order.alias("order_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderpriority").alias("category"),
        F.when(order % 3 == 0, "Non-Veg").otherwise("Veg").alias("diet"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.when(order % 11 != 0, (10 + order % 41).cast("double") / 10).alias("rating"),
    ]


def raw_food_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Food orders as an untyped import: padded text, blanks, bad numbers, repeated rows."""
    order = F.col("o_orderkey")
    text = _table(spark, sf_dir, "orders").select(
        F.concat(F.lit(" "), order.cast("string")).alias("order_id"),
        F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit(" ")).alias("order_date"),
        F.when(order % 19 == 0, F.lit("   "))
        .otherwise(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")))
        .alias("category"),
        F.when(order % 23 == 0, F.lit("n/a"))
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
        .alias("amount"),
        order.alias("_order"),
    )
    repeated = text.filter(F.col("_order") % 13 == 0)
    return text.unionByName(repeated).drop("_order")


#: The types under which ``exported_orders`` are imported.
EXPORTED_ORDERS = "order_id bigint, order_date date, category string, amount decimal(18,2), note string"


def exported_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a text export: bad numbers, quotes, separators and line breaks inside values."""
    order = F.col("o_orderkey")
    said = F.concat(F.lit('said "'), F.col("o_orderpriority"), F.lit('",\nthen left'))
    return _table(spark, sf_dir, "orders").select(
        order.cast("string").alias("order_id"),
        F.col("o_orderdate").cast("date").cast("string").alias("order_date"),
        F.col("o_orderpriority").alias("category"),
        F.when(order % 23 == 0, F.lit("n/a"))
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
        .alias("amount"),
        F.when(order % 5 == 0, said).otherwise(F.lit("plain")).alias("note"),
    )


def model_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "fact_sales": fact_sales(spark, sf_dir, with_price=True),
        "dim_customers": dim_customers(spark, sf_dir),
        "dim_products": dim_products(spark, sf_dir),
        "pizza_sales": pizza_sales(spark, sf_dir),
        "er_visits": er_visits(spark, sf_dir),
        "food_orders": food_orders(spark, sf_dir),
    }
