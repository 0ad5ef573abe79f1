"""Products bought together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.plans import distinct_lines, first_n, top_label_pairs


def product_affinity(
    fact: DataFrame, products: DataFrame, n: int = 20, block: int = 512, group: str = "order_number"
) -> DataFrame:
    """The ``n`` product-name pairs that share most lines of an order, or of another ``group`` such as the customer.

    Pairs are formed by key, lower key first, and counted by name, so keys that
    share a name can pair with each other. Keys without a product have no name.
    """
    lines = distinct_lines(fact, group, "product_key")
    names = products.select(F.col("product_key").alias("_item"), F.col("product_name").alias("_label"))
    counted = top_label_pairs(lines, names, n, block).select(
        F.col("label_a").alias("product_a"),
        F.col("label_b").alias("product_b"),
        F.col("times").alias("times_bought_together"),
    )
    return first_n(counted, "times_bought_together", n, ["product_a", "product_b"])
