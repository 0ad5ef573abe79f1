"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.plans.materialize import drop, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every node's neighbours (the larger ones, or the smaller ones and itself) on its smallest neighbour.

    The minimum is aggregated before the edges meet it, so a hub's edges never
    stand together in one task unless Spark's join finds that small enough.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least, "u")
    if large:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    hung = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``: the smallest node it is connected with.

    Nulls and loops are left out. Each round is written to the shared folder, so
    lineage stays short and a lost executor costs one round; the round before is then
    deleted. Rounds grow with the logarithm of the longest chain.
    """
    edges = materialize(edges.select("u", "v").where("u is not null and v is not null and u != v").distinct())
    seen = None
    while True:
        before = edges
        edges = materialize(_stars(_stars(edges, large=True).where("u != v"), large=False).where("u != v"))
        drop(before)
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
