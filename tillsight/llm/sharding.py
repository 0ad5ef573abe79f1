"""Reproducible shuffle and shards by a Feistel permutation of global row numbers. Spark expressions only.

A row's number comes from a fixed order of its key columns; the permutation then
gives its place in the shuffle, ``place mod shards`` its shard and ``place div
shards`` its slot. Given the row count and the seed, any engine can compute where
a row number went, and no table of places is needed to find it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillsight.plans.materialize import materialize

#: Parts of the numbering. Their counts, one row each, are all that is ever broadcast.
PARTS = 4096
ROUNDS = 4


def _sides(rows: int) -> tuple[int, int]:
    """A grid just larger than ``rows``: fewer than ``a`` of its cells are beyond them."""
    a = math.isqrt(max(rows - 1, 0)) + 1
    return a, max(1, -(-rows // a))


def permute(x: Column, rows: int, seed: int) -> Column:
    """One pass of a mixed-radix Feistel network over the cells ``0 .. a*b-1``."""
    a, b = _sides(rows)

    def turn(state: Column, key: Column) -> Column:
        left = (state["l"] + F.pmod(F.xxhash64(state["r"], key), F.lit(a).cast("bigint"))) % a
        right = (state["r"] + F.pmod(F.xxhash64(left, key), F.lit(b).cast("bigint"))) % b
        return F.struct(left.alias("l"), right.alias("r"))

    keys = F.array(*[F.lit(seed * 1_000_003 + k).cast("bigint") for k in range(ROUNDS)])
    start = F.struct((x % a).alias("l"), F.floor(x / a).cast("bigint").alias("r"))
    return F.aggregate(keys, start, turn, lambda s: s["r"] * a + s["l"])


def _walk(x: Column, rows: int, seed: int, steps: int) -> Column:
    """``x``, permuted again while it is beyond the rows, ``steps`` times at most."""
    again = F.sequence(F.lit(1), F.lit(steps))
    return F.aggregate(again, x, lambda at, _: F.when(at >= rows, permute(at, rows, seed)).otherwise(at))


def walk_steps(spark: SparkSession, rows: int, seed: int) -> int:
    """Steps that bring every cell beyond the rows back that a row can come to.

    Such a cell is entered from the rows and left towards them; cycles that lie
    beyond the rows as a whole are entered by none. All cells beyond the rows, fewer
    than ``sqrt(rows) + 1``, are looked at.
    """
    a, b = _sides(rows)
    if a * b <= rows:
        return 1
    beyond = spark.range(rows, a * b)
    after = {r["id"]: r["to"] for r in beyond.select("id", permute(F.col("id"), rows, seed).alias("to")).collect()}
    longest = 1
    for at in set(after) - set(after.values()):  # entered from the rows; the chains have no cell in common
        steps = 1
        while (at := after[at]) in after:
            steps += 1
        longest = max(longest, steps)
    return longest


def place(spark: SparkSession, number: Column, rows: int, seed: int = 0) -> Column:
    """The shuffled place of row ``number`` out of ``rows``: a permutation of ``0 .. rows-1``."""
    return _walk(permute(number, rows, seed), rows, seed, walk_steps(spark, rows, seed))


def number_rows(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0, in an order that depends on the rows only, not on their partitions.

    Rows are dealt to ``PARTS`` parts by the hash of ``keys`` and numbered in each
    part; a part starts where those before it end. No part holds more than its
    share unless that many rows agree in all ``keys``.
    """
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int"))
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")  # over PARTS rows at most
    starts = counts.select("__part", before.alias("__start"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    return (
        dealt.join(F.broadcast(starts), "__part")
        .withColumn(name, (F.col("__start") + within).cast("bigint"))
        .drop("__part", "__start")
    )


def shard_rows(df: DataFrame, keys: list[str], shards: int = 8, seed: int = 0) -> DataFrame:
    """``df`` with ``place``, ``shard`` and ``slot``; shard sizes differ by one at most and slots have no gaps.

    The order behind the numbers is that of ``keys``. Null keys count as a value.
    Rows that agree in all keys are interchangeable and get places of their own.
    Columns of ``df`` named like a result are replaced. An empty table stays empty.
    The rows are written to the shared folder first, so that counting and
    numbering see the same ones even if the source changes or a task is repeated.
    """
    spark = df.sparkSession
    kept = materialize(df.drop("place", "shard", "slot"))
    rows = kept.count()
    numbered = number_rows(kept, keys, "__number")
    at = place(spark, F.col("__number"), rows, seed) if rows else F.lit(None).cast("bigint")
    return (
        numbered.withColumn("place", at)
        .withColumn("shard", (F.col("place") % shards).cast("int"))
        .withColumn("slot", F.floor(F.col("place") / shards).cast("bigint"))
        .drop("__number")
    )


#: Rows that an ordered shuffle moves about at most, and rows numbered by one task.
WINDOW, PART_ROWS, MOST_PARTS = 4096, 100_000, 65_536


def shard_in_order(
    df: DataFrame, at: str, order: list[str], shards: int = 8, window: int = WINDOW, seed: int = 0
) -> DataFrame:
    """``df`` with ``place``, ``shard`` and ``slot``, shuffled only within windows of a given order.

    Rows are numbered by ``at``, a moment from 0 to 1 (null last), then by
    ``order``. Each ``window`` of consecutive numbers is permuted in itself, so a
    shard's slots follow the order up to a window. Shard sizes differ by one at most
    and slots have no gaps. ``df`` is narrow and stored: its rows are shuffled.
    """
    spark, rows = df.sparkSession, df.count()
    parts = min(MOST_PARTS, max(1, -(-rows // PART_ROWS)))
    moment = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(F.col(at) * parts)))
    dealt = df.withColumn("__part", F.coalesce(moment, F.lit(parts)).cast("int"))
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")  # over MOST_PARTS + 1 rows at most
    starts = counts.select("__part", before.alias("__start"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(at).asc_nulls_last(), *order)) - 1
    number = (F.col("__start") + within).cast("bigint")
    full, rest = rows - rows % window, rows % window
    inner = place(spark, F.col("__number") % window, window, seed) if full else F.lit(0).cast("bigint")
    tail = place(spark, F.col("__number") - full, rest, seed) if rest else F.lit(0).cast("bigint")
    base = F.col("__number") - F.col("__number") % window
    placed = F.when(F.col("__number") < full, base + inner).otherwise(full + tail).cast("bigint")
    return (
        dealt.join(F.broadcast(starts), "__part")
        .withColumn("__number", number)
        .withColumn("place", placed)
        .withColumn("shard", (F.col("place") % shards).cast("int"))
        .withColumn("slot", F.floor(F.col("place") / shards).cast("bigint"))
        .drop("__part", "__start", "__number")
    )


def document_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32)``: UTF-8 bytes plus one, and the checksum of the text; null counts as empty."""
    body = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
