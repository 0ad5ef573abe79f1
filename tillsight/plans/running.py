"""Running totals and moving means over rows in a global order, without one task that sees all rows.

Rows are range-partitioned by their order and stored with the number of their part.
A part's running total starts from the sum of the parts before it, one row each. A
moving mean also needs the last rows before the part, its halo: the few last rows of
every part are copied to the parts whose first windows reach back to them, across
parts that are shorter than the window too.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import ratio
from tillsight.plans.materialize import materialize

#: Rows that one task puts in order.
PART_ROWS = 250_000


def running_over_rows(
    df: DataFrame,
    order: list[str],
    value: str,
    running: str,
    moving: str,
    window: int,
    part_rows: int = PART_ROWS,
    nulls_last: bool = False,
) -> DataFrame:
    """``df`` with ``running``, the sum of ``value`` so far, and ``moving``, its mean over the last ``window`` rows.

    Rows go by ``order``, nulls first or else last; rows that agree in all of it follow each
    other in any way. NULL values count for neither. Sums are exact for exact types.
    """
    told_apart = df.withColumn("_row", F.monotonically_increasing_id())
    parts = max(1, math.ceil(df.count() / part_rows))
    in_place = [F.col(c).asc_nulls_last() if nulls_last else F.col(c).asc_nulls_first() for c in order]
    keys = [*in_place, F.col("_row")]  # a value that most rows share is cut by the row
    stored = materialize(told_apart.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))

    # one row for each part
    sums = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.sum(value).alias("_sum"))
    in_order = Window.orderBy("_part")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"), F.sum("_sum").over(before).alias("_so_far")
    )
    # no part is empty, so rows reach the next window - 1 parts at most
    ahead = in_order.rowsBetween(1, max(1, window - 1))
    later = F.struct(F.col("_part").alias("_to"), F.col("_start").alias("_first"), F.col("_so_far").alias("_sum_to"))
    starts = materialize(
        starts.withColumn("_next", F.lead("_start").over(in_order)).withColumn("_later", F.collect_list(later).over(ahead))
    )
    within = Window.partitionBy("_part").orderBy(*keys)
    placed = stored.join(F.broadcast(starts.drop("_later")), "_part")
    numbered = placed.withColumn("_at", F.col("_start") + F.row_number().over(within) - 1)

    # rows whose successors within the window lie in later parts
    last = numbered.where(F.col("_at") >= F.col("_next") - window + 1)
    halo = last.join(F.broadcast(starts.select("_part", F.explode("_later").alias("_reached"))), "_part").select("*", "_reached.*")
    halo = halo.where(F.col("_at") > F.col("_first") - window).withColumn("_part", F.col("_to"))
    halo = halo.withColumn("_so_far", F.col("_sum_to")).drop("_reached", "_to", "_first", "_sum_to").withColumn("_halo", F.lit(True))

    all_rows = numbered.withColumn("_halo", F.lit(False)).unionByName(halo)
    by_place = Window.partitionBy("_part").orderBy("_at")
    recent = by_place.rowsBetween(1 - window, Window.currentRow)
    own = F.sum(F.when(~F.col("_halo"), F.col(value))).over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    so_far = F.when(own.isNull(), F.col("_so_far")).otherwise(F.coalesce("_so_far", F.lit(0).cast(df.schema[value].dataType)) + own)
    return (
        all_rows.withColumn(running, so_far)
        .withColumn(moving, ratio(F.sum(value).over(recent), F.count(value).over(recent)))
        .where("not _halo")
        .drop("_row", "_part", "_start", "_so_far", "_next", "_at", "_halo")
    )
