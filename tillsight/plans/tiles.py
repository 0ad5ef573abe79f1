"""NTILE over a whole table without sending the table to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a measure, and the key among equal measures, is cut into.
RANGES = 64


def tile_of(at: Column, rows: Column, tiles: int) -> Column:
    """Tile, from 1, of the row at position ``at`` (from 0) of ``rows``; larger tiles come first."""
    size, larger = F.floor(rows / tiles), rows % tiles
    long_rows = larger * (size + 1)
    return (
        F.when(at < long_rows, F.floor(at / (size + 1)))
        .otherwise(larger + F.floor((at - long_rows) / F.greatest(size, F.lit(1))))
        .cast("int")
        + 1
    )


def exact_tiles(
    df: DataFrame, measures: dict[str, tuple[str, bool]], key: str, tiles: int, ranges: int = RANGES
) -> DataFrame:
    """Add one NTILE column per entry of ``measures``: name -> (numeric column, ascending).

    Equal measures are ordered by ``key``, a unique number. NULL measures come
    first if ascending, else last; a NULL key comes first.

    Approximate quantiles of all measures and of the key, one aggregate, cut each
    order into classes: a quantile itself, or what lies between two. A value that
    many rows share is a quantile, so its class holds that value only and is cut
    again by key. A row's position is the exact number of rows in the classes
    before its own, plus its row number in the class. The counts, at most a few
    thousand rows whatever the table's size, are all that is ever brought to one
    task; nothing is stored, and no job runs before the result is asked for.
    """
    shares = [i / ranges for i in range(1, ranges)]

    def height(column: str, ascending: bool) -> Column:
        return F.col(column) if ascending else -F.col(column)

    cuts = df.select(
        F.struct(
            F.percentile_approx(key, shares).alias("_key"),
            *[F.percentile_approx(height(*m), shares).alias(name) for name, m in measures.items()],
        )
    ).scalar()
    marked = df.withColumn("_cuts", cuts)
    key_range = F.when(F.col(key).isNull(), -1).otherwise(
        F.size(_below(F.col("_cuts._key"), F.col(key)))
    )
    classes = {}
    for name, (column, ascending) in measures.items():
        value, own = height(column, ascending), F.col(f"_cuts.{name}")
        is_cut = F.coalesce(F.array_contains(own, value), F.lit(True))
        below = 2 * F.size(_below(own, value))
        position = F.when(value.isNull(), -1 if ascending else 2 * ranges).otherwise(below + is_cut.cast("int"))
        within = F.when(is_cut, key_range).otherwise(0)
        classes[f"_{name}"] = F.struct(F.lit(name).alias("of"), position.alias("c"), within.alias("k"))
    marked = marked.withColumns(classes).drop("_cuts")

    # the classes of all measures in one small table, which every measure is joined with
    counts = (
        marked.select(F.explode(F.array(*[F.col(f"_{name}") for name in measures])).alias("_class"))
        .groupBy("_class")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    one = Window.partitionBy("_class.of")
    starts = counts.select(
        "_class",
        (F.sum("_rows").over(one.orderBy("_class")) - F.col("_rows")).alias("_start"),
        F.sum("_rows").over(one).alias("_all"),
    )
    for name, (column, ascending) in measures.items():
        order = Window.partitionBy(f"_{name}").orderBy(height(column, ascending), F.col(key).asc_nulls_first())
        at = F.col("_start") + F.row_number().over(order) - 1
        marked = (
            marked.join(F.broadcast(starts), F.col(f"_{name}") == F.col("_class"))
            .withColumn(name, tile_of(at, F.col("_all"), tiles))
            .drop(f"_{name}", "_class", "_start", "_all")
        )
    return marked


def _below(cuts: Column, value: Column) -> Column:
    return F.filter(cuts, lambda c: c < value)
