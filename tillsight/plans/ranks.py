"""Top-k with and without ties, and shares of a grand total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sort_column(name: str, ascending: bool) -> Column:
    return F.col(name).asc_nulls_first() if ascending else F.col(name).desc_nulls_last()


def dense_rank_top(df: DataFrame, measure: str, k: int, rank: str, ascending: bool = False) -> DataFrame:
    """Rows whose dense rank by ``measure`` is at most ``k``, ties included.

    A row is kept exactly when its value is among the k first distinct values.
    Those k values come from a distributed top-k and are ranked alone (at most k
    rows), then joined back, so that a tie shared by most rows is never gathered
    in one task. Both uses of ``df`` read the same shuffle output. The result
    carries the rank and is not sorted.
    """
    best = df.select(F.col(measure).alias("_value")).distinct()
    best = best.orderBy(_sort_column("_value", ascending)).limit(k)
    ranked = best.select(
        "_value", F.dense_rank().over(Window.orderBy(_sort_column("_value", ascending))).alias(rank)
    )
    return df.join(F.broadcast(ranked), F.col(measure).eqNullSafe(F.col("_value")), "inner").drop("_value")


def first_n(df: DataFrame, measure: str, n: int, tiebreak: Sequence[str], ascending: bool = False) -> DataFrame:
    """Exactly ``n`` rows by ``measure``; ``tiebreak`` settles equal values."""
    return df.orderBy(_sort_column(measure, ascending), *[F.col(c).asc_nulls_first() for c in tiebreak]).limit(n)


def share_of_total(df: DataFrame, measure: str) -> Column:
    """Percentage of the grand total of ``measure``, unrounded, as a double.

    The total is a scalar subquery over the same aggregated frame, which reuses
    its shuffle and brings one value to each task instead of all rows to one task.
    """
    total = df.select(F.sum(measure)).scalar().cast("double")
    return F.col(measure).cast("double") / F.nullif(total, F.lit(0.0)) * 100
