"""Data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.plans import counts_by_key


def null_count(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.filter(F.col(column).isNull()).agg(F.count(F.lit(1)).alias(name))


def duplicate_keys(df: DataFrame, key: str, name: str = "occurrences") -> DataFrame:
    """Keys that stand in more than one row, with the number of rows."""
    return counts_by_key(df, key, name).filter(F.col(name) > 1)


def non_positive_count(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Rows in which at least one of the columns is zero or negative."""
    bad = reduce(lambda a, b: a | b, [F.col(c) <= 0 for c in columns])
    return df.filter(bad).agg(F.count(F.lit(1)).alias(name))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``; a NULL key is never matched.

    The right keys are made distinct first, with a map-side combine, so a fact
    on the right sends each key once.
    """
    return left.join(right.select(key).distinct(), key, "left_anti")


def unmatched_count(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Number of ``unmatched`` rows, counted per key before the join."""
    missing = unmatched(counts_by_key(left, key), right, key)
    return missing.agg(F.coalesce(F.sum("row_count"), F.lit(0).cast("bigint")).alias(name))
