"""Aggregate the fact before it meets a dimension.

A sum commutes with the join to a dimension, so the fact is first folded to one
row per key with a map-side combine. A key that holds a third of the fact
becomes one row per map task before anything is shuffled, and the join runs
between two sides with unique keys. No broadcast is forced: Spark broadcasts a
dimension only when its measured size is under the session's threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def roll_up(
    fact: DataFrame,
    dimension: DataFrame,
    key: str,
    by: Sequence[str],
    measures: dict[str, str],
    also_by: dict[str, Column] | None = None,
) -> DataFrame:
    """Sum fact columns by dimension columns, keeping unmatched facts in a NULL group.

    ``measures`` maps an output name to the fact column to sum; ``also_by`` adds
    group columns taken from the fact. When ``key`` itself is in ``by`` the
    dimension's copy is meant, so every unmatched key folds into the NULL group.
    """
    also_by = also_by or {}
    per_key = fact.groupBy(F.col(key).alias("_fact_key"), *[c.alias(n) for n, c in also_by.items()]).agg(
        *[F.sum(column).alias(name) for name, column in measures.items()]
    )
    lookup = dimension.select(F.col(key).alias("_dim_key"), *[F.col(c) for c in by])
    joined = per_key.join(lookup, F.col("_fact_key") == F.col("_dim_key"), "left")
    return joined.groupBy(*by, *also_by).agg(*[F.sum(name).alias(name) for name in measures])


def counts_by_key(df: DataFrame, key: str, name: str = "row_count") -> DataFrame:
    """Rows per key, NULL being one of the keys."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
