"""Row counts of tables and a profile of their columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).orderBy("table_name")


def column_profile(tables: dict[str, DataFrame], table: str | None = None, approx: bool = False) -> DataFrame:
    """One row per column: position, type, NULLs and distinct values.

    Distinct counts are exact unless ``approx`` is set. One pass over a table turns
    its rows into cells, each value in a slot of its own type; cells are folded
    before the shuffle and spread by column and value, so a frequent value weighs
    nothing and no copy of a table is stored. ``approx`` shuffles sketches instead.
    """
    chosen = tables if table is None else {table: tables[table]}
    profile = _approximate_profile if approx else _exact_profile
    return profile(chosen).orderBy("table_name", "ordinal_position")


_DESCRIPTION = ["table_name", "column_name", "ordinal_position", "data_type"]


def _described(name: str, df: DataFrame, position: int) -> list[Column]:
    field = df.schema.fields[position]
    values = (name, field.name, position + 1, field.dataType.simpleString())
    return [F.lit(value).alias(column) for column, value in zip(_DESCRIPTION, values)]


def _exact_profile(tables: dict[str, DataFrame]) -> DataFrame:
    parts = []
    for name, df in tables.items():
        # a table without rows has no values, but its columns are still listed
        listed = [F.struct(*_described(name, df, i)) for i in range(len(df.columns))]
        nothing = F.lit(0).cast("bigint")
        columns = df.sparkSession.range(1).select(F.inline(F.array(*listed)))
        parts.append(columns.withColumns({"nulls": nothing, "values": nothing}))
        per_value = _cells(df).groupBy("position", *_slots(df).values()).agg(F.count(F.lit(1)).alias("cells"))
        missing = reduce(Column.__and__, [F.col(slot).isNull() for slot in _slots(df).values()])
        per_column = per_value.groupBy("position").agg(
            F.sum(F.when(missing, F.col("cells")).otherwise(0)).alias("nulls"),
            F.count(F.when(~missing, 1)).alias("values"),
        )
        parts.append(per_column.select(F.inline(F.array_compact(F.array(*[
            F.when(F.col("position") == i, F.struct(*_described(name, df, i), "nulls", "values"))
            for i in range(len(df.columns))
        ])))))
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy(*_DESCRIPTION)
        .agg(F.sum("nulls").alias("null_count"), F.sum("values").alias("distinct_count"))
    )


def _slots(df: DataFrame) -> dict[str, str]:
    """A column for the values of each data type."""
    types = dict.fromkeys(f.dataType.simpleString() for f in df.schema.fields)
    return {of: f"value_{i}" for i, of in enumerate(types)}


def _cells(df: DataFrame) -> DataFrame:
    """A row for each cell: the column's position, and the value in the slot of its type."""
    slots = _slots(df)
    cells = [
        F.struct(
            F.lit(i).alias("position"),
            *[
                (F.col(f"`{f.name}`") if f.dataType.simpleString() == of else F.lit(None).cast(of)).alias(slot)
                for of, slot in slots.items()
            ],
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.select(F.inline(F.array(*cells)))


def _approximate_profile(tables: dict[str, DataFrame]) -> DataFrame:
    def one_pass(name: str, df: DataFrame) -> DataFrame:
        one_row = df.agg(
            *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"nulls_{i}") for i, c in enumerate(df.columns)],
            *[F.approx_count_distinct(c).alias(f"distinct_{i}") for i, c in enumerate(df.columns)],
        )
        entries = [
            F.struct(
                *_described(name, df, i),
                F.col(f"nulls_{i}").alias("null_count"),
                F.col(f"distinct_{i}").alias("distinct_count"),
            )
            for i in range(len(df.columns))
        ]
        return one_row.select(F.inline(F.array(*entries)))

    return reduce(DataFrame.unionByName, [one_pass(name, df) for name, df in tables.items()])


#: Size of a sketch: 2 ** SKETCH registers, a standard error of about 0.8 percent.
SKETCH = 14


def column_sketches(df: DataFrame, part: str, columns: Sequence[str]) -> DataFrame:
    """``(part, column_name, row_count, null_count, sketch)``: what a profile needs of each part of a table.

    Parts are days, months or files, the values of column ``part``. Sketches of new
    parts are added to those stored before; old parts are not read again.
    """
    made = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(F.col(c).isNull()).alias("null_count"),
            F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH)).alias("sketch"),
        ).alias(f"_{i}")
        for i, c in enumerate(columns)
    ]
    per_part = df.groupBy(F.col(part).alias("part")).agg(*made)
    stacked = per_part.select("part", F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("c"))
    return stacked.select("part", "c.*")


def profile_from_sketches(sketches: DataFrame) -> DataFrame:
    """``(column_name, row_count, null_count, distinct_estimate)`` of all parts together."""
    return sketches.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"),
    )
