"""Vectors as rows of integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of every component, as an array of ints."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("int"))


def usable(vector: str, scale: int, limit: int) -> Column:
    """Whether a vector has components, none of them null, non-finite, or ``limit`` or more in size once scaled."""
    bound = F.lit(limit / scale)

    def good(x: Column) -> Column:
        wide = x.cast("double")
        return x.isNotNull() & ~F.isnan(wide) & (F.abs(wide) < bound)

    return F.coalesce((F.size(vector) > 0) & F.forall(vector, good), F.lit(False))


def commonest_width(stored: DataFrame, ints: str) -> int:
    """The most frequent number of components, the smaller of equally frequent ones; 0 for an empty table."""
    widths = stored.groupBy(F.size(ints).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    most = widths.orderBy(F.desc("n"), "width").first()
    return most["width"] if most else 0


def matrix(column: pa.Array | pa.ChunkedArray, width: int, dtype: type = np.int64) -> np.ndarray:
    """A column of lists of ``width`` numbers each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(dtype).reshape(-1, width)


def rows_of(matrix: np.ndarray, type: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as lists."""
    edges = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(matrix.ravel()).cast(type))
