"""A Bloom filter of fixed size over 64-bit keys, to leave rows out before a shuffle.

Its bits are merged by an aggregate; the driver holds ``2 ** BITS`` bits at most,
whatever the number of keys. With many more keys than bits it lets everything
through, which costs time and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.words import mix

BITS = 25
_SALTS = (0x243F6A8885A308D3, 0x13198A2E03707344)


def _places(keys: np.ndarray) -> list[np.ndarray]:
    return [mix(keys ^ np.uint64(s)) >> np.uint64(64 - BITS) for s in _SALTS]


def build(rows: DataFrame, key: str) -> np.ndarray:
    """The filter's 64-bit blocks for the column ``key`` (a bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            place = np.concatenate(_places(keys)) if len(keys) else np.empty(0, np.uint64)
            block, which = np.unique(place >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(block), np.uint64)
            np.bitwise_or.at(bits, which, np.uint64(1) << (place & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(block.view(np.int64)), pa.array(bits.view(np.int64))], ["block", "bits"])

    merged = (
        rows.select(key)
        .where(F.col(key).isNotNull())
        .mapInArrow(run, "block bigint, bits bigint")
        .groupBy("block")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    blocks = np.zeros(1 << (BITS - 6), np.uint64)
    blocks[merged.column("block").to_numpy()] = merged.column("bits").to_numpy().view(np.uint64)
    return blocks


def may_hold(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; never false for one that is."""
    out = np.ones(len(keys), bool)
    for place in _places(keys):
        out &= (blocks[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    return out
