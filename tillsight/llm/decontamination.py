"""Find benchmark passages in documents by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive words of a benchmark item. All patterns of
one length share a table that says, for the last two words read, how far the
window may move on; only where that is nothing are the patterns with this ending
looked up and compared word by word. Many texts, cut into overlapping segments,
are searched side by side, each with its own cursor. Words are compared by their
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.llm import words as W
from tillsight.plans.materialize import materialize

WINDOW = 10
#: Benchmark words that are searched for at once; a larger benchmark takes several passes over the documents.
BLOCK_WORDS = 1_000_000
SEGMENT = 128
_U = np.uint64


def _pairs(word: np.ndarray) -> np.ndarray:
    """Hash of each word and the one before it."""
    out = word.copy()
    out[1:] = W.mix(word[:-1] * _U(0x9E3779B97F4A7C15) + word[1:])
    return out


class Patterns:
    """The tables of all patterns of one length."""

    def __init__(self, rows: np.ndarray, items: np.ndarray) -> None:
        """``rows`` has a pattern in each row, ``items`` the item it belongs to; equal patterns become one."""
        self.length = m = rows.shape[1]
        packed = np.ascontiguousarray(rows).view(np.dtype((np.void, 8 * m))).ravel()
        _, first, which = np.unique(packed, return_index=True, return_inverse=True)
        self.rows = rows[first]
        order = np.lexsort((items, which))
        which, items = which[order], items[order]
        keep = np.ones(len(which), bool)
        keep[1:] = (which[1:] != which[:-1]) | (items[1:] != items[:-1])
        self.items, self.item_at = items[keep], np.searchsorted(which[keep], np.arange(len(first) + 1))

        self.block = b = min(2, m)
        flat = self.rows if b == 1 else W.mix(self.rows[:, :-1] * _U(0x9E3779B97F4A7C15) + self.rows[:, 1:])
        by_ending = np.argsort(flat[:, -1], kind="stable")
        self.ending, self.by_ending = flat[by_ending, -1], by_ending
        self.mask = _U((1 << max(12, (8 * flat.size).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, m - b + 1, np.uint8)
        for back in range(flat.shape[1] - 1, -1, -1):  # the block nearest the end is written last
            self.shift[(flat[:, flat.shape[1] - 1 - back] & self.mask).astype(np.int64)] = back

    def find(self, word: np.ndarray, pair: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(first word, pattern)`` of every occurrence within the texts ``bounds`` tells apart."""
        m, last = self.length, word if self.block == 1 else pair
        counts = np.maximum(np.diff(bounds) - m + 1, 0)  # window ends in each text
        pieces = -(-counts // SEGMENT)
        text = np.repeat(np.arange(len(counts)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cursor = bounds[:-1][text] + m - 1 + nth * SEGMENT
        limit = np.minimum(cursor + SEGMENT, bounds[1:][text])
        stops = []
        while len(cursor):
            move = self.shift[(last[cursor] & self.mask).astype(np.int64)].astype(np.int64)
            stops.append(cursor[move == 0])
            cursor = cursor + np.maximum(move, 1)
            going = cursor < limit
            cursor, limit = cursor[going], limit[going]
        stop = np.concatenate(stops) if stops else np.empty(0, np.int64)
        low, high = np.searchsorted(self.ending, last[stop]), np.searchsorted(self.ending, last[stop], "right")
        found, some = [], np.flatnonzero(high > low)
        for at in range(0, len(some), 4096):
            here = some[at : at + 4096]
            width = high[here] - low[here]
            end = np.repeat(stop[here], width)
            offset = np.arange(len(end)) - np.repeat(np.cumsum(width) - width, width)
            pattern = self.by_ending[np.repeat(low[here], width) + offset]
            for j in range(m):
                same = word[end - m + 1 + j] == self.rows[pattern, j]
                end, pattern = end[same], pattern[same]
            found.append((end - m + 1, pattern))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f for f, _ in found]), np.concatenate([p for _, p in found])


def compile_patterns(texts: list[str | None], window: int) -> list[Patterns]:
    """Patterns of the items ``texts``, by length: all windows, or the whole of a shorter item that has words."""
    groups: dict[int, list[tuple[np.ndarray, int]]] = {}
    for first, _, data, offsets in W.text_blocks(pa.array(texts, pa.string())):
        words = W.split(data, offsets, W.ALPHANUMERIC)
        hashes = words.hashes()[0]
        for d, (low, high) in enumerate(zip(words.bounds, words.bounds[1:])):
            if high > low:
                m = min(window, high - low)
                rows = np.lib.stride_tricks.sliding_window_view(hashes[low:high], m)
                groups.setdefault(int(m), []).append((rows, first + d))
    return [
        Patterns(np.concatenate([r for r, _ in g]), np.concatenate([np.full(len(r), i) for r, i in g]))
        for _, g in sorted(groups.items())
    ]


def _lists(owner: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), values)


def _search(patterns: list[Patterns], ids: pa.Array, text: str, later: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in W.text_blocks(batch.column(text)):
                n = stop - first
                rows = batch.slice(first, n)
                words = W.split(data, offsets, W.ALPHANUMERIC)
                word, bounds, owner = words.hashes()[0], words.bounds, words.owner()
                pair = _pairs(word)
                marks = np.zeros(len(word) + 1, np.int64)
                texts, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for p in patterns:
                    begin, pattern = p.find(word, pair, bounds)
                    np.add.at(marks, begin, 1)
                    np.add.at(marks, begin + p.length, -1)
                    width = p.item_at[pattern + 1] - p.item_at[pattern]
                    nth = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                    texts.append(np.repeat(owner[begin], width))
                    items.append(p.items[np.repeat(p.item_at[pattern], width) + nth])
                if later:  # what earlier passes found
                    spans = rows.column("hits")
                    of = np.repeat(np.arange(n), np.diff(np.asarray(spans.offsets)))
                    flat = spans.flatten()
                    np.add.at(marks, bounds[of] + flat.field("first").to_numpy(), 1)
                    np.add.at(marks, bounds[of] + flat.field("stop").to_numpy(), -1)
                hit = np.zeros(len(word) + 2, bool)
                hit[1:-1] = np.cumsum(marks)[:-1] > 0
                new, end = hit[1:-1] & ~hit[:-2], hit[1:-1] & ~hit[2:]
                edges = bounds[1:-1]
                edges = edges[(edges > 0) & (edges < len(word))]
                new[edges], end[edges - 1] = hit[1:-1][edges], hit[1:-1][edges - 1]
                a, z = np.flatnonzero(new), np.flatnonzero(end) + 1
                spans = pa.StructArray.from_arrays(
                    [pa.array(a - bounds[owner[a]]), pa.array(z - bounds[owner[a]])], ["first", "stop"]
                )
                both = np.unique(np.stack([np.concatenate(texts), np.concatenate(items)]), axis=1)
                named = _lists(both[0], n, ids.take(pa.array(both[1])))
                if later:
                    named = pa.array([x + y for x, y in zip(rows.column("items").to_pylist(), named.to_pylist())], named.type)
                kept = [c for c in rows.schema.names if c not in ("n_words", "hits", "items")]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in kept), pa.array(words.counts.astype(np.int64)), _lists(owner[a], n, spans), named],
                    [*kept, "n_words", "hits", "items"],
                )

    return run


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` and ``items``.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond
    ASCII. A window is ``window`` consecutive words of an item, or the whole of an
    item with fewer. ``hits`` are the ranges ``(first, stop)`` of document words
    inside any occurrence of a window, merged, in order; ``items`` the distinct
    items with an occurring window.

    Null and wordless texts have no words; null and wordless items no windows.
    Repeated rows are searched each. Equal items are all named. A null item id
    stays null in ``items``. Columns of ``docs`` named like a result are replaced.

    The items are a query set: blocks of about ``block_words`` words are read by
    the driver, compiled and sent to all tasks, one pass over the documents each.
    Between passes the documents are written to the shared folder.
    """
    words = F.regexp_count(F.lower(F.col(item_text)), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    total = benchmark.agg(F.sum(words)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    named = benchmark.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text"))
    id_type = named.schema["item"].dataType
    result = docs.drop("n_words", "hits", "items")
    schema = T.StructType(
        [
            *result.schema.fields,
            T.StructField("n_words", T.LongType()),
            T.StructField("hits", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("stop", T.LongType())]))),
            T.StructField("items", T.ArrayType(id_type)),
        ]
    )
    for block in range(blocks):
        part = named.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).toArrow()
        patterns = compile_patterns(part.column("text").to_pylist(), window)
        ids = part.column("item").combine_chunks()
        if block:
            result = materialize(result)
        result = result.mapInArrow(_search(patterns, ids, text, later=block > 0), schema)
    return result


def hit_words(hits: Column) -> Column:
    """Words inside the ranges of ``hits``."""
    return F.aggregate(hits, F.lit(0).cast("bigint"), lambda n, h: n + h["stop"] - h["first"])


def item_digest(items: Column) -> Column:
    """SHA-256 of the ids, sorted as strings, comma-joined."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",").cast("binary"), 256)
