"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both agree.

The tokenizer first cuts a text into pieces (words, numbers, runs of signs or
white space) from left to right, then encodes each piece by itself. A cut depends
on the text to its right only by a few characters. So when two overlapping chunks
both start a piece at the same place, some way before the first one ends, all that
follows is the same in both: the place is a stable boundary. The counts of the
first chunk up to it and of the second from it are those of the whole text. If an
overlap has no such place, the first chunk is made longer.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a chunk and of the overlap of two; texts up to a chunk are encoded whole.
CHUNK, OVERLAP = 32_768, 1_024
#: Characters before a chunk's end that a stable boundary keeps away: more than a cut looks ahead, or a special string has.
MARGIN = 64
#: Characters that are encoded at once.
BATCH_CHARS = 262_144


@lru_cache(maxsize=4)
def load(name: str):
    """The tokenizer in the vocabulary file ``name``: a path, or a file of the public collection."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    if not os.path.exists(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(name)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Chunk:
    def __init__(self, tokenizer, text: str, begin: int, end: int) -> None:
        self.begin, self.end = begin, end
        coded = tokenizer.encode(text[begin:end], add_special_tokens=False)
        pieces = np.array([-1 if w is None else w for w in coded.word_ids])
        starts = np.array([o[0] for o in coded.offsets], np.int64) + begin
        first = np.ones(len(starts), bool)
        first[1:] = (pieces[1:] != pieces[:-1]) | (pieces[1:] < 0)
        at = np.flatnonzero(first)
        # where pieces start, and the number of tokens before each; a place once
        self.places, keep = np.unique(starts[at], return_index=True)
        self.before = at[keep]
        self.tokens = len(starts)

    def until(self, place: int) -> int:
        return int(self.before[np.searchsorted(self.places, place)])


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """Tokens of ``text``, encoded in chunks of about ``chunk`` characters."""
    begin, total, skip = 0, 0, 0
    current = _Chunk(tokenizer, text, 0, min(chunk, len(text)))
    while current.end < len(text):
        begin = max(current.begin + 1, current.end - overlap)
        following = _Chunk(tokenizer, text, begin, min(begin + chunk, len(text)))
        wide = overlap
        while True:
            low, high = max(following.begin, current.begin) + 1, current.end - margin
            places = current.places[(current.places >= low) & (current.places <= high)]
            places = places[np.isin(places, following.places)]
            if skip:
                places = places[[current.until(p) >= skip for p in places]] if len(places) else places
            if len(places) or current.end == len(text):
                break
            wide *= 2  # widen: the first chunk reaches further into the second
            longer = min(current.end + wide, len(text))
            current = _Chunk(tokenizer, text, current.begin, longer)
            if longer >= following.end - overlap:
                following = _Chunk(tokenizer, text, following.begin, min(longer + chunk, len(text)))
        if not len(places):
            break
        place = int(places[-1])
        total += current.until(place) - skip
        skip = following.until(place)
        current = following
    return total + current.tokens - skip


def _counts(name: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(name)

        def short(texts: list[str]) -> list[int]:
            return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            waiting, rows, chars = [], [], 0
            column = batch.column("__text")
            for i in range(batch.num_rows):
                text = column[i].as_py()
                if not text:
                    continue
                if len(text) > chunk:
                    out[i] = count_long(tokenizer, text, chunk, overlap)
                    continue
                waiting.append(text)
                rows.append(i)
                chars += len(text)
                if chars >= BATCH_CHARS:
                    out[rows] = short(waiting)
                    waiting, rows, chars = [], [], 0
            if rows:
                out[rows] = short(waiting)
            kept = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out)], [*kept, "n_tokens"])

    return run


def token_counts(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    text: str = "text",
    limit: int = 1024,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``docs`` without its text, with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    Null and empty texts have no bytes and no tokens. Strings of special tokens
    inside a text are treated as the library does by default. No special tokens
    are added, nothing is cut off or padded. Rows are counted one by one, repeated
    ones too; columns named like a result are replaced. ``tokenizer`` is a
    byte-level BPE file; its path must exist on every executor.
    """
    kept = docs.drop("n_bytes", "n_tokens", "over_limit")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = kept.select(
        *[c for c in kept.columns if c != text],
        F.octet_length(F.encode(body, "UTF-8")).cast("bigint").alias("n_bytes"),
        body.alias("__text"),
    )
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "__text"), T.StructField("n_tokens", T.LongType())])
    counted = rows.mapInArrow(_counts(tokenizer, chunk, overlap), schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
