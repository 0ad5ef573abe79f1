"""Byte-level BPE over rank files, by dynamic programming over prefixes.

Merging the pair of lowest rank first gives every byte string one encoding. Two
facts follow. A row of tokens is such an encoding exactly if no two neighbours
would have merged across their border (``Ranks.fit``). And every prefix has one
encoding, so it has one *last token*: the only token at its end that fits the last
token of what stands before it. ``Prefixes`` stores these last tokens.

* Appending bytes computes only the new prefixes; all stored ones stay.
* A last token depends on the bytes and last tokens of as many places before it as
  the longest token has bytes. After an edit, once that many places in a row agree
  with the stored ones, all later ones do.

Texts are first cut into pieces by a pattern that looks at most ``LOOK`` characters
beyond a piece and never back, so an edited text is cut anew only from a piece
before the edit to the first cut that the old text has as well (``Coder.edit``).
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters after a piece that may decide where it ends.
LOOK = 3
#: Pieces that are encoded at once, bytes of an output batch, bytes of pieces whose codes are kept.
PIECES, BATCH_BYTES, KEPT_BYTES = 65_536, 4 << 20, 96 << 20
#: Longer pieces are not kept.
KEPT_PIECE = 64
#: Pairs of neighbours whose fit is kept.
KEPT_PAIRS = 1 << 19


class Ranks:
    """A rank file: base64 bytes and rank on each line; a token's id is its rank.

    Every byte must be a token and every other token must be a merge of two of
    lower rank, as training makes them; ``ValueError`` if not.
    """

    def __init__(self, lines: Iterator[bytes]) -> None:
        import ahocorasick

        ids = _read(lines)
        if sum(len(t) == 1 for t in ids) != 256:
            raise ValueError("not every byte is a token")
        self.token: list[bytes] = [b""] * (max(ids.values()) + 1)
        #: when a token is made: bytes are there from the start
        self.made = [-1] * len(self.token)
        self.left, self.right = list(range(len(self.token))), list(range(len(self.token)))
        self.merged: dict[tuple[int, int], int] = {}
        self._pairs: dict[int, bool] = {}
        self.ends = ahocorasick.Automaton()
        for piece, rank in sorted(ids.items(), key=lambda item: item[1]):
            self.token[rank] = piece
            self.ends.add_word(piece.decode("latin-1"), rank)
            if len(piece) == 1:
                continue
            # with the tokens of lower rank alone, the piece is two tokens that fit
            halves = ((ids.get(piece[:cut]), ids.get(piece[cut:])) for cut in range(1, len(piece)))
            split = next((h for h in halves if self._lower(h, rank) and self._fit(*h)), None)
            if split is None:
                raise ValueError(f"token {rank} is no merge of two tokens of lower rank")
            self.left[rank], self.right[rank] = split
            self.merged[split], self.made[rank] = rank, rank
        self.ends.make_automaton()
        self.size = [len(t) for t in self.token]
        self.longest = max(self.size)
        #: characters that begin in a token
        self.chars = np.array([sum(b & 0xC0 != 0x80 for b in t) for t in self.token], np.int64)

    def _lower(self, halves: tuple[int | None, int | None], rank: int) -> bool:
        return all(h is not None and (len(self.token[h]) == 1 or h < rank) for h in halves)

    def _fit(self, one: int, two: int) -> bool:
        """Whether ``one`` and ``two`` stay two tokens.

        Seen backwards in time, the tokens at the border are taken apart, the one
        made last first. They would have merged if their merge came before what
        made the next larger token on either side; of equal merges the left one
        comes first.
        """
        made, merged = self.made, self.merged
        before = len(made)
        while True:
            both = merged.get((one, two))
            if both is not None and both < before:
                return False
            if made[one] > made[two]:
                before, one = made[one], self.right[one]
            elif made[two] >= 0:
                before, two = made[two] + 1, self.left[two]
            else:
                return True

    def fit(self, one: int, two: int) -> bool:
        pair = one * len(self.token) + two
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= KEPT_PAIRS:
                self._pairs.clear()
            known = self._pairs[pair] = self._fit(one, two)
        return known

    def encode(self, data: bytes) -> list[int]:
        """The ids of a byte string, from the last tokens of all its prefixes."""
        # of the prefix that ends in each byte; -1 is nothing, also before the first byte
        last, size, known, fit, count = [-1] * (len(data) + 1), self.size, self._pairs.get, self.fit, len(self.token)
        for end, token in self.ends.iter(data.decode("latin-1")):
            if last[end] < 0:
                before = last[end - size[token]]
                if before < 0:
                    last[end] = token
                else:
                    fits = known(before * count + token)
                    if fits or (fits is None and fit(before, token)):
                        last[end] = token
        out, at = [], len(data) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[out[-1]]
        out.reverse()
        return out

    def walk(self, last: list[int] | array) -> list[int]:
        """The ids of the longest prefix, from the back."""
        out, at, size = [], len(last) - 1, self.size
        while at:
            out.append(last[at])
            at -= size[out[-1]]
        out.reverse()
        return out


class Prefixes:
    """The last token of every prefix of a byte string."""

    def __init__(self, ranks: Ranks, data: bytes = b"") -> None:
        self.ranks, self.data = ranks, b""
        self.last = array("i", [-1])
        self.append(data)

    def _extend(self, data: bytes, last: array, old: array | None = None) -> int | None:
        """Complete ``last`` for ``data``; the place where it meets ``old``, the last tokens of the end of ``data``, if it does."""
        ranks, done = self.ranks, len(last) - 1
        begin, shift = max(0, done + 1 - ranks.longest), len(data) + 1 - len(old or ())
        last.extend([-1] * (len(data) - done))
        size, fit, agreed, at = ranks.size, ranks.fit, 0, done
        for end, token in ranks.ends.iter(data[begin:].decode("latin-1")):
            end += begin + 1
            if old is not None and end > at:  # every place ends some token, so ``at`` is complete
                agreed = agreed + 1 if at >= shift and last[at] == old[at - shift] else 0
                if agreed >= ranks.longest:
                    return at
                at = end
            if end <= done or last[end] >= 0:
                continue
            start = end - size[token]
            if start == 0 or fit(last[start], token):
                last[end] = token
        return None

    def append(self, data: bytes) -> None:
        self.data += data
        self._extend(self.data, self.last)

    def replace(self, begin: int, end: int, data: bytes) -> None:
        """Put ``data`` in place of the bytes from ``begin`` to ``end``."""
        whole = self.data[:begin] + data + self.data[end:]
        last, old = self.last[: begin + 1], self.last[end:]
        met = self._extend(whole, last, old)
        if met is not None:
            last = last[: met + 1]
            last.extend(old[met + 1 - (len(whole) + 1 - len(old)) :])
        self.data, self.last = whole, last

    def ids(self) -> list[int]:
        return self.ranks.walk(self.last)


#: The public pattern, and the same with Python's own classes, which are faster.
_PUBLIC = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def plain_pattern(pattern: str) -> tuple[re.Pattern, np.ndarray] | None:
    """A pattern that cuts like ``pattern`` every text without the code points that are marked.

    Python's classes differ by numbers that are no digits, by four separators that
    are blanks to it alone, and may by characters that its tables do not know.
    """
    if pattern != _PUBLIC:
        return None
    differs = np.array([unicodedata.category(chr(c)) in ("Nl", "No", "Cn", "Cs") for c in range(0x110000)])
    differs[0x1C:0x20] = True
    return re.compile(_PLAIN), differs


def _is_plain(text: str, differs: np.ndarray) -> bool:
    return not differs[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any()


class Coder:
    """Texts to ids and back: pieces by ``pattern``, each encoded by its prefixes."""

    def __init__(self, ranks: Ranks, pattern: str) -> None:
        import regex

        self.ranks, self.pattern, self.plain = ranks, regex.compile(pattern), plain_pattern(pattern)
        # codes (32-bit ids) of pieces met lately, and those of the time before, which stay if they are met again
        self._codes: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._kept = 0

    def _new(self, piece: str) -> bytes:
        code = self._older.get(piece)
        if code is None:
            code = array("i", self.ranks.encode(piece.encode("utf-8", "replace"))).tobytes()
        if len(piece) <= KEPT_PIECE:
            if self._kept > KEPT_BYTES // 2:
                self._older, self._codes, self._kept = self._codes, {}, 0
            self._codes[piece] = code
            self._kept += 160 + 2 * len(piece)
        return code

    def codes(self, pieces: list[str]) -> list[bytes]:
        known, at = list(map(self._codes.get, pieces)), -1
        for _ in range(known.count(None)):
            at = known.index(None, at + 1)
            known[at] = self._new(pieces[at])
        return known

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= PIECES:
            plain = self.plain and _is_plain(text, self.plain[1])
            yield (self.plain[0] if plain else self.pattern).findall(text)
            return
        matches = map(itemgetter(0), self.pattern.finditer(text))
        while some := list(islice(matches, PIECES)):
            yield some

    def encode_ids(self, text: str) -> np.ndarray:
        """The ids of a text."""
        return np.frombuffer(b"".join([b"".join(self.codes(some)) for some in self._pieces(text)]), np.int32)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text and the number of ids in each piece."""
        made = [code for some in self._pieces(text) for code in self.codes(some)]
        return np.frombuffer(b"".join(made), np.int32), np.fromiter(map(len, made), np.int32, len(made)) // 4

    def decode(self, ids: np.ndarray) -> bytes:
        return decode(self.ranks.token, ids)

    def edit(
        self, text: str, ids: np.ndarray, counts: np.ndarray, begin: int, end: int, new: str
    ) -> tuple[str, np.ndarray, np.ndarray, int]:
        """The text with ``new`` in place of the characters from ``begin`` to ``end``, its ids and counts, and the pieces cut anew."""
        whole = text[:begin] + new + text[end:]
        at = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])  # ids before each piece
        starts = np.concatenate([[0], np.cumsum(self.ranks.chars[ids])])[at]  # characters before each piece
        first = int(np.searchsorted(starts[1:], begin - LOOK, "right"))
        grown, made = len(whole) - len(text), []
        following = len(counts)
        for m in self.pattern.finditer(whole, int(starts[first])):
            place = m.start() - grown
            if place >= end:
                same = int(np.searchsorted(starts, place))
                if starts[same] == place:
                    following = same
                    break
            made.extend(self.codes([m[0]]))
        middle = np.frombuffer(b"".join(made), np.int32)
        lengths = np.array([len(code) // 4 for code in made], np.int32)
        return (
            whole,
            np.concatenate([ids[: at[first]], middle, ids[at[following] :]]),
            np.concatenate([counts[:first], lengths, counts[following:]]),
            len(made),
        )


def decode(tokens: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def _read(lines: Iterator[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _path(name: str) -> str:
    """A path, or the place of a file of the public collection."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_tokens(name: str) -> list[bytes]:
    """The bytes of every id, which is all that decoding needs."""
    with open(_path(name), "rb") as lines:
        ids = _read(lines)
    tokens = [b""] * (max(ids.values()) + 1)
    for token, rank in ids.items():
        tokens[rank] = token
    return tokens


@lru_cache(maxsize=4)
def load(name: str, pattern: str | None = None) -> Coder:
    """The coder of a rank file: a path, or a file of the public collection with its pattern."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(_path(name), "rb") as lines:
        return Coder(Ranks(lines), pattern)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    edges = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=edges[1:])
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([np.empty(0, np.int32), *parts])))


def _row_blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about ``BATCH_BYTES``; a larger row stands alone."""
    low, total = 0, np.concatenate([[0], np.cumsum(sizes)])
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(total, total[low] + BATCH_BYTES, "right")) - 1)
        yield low, high
        low = high


def _encode(name: str, pattern: str | None, kept: list[str], pieces: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(name, pattern)
        for batch in batches:
            texts = batch.column("__text")
            for low, high in _row_blocks(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)):
                own = [texts[i].as_py() for i in range(low, high)]
                if pieces:
                    coded = [coder.encode(text) for text in own]
                    made = [_lists([c[k] for c in coded]) for k in (0, 1)]
                else:
                    made = [_lists([coder.encode_ids(text) for text in own])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, high - low) for c in kept), *made], [*kept, *_MADE[: len(made)]]
                )

    return run


_IDS = T.ArrayType(T.IntegerType())
_MADE = ["ids", "piece_ids"]


def encode_texts(
    docs: DataFrame, ranks: str, pattern: str | None = None, text: str = "text", pieces: bool = False
) -> DataFrame:
    """``docs`` without its text, with ``ids``, and with ``piece_ids`` (the number of ids in each piece) if ``pieces`` are asked for.

    ``ranks`` is a rank file that every executor can read. Null and empty texts
    have no ids. Strings of special tokens are ordinary text. Rows are encoded one
    by one, repeated ones too; columns named like a result are replaced.
    """
    made = _MADE if pieces else _MADE[:1]
    kept = [c for c in docs.columns if c not in (text, *made)]
    rows = docs.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(c, _IDS) for c in made)])
    return rows.mapInArrow(_encode(ranks, pattern, kept, pieces), schema)


def _decode(name: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load_tokens(name)
        for batch in batches:
            lists = batch.column("__ids")
            edges, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            for low, high in _row_blocks(8 * np.diff(edges)):
                bodies = pa.array([decode(tokens, flat[a:z]) for a, z in zip(edges[low:high], edges[low + 1 : high + 1])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(low, high - low) for c in kept), bodies], [*kept, "decoded"])

    return run


def decode_ids(coded: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """``coded`` with the bytes that its ids stand for as ``decoded``; a null list has none. Any list of ids can be decoded."""
    kept = [c for c in coded.columns if c != "decoded"]
    rows = coded.select(*kept, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("__ids"))
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())])
    return rows.mapInArrow(_decode(ranks, kept), schema)


def _edit(name: str, pattern: str | None, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(name, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                done = [
                    coder.edit(r["text"] or "", np.array(r["ids"] or [], np.int32), np.array(r["piece_ids"] or [], np.int32), r["begin"], r["end"], r["new"] or "")
                    for r in part.select(["text", "ids", "piece_ids", "begin", "end", "new"]).to_pylist()
                ]
                columns = [pa.array([d[0] for d in done]), _lists([d[1] for d in done]), _lists([d[2] for d in done])]
                again = pa.array([d[3] for d in done], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), *columns, again], [*kept, "text", "ids", "piece_ids", "pieces_again"]
                )

    return run


def edit_texts(coded: DataFrame, ranks: str, pattern: str | None = None) -> DataFrame:
    """Texts with one edit each and their ids, encoded anew only near the edit.

    ``coded`` has ``text``, its ``ids`` and ``piece_ids``, and ``new`` to be put in
    place of the characters from ``begin`` to ``end``; appending is an edit at the
    end. Places beyond the text count as its end, a null ``begin`` or ``end`` too. ``pieces_again`` counts
    the pieces that were encoded anew. Other columns are kept.
    """
    used = ("text", "ids", "piece_ids", "begin", "end", "new")
    kept = [c for c in coded.columns if c not in (*used, "pieces_again")]
    size = F.char_length(F.coalesce("text", F.lit("")))
    begin = F.greatest(F.least(F.coalesce("begin", size), size), F.lit(0)).cast("int")
    rows = coded.withColumn("begin", begin).withColumn("end", F.greatest(F.least(F.coalesce("end", size), size), "begin").cast("int"))
    schema = T.StructType(
        [*(coded.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("ids", _IDS), T.StructField("piece_ids", _IDS), T.StructField("pieces_again", T.IntegerType())]
    )
    return rows.select(*kept, *used).mapInArrow(_edit(ranks, pattern, kept), schema)
