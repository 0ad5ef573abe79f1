"""Vector compression by product codes: integer k-means in each part of the vectors, with adaptive distance bounds.

Every part of every row keeps a list of its ``b`` closest entries with a lower bound
of its distance to each, one lower bound for all entries outside the list, and an
upper bound for the entry it is assigned to. They are stored with the row from one
round to the next. When entries move, bounds give way by as much; made monotone
from the outside in, the n-th bound holds for the n-th entry of the list and all
behind it. A part whose upper bound stays below the next lower bound keeps its
entry unseen. Otherwise integer distances are taken to the entries before the first
bound that is certainly larger, and to all entries only if even the outer bound is
not. Bounds decide nothing that rounding could change, so codes are exact.

Lists are shortened to the length that the parts turned out to need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.llm.integers import commonest_width, matrix, rows_of, scaled, usable
from tillsight.plans.materialize import drop, materialize

#: A scaled component's limit: squared distances fit 64 bits for up to 4,096 components.
LIMIT = 1 << 24
#: Entries in a list at first and at least.
LONGEST, SHORTEST = 16, 2
#: Share of the parts whose needs set the next length of the lists.
SERVED = 0.98
#: Rows that are compared with all entries at once.
ROWS = 2048


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * largest**2 < 2**53:
        a, c = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


@dataclass
class Nearest:
    """Lists of the closest entries of parts: ``entries[:, 0]`` is the assigned one.

    ``bounds[:, 0]`` is at least the distance to it; ``bounds[:, n]`` at most the
    distance to entry ``n`` of the list, ``bounds[:, -1]`` to all others.
    """

    entries: np.ndarray
    bounds: np.ndarray
    #: entries that had to be looked at
    reach: np.ndarray
    distances: int = field(default=0)

    @classmethod
    def first(cls, x: np.ndarray, book: np.ndarray, length: int) -> Nearest:
        length = min(length, len(book))
        entries, bounds = np.empty((len(x), length), np.int16), np.empty((len(x), length + 1), np.float32)
        for low in range(0, len(x), ROWS):
            entries[low : low + ROWS], bounds[low : low + ROWS] = _closest(_distances(x[low : low + ROWS], book), length)
        return cls(entries, bounds, np.full(len(x), len(book), np.int16), len(x) * len(book))

    def moved(self, x: np.ndarray, book: np.ndarray, moves: np.ndarray, length: int) -> Nearest:
        """The lists after every entry has moved by at most ``moves``, cut to ``length``."""
        length = min(length, self.entries.shape[1])
        entries, wide = self.entries[:, :length].copy(), self.bounds.astype(np.float64)
        # what is cut off the lists joins the outside
        outer = np.minimum(wide[:, -1] - moves.max(initial=0), (wide[:, length:-1] - moves[self.entries[:, length:]]).min(axis=1, initial=np.inf))
        upper = wide[:, 0] + moves[entries[:, 0]]
        lower = np.column_stack([wide[:, 1:length] - moves[entries[:, 1:]], outer])
        lower = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]
        # less than any distance it stands for, whatever was rounded
        sure = np.where(np.isinf(lower), lower, lower - 1e-6 - 1e-9 * np.abs(np.where(np.isinf(lower), 0, lower)))
        reach, taken = np.zeros(len(x), np.int16), 0

        at = np.flatnonzero(upper >= sure[:, 0])
        own = ((x[at] - book[entries[at, 0]]) ** 2).sum(axis=1)
        upper[at], taken = np.sqrt(own), taken + len(at)
        at = at[upper[at] >= sure[at, 0]]
        # position of the first bound that is certainly larger: entries before it, the assigned one included
        within = upper[at, None] >= sure[at]
        need = np.where(within.all(axis=1), length + 1, within.argmin(axis=1) + 1)
        reach[at] = need

        listed = at[need <= length]
        if len(listed):
            need = need[need <= length]
            place = np.arange(length)[None, :] < need[:, None]
            r, c = np.nonzero(place)
            exact = np.full(place.shape, np.iinfo(np.int64).max)
            chosen = entries[listed]
            exact[r, c] = ((x[listed[r]] - book[chosen[r, c]]) ** 2).sum(axis=1)
            taken += len(r)
            order = np.lexsort((np.where(place, chosen, np.arange(length) + len(book)), exact), axis=1)
            chosen, exact = np.take_along_axis(chosen, order, 1), np.take_along_axis(exact, order, 1)
            roots = np.sqrt(exact.astype(np.float64))
            entries[listed], upper[listed] = chosen, roots[:, 0]
            kept = lower[listed]
            kept[:, :-1] = np.where(place[:, 1:], roots[:, 1:], kept[:, :-1])
            lower[listed] = kept

        bounds = np.column_stack([_up(upper), _down(lower)])
        rest = at[reach[at] > length]
        reach[rest] = len(book)
        for low in range(0, len(rest), ROWS):
            some = rest[low : low + ROWS]
            entries[some], bounds[some] = _closest(_distances(x[some], book), length)
        return Nearest(entries, bounds, reach, taken + len(rest) * len(book))


def _closest(distances: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``length`` closest entries, of equal ones the lower first, and the bounds of a list."""
    count = distances.shape[1]
    if length < count and int(distances.max(initial=0)) < 2**62 // count:
        keyed = distances * count + np.arange(count)  # distance, then index: no two are equal
        keyed = np.sort(np.partition(keyed, length, axis=1)[:, : length + 1], axis=1)
        order, nearest = keyed % count, keyed // count
    else:
        order = np.argsort(distances, axis=1, kind="stable")[:, : length + 1]
        nearest = np.take_along_axis(distances, order, 1)
    roots = np.sqrt(nearest.astype(np.float64))
    outer = roots[:, length:] if length < count else np.full((len(roots), 1), np.inf)
    bounds = np.column_stack([_up(roots[:, 0]), _down(roots[:, 1:length]), _down(outer)])
    return order[:, :length].astype(np.int16), bounds


def _parts(batch: pa.RecordBatch, width: int, parts: int) -> np.ndarray:
    """Vectors cut into parts (rows x parts x components), filled up with zeros where they cannot be equal."""
    x = matrix(batch.column("ints"), width)
    return np.pad(x, ((0, 0), (0, -width % parts))).reshape(len(x), parts, -1)


def _assign(books: np.ndarray, width: int, lengths: list[int], moves: np.ndarray | None):
    """Lists of all parts, made anew or brought up to date."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, near = _parts(batch, width, parts), []
            error = np.zeros(batch.num_rows, np.int64)
            for p in range(parts):
                part = np.ascontiguousarray(x[:, p])
                if moves is None:
                    near.append(Nearest.first(part, books[p], lengths[p]))
                else:
                    lists = [batch.column(f"{name}{p}") for name in ("entries", "bounds")]
                    size = len(lists[0].flatten()) // batch.num_rows
                    old = Nearest(matrix(lists[0], size), matrix(lists[1], size + 1, np.float32), None)
                    near.append(old.moved(part, books[p], moves[p], lengths[p]))
                error += ((part - books[p][near[p].entries[:, 0]]) ** 2).sum(axis=1)
            codes = rows_of(np.column_stack([n.entries[:, 0] for n in near]), pa.int32())
            reach = rows_of(np.column_stack([n.reach for n in near]), pa.int16())
            columns = [batch.column("row"), batch.column("ints"), codes, pa.array(error), reach]
            columns += [rows_of(n.entries, pa.int16()) for n in near] + [rows_of(n.bounds, pa.float32()) for n in near]
            names = ["row", "ints", "codes", "error", "reach", *(f"entries{p}" for p in range(parts)), *(f"bounds{p}" for p in range(parts))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _sums(width: int, parts: int, entries: int):
    """Sums and counts of the parts assigned to each entry: one row for each part and entry that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, -(-width // parts)), np.int64)
        count = np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes = _parts(batch, width, parts), matrix(batch.column("codes"), parts)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                for j in range(x.shape[2]):  # far below 2**53 in a batch
                    total[p, :, j] += np.bincount(codes[:, p], x[:, p, j], entries).astype(np.int64)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), rows_of(total[p, e], pa.int64())],
            ["part", "entry", "n", "sums"],
        )

    return run


def _means(state: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """Entries in the middle of their parts, rounded down; unused ones stay. As many numbers as the codebooks have reach the driver."""
    parts, entries, size = books.shape
    met = state.select("ints", "codes").mapInArrow(_sums(width, parts, entries), "part int, entry int, n bigint, sums array<bigint>")
    summed = met.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(size)])
    made = books.copy()
    for r in summed.collect():
        made[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(size)]
    return made


def _lengths(state: DataFrame, lengths: list[int], entries: int) -> list[int]:
    """Lengths that would have served all but a few parts in this round; no list grows."""
    needs = state.select(F.posexplode("reach").alias("part", "reach")).groupBy("part", "reach").count().collect()
    out = []
    for p, length in enumerate(lengths):
        looked = sorted((r["reach"], r["count"]) for r in needs if r["part"] == p and r["reach"] < entries)
        total, seen, wanted = sum(n for _, n in looked), 0, SHORTEST
        for reach, n in looked:
            if seen < SERVED * total:
                wanted = max(wanted, reach)
            seen += n
        out.append(min(length, wanted + 1) if looked else length)
    return out


@dataclass
class Codebooks:
    """``entries[part, entry]`` are integer vectors; components were scaled by ``scale`` and rounded down."""

    entries: np.ndarray
    scale: int
    width: int

    def sha256(self) -> str:
        """Of all components by part, entry and position, as decimal numbers between commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def restore(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that rows of codes stand for, in the middle of the rounded components."""
        chosen = self.entries[np.arange(len(self.entries)), codes]
        return (chosen.reshape(len(codes), -1)[:, : self.width] + 0.5) / self.scale


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    length: int = LONGEST,
) -> tuple[DataFrame, Codebooks]:
    """``vectors`` without its vector, with ``codes`` (an entry for each part) and ``error``, and the codebooks.

    Components become ``floor(scale * x)`` and vectors are cut into ``parts``
    consecutive parts. Each codebook starts as that part of the rows with the
    ``entries`` smallest keys (null last, equal keys by components), is moved to the
    means ``rounds`` times, and codes are of the last entries. Nearer means smaller
    squared distance, then lower index; means are rounded down and unused entries
    stay. ``error`` is the sum of the squared distances.

    Rows whose vector is null, empty or has a null or non-finite component take no
    part, nor do those of another width than the most frequent one or with a scaled
    component of ``LIMIT`` or more in size. Where parts cannot be equal, the last is
    filled up with zeros. Repeated rows are coded one by one. An empty table has empty
    codebooks. Columns named like a result are replaced.

    Rows and their lists are written to the shared folder in every round and those
    of the round before are deleted. Only codebooks and sums of their size pass the
    driver.
    """
    kept = [c for c in vectors.columns if c not in (vector, "codes", "error")]
    row = F.struct(*[F.col(c) for c in kept])
    good = vectors.where(usable(vector, scale, LIMIT)).select(row.alias("row"), scaled(vector, scale).alias("ints"))
    stored = materialize(good)
    width = commonest_width(stored, "ints")
    even = stored.where(F.size("ints") == width)
    first = even.orderBy(F.col("row")[key].asc_nulls_last(), "ints").select("ints").limit(entries).collect() if width else []
    size = -(-width // parts)
    start = np.array([r["ints"] for r in first], np.int64).reshape(len(first), width)
    books = np.pad(start, ((0, 0), (0, size * parts - width))).reshape(len(first), parts, size).transpose(1, 0, 2).copy()
    if not width:
        schema = T.StructType([*(vectors.schema[c] for c in kept), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
        return vectors.sparkSession.createDataFrame([], schema), Codebooks(books, scale, width)

    schema = f"codes array<int>, error bigint, reach array<smallint>, {', '.join(f'entries{p} array<smallint>' for p in range(parts))}, "
    schema += ", ".join(f"bounds{p} array<float>" for p in range(parts))
    schema = T.StructType([*stored.schema.fields, *T.StructType.fromDDL(schema).fields])
    lengths = [min(length, len(first))] * parts
    state = materialize(even.mapInArrow(_assign(books, width, lengths, None), schema))
    drop(stored)
    for _ in range(rounds):
        old, books = books, _means(state, books, width)
        moves = np.sqrt(((books - old).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-12)
        lengths = _lengths(state, lengths, len(first))
        following = materialize(state.mapInArrow(_assign(books, width, lengths, moves), schema))
        drop(state)
        state = following
    return state.select("row.*", "codes", "error"), Codebooks(books, scale, width)
