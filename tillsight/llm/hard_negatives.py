"""Hard negatives for contrastive training: rows of another label that score a given share of a positive's score.

Scores are inner products of integer vectors. Every row stores its angles to
``REFERENCES`` directions. By the triangle inequality on the sphere the angle
between an anchor and a row is at least the difference of their angles to any
reference and at most their sum; the cosines of the tightest pair of these, times
both norms, bound the score. Bounds are widened by more than all rounding, so a
row outside an anchor's windows is left out for certain, and only rows whose bounds
meet a window are scored, in integers. Bounds are taken three times: for a row and
all anchors of a cell before the row is sent there, for runs of rows of similar
angles, and for pairs.

An anchor's positives are found the same way with a window that is open above and
rises with the best found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.integers import commonest_width, matrix, rows_of, scaled, usable
from tillsight.plans.materialize import drop, materialize

#: Directions, and the most rows that they are chosen from.
REFERENCES, SAMPLE = 16, 2048
#: Rows and anchors that one task compares.
BLOCK_ROWS, LOT_ROWS = 4096, 4096
#: Rows bounded together, rows scored between two looks at the best found, anchors compared at once.
RUN, STEP, ANCHORS = 64, 1024, 128
#: A scaled component's limit; with norms below it times the root of the width, scores times 100 fit 64 bits.
LIMIT = 1 << 24
#: More than the error of a stored angle, and of a cosine times two norms in relation to them.
ANGLE_SLACK, SCORE_SLACK = 2e-6, 1e-9

_LEAST, _MOST = -(1 << 62), 1 << 62


def choose_references(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` unit directions: rows of the sample far from each other, moved to the middle of those nearest to them."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.eye(sample.shape[1])[:1]
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(count, len(unit)) and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    refs = unit[chosen]
    for _ in range(3):
        home = (unit @ refs.T).argmax(axis=1)
        middle = np.zeros_like(refs)
        np.add.at(middle, home, unit)
        size = np.linalg.norm(middle, axis=1, keepdims=True)
        refs = np.where(size > 1e-9, middle / np.maximum(size, 1e-9), refs)
    return refs


def angles_to(vectors: np.ndarray, norms: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angles of rows to directions; those of a zero vector, whose scores are zero at any angle, are right."""
    return np.arccos(np.clip(vectors @ refs.T / np.maximum(norms, 1e-300)[:, None], -1, 1))


@dataclass
class Extent:
    """Least and largest angles (items x references) and norms of items: rows, runs of rows or cells."""

    near: np.ndarray
    far: np.ndarray
    short: np.ndarray
    long: np.ndarray

    @classmethod
    def of(cls, angles: np.ndarray, norms: np.ndarray) -> Extent:
        return cls(angles, angles, norms, norms)

    def runs(self, size: int) -> Extent:
        at = np.arange(0, len(self.short), size)
        return Extent(
            np.minimum.reduceat(self.near, at), np.maximum.reduceat(self.far, at),
            np.minimum.reduceat(self.short, at), np.maximum.reduceat(self.long, at),
        )

    def __getitem__(self, which: np.ndarray | slice) -> Extent:
        return Extent(self.near[which], self.far[which], self.short[which], self.long[which])


def score_bounds(one: Extent, two: Extent) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of any members of the items of ``one`` (rows) and ``two`` (columns)."""
    low = np.zeros((len(one.short), len(two.short)))
    high = np.full_like(low, np.pi)
    for r in range(one.near.shape[1]):
        a, b = one.near[:, r, None], one.far[:, r, None]
        c, d = two.near[None, :, r], two.far[None, :, r]
        np.maximum(low, np.maximum(a - d, c - b), out=low)
        # at most the sum; and at most what is left of a full turn
        np.minimum(high, np.minimum(b + d, 2 * np.pi - a - c), out=high)
    least, most = np.cos(np.minimum(high + ANGLE_SLACK, np.pi)), np.cos(np.maximum(low - ANGLE_SLACK, 0))
    small, large = np.outer(one.short, two.short), np.outer(one.long, two.long)
    slack = SCORE_SLACK * large + 1e-3
    return np.where(least < 0, large, small) * least - slack, np.where(most < 0, small, large) * most + slack


def _integer_scores(one: np.ndarray, two: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products: in doubles while every partial sum fits 53 bits."""
    if largest < 2**53:
        return (one.astype(np.float64) @ two.T.astype(np.float64)).astype(np.int64)
    return one @ two.T


@dataclass
class Rows:
    row: np.ndarray
    id: np.ndarray
    unnamed: np.ndarray
    label: np.ndarray
    ints: np.ndarray
    extent: Extent

    @classmethod
    def read(cls, table: pa.Table, width: int) -> Rows:
        norms = table.column("norm").to_numpy()
        angles = table.column("angles").combine_chunks()
        return cls(
            table.column("row").to_numpy(),
            table.column("id").fill_null(0).to_numpy(),
            table.column("id").is_null().to_numpy(zero_copy_only=False),
            table.column("label").to_numpy(),
            matrix(table.column("ints"), width),
            Extent.of(matrix(angles, len(angles.flatten()) // max(1, len(angles)), np.float64), norms),
        )

    def __getitem__(self, which: np.ndarray) -> Rows:
        return Rows(self.row[which], self.id[which], self.unnamed[which], self.label[which], self.ints[which], self.extent[which])


def search(anchors: Rows, rows: Rows, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """The ``k`` best rows in each window of each anchor: ``(anchor, window, place among the rows, score)``, and the pairs scored.

    ``low`` and ``high`` are inclusive, anchors x windows. Only rows of the
    anchor's label count, or only those of another one; the anchor itself never.
    """
    found: list[np.ndarray] = [np.empty(0, np.int64)] * 4  # anchor, window, place, score
    runs, low, scored = rows.extent.runs(RUN), low.copy(), 0
    least, most = score_bounds(anchors.extent, runs)
    # runs that may hold the best first, so that windows rise early
    order = np.argsort(-most.max(axis=0), kind="stable")
    for begin in range(0, len(order), max(1, STEP // RUN)):
        some = order[begin : begin + max(1, STEP // RUN)]
        floor, top = low.min(axis=1), high.max(axis=1)
        some = some[((most[:, some] >= floor[:, None]) & (least[:, some] <= top[:, None])).any(axis=0)]
        if not len(some):
            continue
        v = (some[:, None] * RUN + np.arange(RUN)).ravel()
        v = v[v < len(rows.row)]
        below, above = score_bounds(anchors.extent, rows.extent[v])
        label = anchors.label[:, None] == rows.label[None, v]
        wanted = (above >= floor[:, None]) & (below <= top[:, None]) & (label if same else ~label)
        wanted &= anchors.row[:, None] != rows.row[None, v]
        a = np.flatnonzero(wanted.any(axis=1))
        keep = wanted.any(axis=0)
        if not len(a):
            continue
        v, wanted = v[keep], wanted[np.ix_(a, keep)]
        scored += wanted.size
        largest = anchors.extent.long[a].max() * rows.extent.long[v].max()
        scores = _integer_scores(anchors.ints[a], rows.ints[v], largest * (1 + 1e-9) + 1)
        for w in range(low.shape[1]):
            inside = wanted & (scores >= low[a, w, None]) & (scores <= high[a, w, None])
            if len(v) > k:  # no less than the k-th of these can matter
                inside &= scores >= np.partition(np.where(inside, scores, _LEAST), -k, axis=1)[:, -k, None]
            i, j = np.nonzero(inside)
            if not len(i):
                continue
            parts = (a[i], np.full(len(i), w), v[j], scores[i, j])
            found = _best([np.concatenate(p) for p in zip(found, parts)], rows, k)
        full = np.zeros(low.shape, np.int64)
        np.add.at(full, (found[0], found[1]), 1)
        last = np.full(low.shape, _MOST)
        np.minimum.at(last, (found[0], found[1]), found[3])
        low = np.where(full >= k, np.maximum(low, last), low)
    return (*found, scored)


def _best(found: list[np.ndarray], rows: Rows, k: int) -> list[np.ndarray]:
    """The first ``k`` of each anchor's window: higher scores, then smaller ids, null last."""
    anchor, window, place, score = found
    order = np.lexsort((rows.row[place], rows.id[place], rows.unnamed[place], -score, window, anchor))
    anchor, window, place, score = (x[order] for x in (anchor, window, place, score))
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    keep = np.arange(len(new)) - start < k
    return [x[keep] for x in (anchor, window, place, score)]


def _windows(targets: list[np.ndarray], share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest scores between two percentages of each target, inclusive; missing targets have none."""
    most = max(map(len, targets), default=0)
    low, high = np.full((len(targets), most), _MOST), np.full((len(targets), most), _LEAST)
    for i, t in enumerate(targets):
        low[i, : len(t)], high[i, : len(t)] = -(-share[0] * t // 100), share[1] * t // 100
    return low, high


def _compare(width: int, k: int, share: tuple[int, int] | None):
    """The search of one lot of anchors among one block of rows; without ``share``, for rows of the same label at any score."""
    schema = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(asked: pa.Table, table: pa.Table) -> pa.Table:
        if not asked.num_rows or not table.num_rows:
            return schema.empty_table()
        anchors, rows, out = Rows.read(asked, width), Rows.read(table, width), []
        own = rows.extent.near.argmin(axis=1)
        rows = rows[np.lexsort((rows.extent.near[np.arange(len(own)), own], own))]
        for begin in range(0, len(anchors.row), ANCHORS):
            some = anchors[slice(begin, begin + ANCHORS)]
            if share is None:
                low, high = np.full((len(some.row), 1), _LEAST + 1), np.full((len(some.row), 1), _MOST)
            else:
                targets = [np.array(t, np.int64) for t in asked.column("targets").slice(begin, ANCHORS).to_pylist()]
                low, high = _windows(targets, share)
            a, w, v, score, _ = search(some, rows, low, high, k, same=share is None)
            id = pa.array(rows.id[v], pa.int64(), mask=rows.unnamed[v])
            out.append(pa.table([some.row[a], w.astype(np.int32), rows.row[v], id, score], schema=schema))
        return pa.concat_tables(out)

    return run


def _index(width: int, refs: np.ndarray, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                vectors = matrix(part.column("ints"), width, np.float64)
                norms = np.linalg.norm(vectors, axis=1)
                angles = angles_to(vectors, norms, refs)
                cell = angles[:, :cells].argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(norms), rows_of(angles, pa.float32()), pa.array(cell)],
                    [*part.schema.names, "norm", "angles", "cell"],
                )

    return run


def _routes(cells: list[tuple[int, Extent, float, float]]):
    """For every row the cells that hold an anchor with a window it may be in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = batch.column("angles")
            angles = matrix(angles, len(angles.flatten()) // max(1, len(angles)), np.float64)
            rows = Extent.of(angles, batch.column("norm").to_numpy())
            for to, extent, low, high in cells:
                below, above = score_bounds(extent, rows)
                at = np.flatnonzero((above[0] >= low) & (below[0] <= high))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(at)) for c in batch.schema.names), pa.array(np.full(len(at), to, np.int32))],
                    [*batch.schema.names, "to"],
                )

    return run


_PLACED = "row bigint, id bigint, label bigint, ints array<int>, norm double, angles array<float>, cell int"


def _against(rows: DataFrame, asked: DataFrame, width: int, k: int, share: tuple[int, int] | None, block: int, lot: int) -> DataFrame:
    """The ``k`` best rows of each window of the rows of ``asked``, ranked from 1."""
    refs = len(rows.select("angles").first()["angles"])
    if share is None:
        low, high = F.lit(float(_LEAST)), F.lit(float(_MOST))
    else:
        low = F.array_min(F.transform("targets", lambda t: t * float(share[0]) / 100)) - 1
        high = F.array_max(F.transform("targets", lambda t: t * float(share[1]) / 100)) + 1
    edges = [f(F.col("angles")[r]).alias(f"{f.__name__}{r}") for r in range(refs) for f in (F.min, F.max)]
    # one row for each cell, and there are no more cells than references
    cells = asked.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("norm").alias("short"), F.max("norm").alias("long"), F.min(low).alias("low"), F.max(high).alias("high"), *edges
    ).collect()
    if not cells:
        return rows.sparkSession.createDataFrame([], "anchor bigint, window int, row bigint, id bigint, score bigint, rank int")
    routes = [
        (
            c["cell"],
            Extent(*(np.array([[c[f"{f}{r}"] for r in range(refs)]], float) for f in ("min", "max")), np.array([c["short"]]), np.array([c["long"]])),
            c["low"], c["high"],
        )
        for c in cells
    ]
    lots = F.create_map(*[F.lit(x) for c in cells for x in (c["cell"], -(-c["n"] // lot))])
    sizes = rows.groupBy("cell").count().collect()
    pieces = F.create_map(*[F.lit(x) for c in sizes for x in (c["cell"], -(-c["count"] // block))])
    placed = rows.select("row", "id", "label", "ints", "norm", "angles", "cell")
    sent = (
        placed.mapInArrow(_routes(routes), f"{_PLACED}, to int")
        .withColumn("piece", F.pmod(F.xxhash64("row"), pieces[F.col("cell")].cast("bigint")))
        .withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), lots[F.col("to")].cast("bigint") - 1)))
    )
    kinds = F.explode(F.array(*[F.struct(F.lit(c["cell"]).alias("cell"), F.lit(-(-c["count"] // block)).alias("n")) for c in sizes]))
    asking = (
        asked.withColumn("to", F.col("cell"))
        .withColumn("lot", F.pmod(F.xxhash64("row"), lots[F.col("cell")].cast("bigint")))
        .withColumn("block", kinds)
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block.n").cast("bigint") - 1)))
        .withColumn("cell", F.col("block.cell"))
        .drop("block")
    )
    key = ["to", "lot", "cell", "piece"]
    found = (
        asking.groupBy(*key)
        .cogroup(sent.groupBy(*key))
        .applyInArrow(_compare(width, k, share), "anchor bigint, window int, row bigint, id bigint, score bigint")
    )
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Callable[[Column], Column],
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    share: tuple[int, int] = (30, 90),
    references: int = REFERENCES,
    block: int = BLOCK_ROWS,
    lot: int = LOT_ROWS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become ``floor(scale * x)``; a score is the integer inner product.
    An anchor's positives are its ``positives`` best other rows of its label. For
    each, the ``negatives`` best rows of another label are returned whose score is
    between ``share[0]`` and ``share[1]`` percent of the positive's, both included;
    a positive with a negative score has none. Equal scores go by smaller ids, null
    last. ``is_anchor`` tells anchors by the id.

    Rows with a null label, and vectors that are null, empty or have a null or
    non-finite component take no part, nor do those of another width than the most
    frequent one or with a scaled component of ``LIMIT`` or more in size. Zero
    vectors do, with scores of zero. Rows that repeat an id or a whole row are rows of
    their own. Labels are integers. Other columns are not read.

    Anchors are dealt to lots and rows to blocks by the nearest of a few references
    and a hash, so no label, direction or repeated vector fills a task.
    """
    spark = vectors.sparkSession
    good = vectors.where(F.col(label).isNotNull() & usable(vector, scale, LIMIT))
    kept = materialize(
        good.select(
            F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("id"),
            F.col(label).cast("bigint").alias("label"), scaled(vector, scale).alias("ints"),
        )
    )
    width = commonest_width(kept, "ints")
    if not width:
        return spark.createDataFrame(
            [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        )
    even = kept.where(F.size("ints") == width)
    sample = even.orderBy(F.xxhash64("ints", "row")).select("ints").limit(SAMPLE).toArrow()
    refs = choose_references(matrix(sample.column("ints"), width, np.float64), references)
    asking = F.coalesce(is_anchor(F.col("id")), F.lit(False))
    cells = min(len(refs), max(1, -(-even.where(asking).count() // lot)))
    rows = materialize(even.mapInArrow(_index(width, refs, cells), _PLACED))
    drop(kept)
    anchors = rows.where(asking)
    near = materialize(_against(rows, anchors, width, positives, None, block, lot))
    targets = near.groupBy(F.col("anchor").alias("row")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda t: t["score"]).alias("targets")
    )
    asked = materialize(anchors.join(targets, "row"))
    far = _against(rows, asked, width, negatives, share, block, lot).select(
        "anchor", (F.col("window") + 1).alias("positive"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    of = near.select("anchor", F.col("rank").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return (
        far.join(of, ["anchor", "positive"])
        .join(names, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
