"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Each of ``TABLES`` tables cuts ``PROJECTIONS`` random projections into cells; a
bucket is a combination of cells. A query visits, in each table, its own bucket and
the perturbed ones in the order of their estimated success: the nearer its
projection lies to the border of a cell, the likelier a neighbour is beyond it.
Candidates of all tables are merged and ranked by the exact inner product.

To make inner products a matter of distance, vectors get one more component that
brings them to the largest norm, queries none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.plans.materialize import materialize

TABLES, PROJECTIONS, CELL = 4, 8, 2.0
#: Buckets that a query visits in a table: as many as ``TRIALS`` queries need for ``RECALL``; so many are tried first.
RECALL, TRIALS, FIRST_PROBES = 0.95, 64, 3000
#: More than the error of an inner product in relation to the norms, in whatever order it is added up.
SLACK = 1e-12
#: Vectors that one task compares at once; a larger bucket is split.
PART_ROWS = 8192
#: Queries that one task compares with a part; more of them are dealt to several tasks.
PART_QUERIES = 16384
_QUERY_BLOCK = 256


@dataclass
class Hashing:
    """Random projections of ``width + 1`` components; ``norm`` is the largest of any vector."""

    width: int
    norm: float
    tables: int = TABLES
    projections: int = PROJECTIONS
    cell: float = CELL
    probes: int = FIRST_PROBES
    seed: int = 0

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.directions = rng.standard_normal((self.tables, self.width + 1, self.projections))
        self.shifts = rng.uniform(0, 1, (self.tables, 1, self.projections))

    def project(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Places on the projections, in cells: tables x rows x projections."""
        unit = vectors / self.norm
        if query:
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
            more = np.zeros(len(unit))
        else:
            more = np.sqrt(np.maximum(1 - (unit**2).sum(axis=1), 0))
        wide = np.column_stack([unit, more])
        return np.stack([wide @ d for d in self.directions]) / self.cell + self.shifts

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        """One number for each combination of cells (last axis)."""
        out = np.zeros(cells.shape[:-1], np.uint64)
        for k in range(cells.shape[-1]):
            out = (out ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def perturbations(self) -> list[tuple[int, ...]]:
        """Sets of ranks of single steps, cheapest first for the expected costs; a step and its opposite exclude each other."""
        m = self.projections
        # expected squared distance to a border for the r-th nearest of 2m borders
        cost = [(r * (r + 1)) / (4 * (m + 1) * (m + 2)) for r in range(1, m + 1)]
        cost += [1 - (2 * m + 1 - r) / (m + 1) + (2 * m + 1 - r) * (2 * m + 2 - r) / (4 * (m + 1) * (m + 2)) for r in range(m + 1, 2 * m + 1)]
        found: list[tuple[int, ...]] = [()]
        heap = [(cost[0], (0,))]
        while heap and len(found) < self.probes:
            total, steps = heapq.heappop(heap)
            if all(2 * m - 1 - s not in steps for s in steps):
                found.append(steps)
            last = steps[-1]
            if last + 1 < 2 * m:
                heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*steps[:-1], last + 1)))
                heapq.heappush(heap, (total + cost[last + 1], (*steps, last + 1)))
        return found

    def visits(self, places: np.ndarray) -> np.ndarray:
        """Buckets to visit: rows x probes, for the places of queries in one table."""
        home = np.floor(places).astype(np.int64)
        inner = places - home
        steps = np.concatenate([inner**2, (1 - inner) ** 2], axis=1).argsort(axis=1, kind="stable")
        axis, way = steps % self.projections, np.where(steps < self.projections, -1, 1)
        rows = np.arange(len(places))
        out = []
        for chosen in self.perturbations():
            cells = home.copy()
            for rank in chosen:
                np.add.at(cells, (rows, axis[:, rank]), way[:, rank])
            out.append(self.bucket(cells))
        return np.stack(out, axis=1)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors that are stored as bytes."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.float64).reshape(-1, width)


def _ids(table: pa.Table | pa.RecordBatch, name: str = "id") -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which of them are null."""
    column = table.column(name)
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _own(asked: pa.Table | pa.RecordBatch, rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Which rows are a query's own (queries x rows): the row itself, or for queries from elsewhere those of its id."""
    (names, _), (ids, unnamed) = _ids(asked, "query_id"), _ids(rows)
    own = asked.column("query").to_numpy(zero_copy_only=False)[:, None] == rows.column("row").to_numpy(zero_copy_only=False)
    by_id = asked.column("by_id").to_numpy(zero_copy_only=False)
    return own | (by_id[:, None] & (names[:, None] == ids) & ~unnamed)


def _index(hashing: Hashing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                places = hashing.project(_matrix(part.column("vector"), hashing.width), query=False)
                for t in range(hashing.tables):
                    bucket = hashing.bucket(np.floor(places[t]).astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(part.num_rows, t, np.int32)), pa.array(bucket), *(part.column(c) for c in ("row", "id", "vector"))],
                        ["table", "bucket", "row", "id", "vector"],
                    )

    return run


def _visits(hashing: Hashing, parts: int):
    """A row for every part that a query visits, with the buckets it wants there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                asked = batch.slice(low, 512)
                places = hashing.project(_matrix(asked.column("vector"), hashing.width), query=True)
                for t in range(hashing.tables):
                    bucket = hashing.visits(places[t])
                    query = np.repeat(np.arange(asked.num_rows), bucket.shape[1])
                    home = np.repeat(bucket[:, 0] % parts, bucket.shape[1])
                    flat = bucket.ravel()
                    order = np.lexsort((flat % parts, query))
                    query, part, flat, home = query[order], (flat % parts)[order], flat[order], home[order]
                    first = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (part[1:] != part[:-1])])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(first), t, np.int32)),
                            pa.array(part[first]),
                            pa.array(part[first] == home[first]),
                            *(asked.column(c).take(pa.array(query[first])) for c in _QUERY),
                            pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)).astype(np.int32)), pa.array(flat)),
                        ],
                        ["table", "part", "home", *_QUERY, "buckets"],
                    )

    return run


def _nearest(width: int, k: int):
    schema = pa.schema(
        [("query", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
    )

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        (ids, unnamed), vectors = _ids(rows), _matrix(rows.column("vector"), width)
        row = rows.column("row").to_numpy()
        longest = np.sqrt((vectors**2).sum(axis=1).max())
        buckets, which = np.unique(rows.column("bucket").to_numpy(), return_inverse=True)
        wanted = _matrix(queries.column("vector"), width)
        lists = queries.column("buckets").combine_chunks()
        edges, flat = np.asarray(lists.offsets), np.asarray(lists.flatten())
        enough = queries.column("enough").to_numpy()
        out = []
        for low in range(0, len(wanted), _QUERY_BLOCK):
            high = min(low + _QUERY_BLOCK, len(wanted))
            visited = np.zeros((high - low, len(buckets)), bool)
            own = flat[edges[low] - edges[0] : edges[high] - edges[0]]
            at = np.minimum(np.searchsorted(buckets, own), len(buckets) - 1)
            there = buckets[at] == own
            visited[np.repeat(np.arange(high - low), np.diff(edges[low : high + 1]))[there], at[there]] = True
            rough = np.where(visited[:, which], wanted[low:high] @ vectors.T, -np.inf)
            rough[_own(queries.slice(low, high - low), rows)] = -np.inf
            least = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(high - low, -np.inf)
            least = np.maximum(least, enough[low:high])  # what the query has found already
            slack = SLACK * longest * np.sqrt((wanted[low:high] ** 2).sum(axis=1))
            q, v = np.nonzero((rough >= (least - slack)[:, None]) & np.isfinite(rough))
            # the product again, each in the same order of addition, so that equal vectors tie
            score = (wanted[low + q] * vectors[v]).sum(axis=1)
            order = np.lexsort((row[v], ids[v], unnamed[v], -score, q))
            q, v, score = q[order], v[order], score[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            best = rank < k
            asked, found = pa.array(low + q[best]), pa.array(v[best])
            out.append(
                pa.table(
                    [
                        queries.column("query").take(asked), queries.column("query_id").take(asked),
                        rows.column("row").take(found), rows.column("id").take(found), pa.array(score[best]),
                    ],
                    schema=schema,
                )
            )
        return pa.concat_tables(out)

    return run


def _exact(asked: pa.Table, width: int, k: int):
    """The ``k`` best rows of every batch for a few queries."""
    queries = _matrix(asked.column("vector"), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"), width)
            scores = np.where(_own(asked, batch), -np.inf, queries @ vectors.T)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            q, v = np.repeat(np.arange(len(queries)), best.shape[1]), best.ravel()
            some = np.isfinite(scores[q, v])
            q, v = q[some], v[some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(q), pa.array(scores[q, v]), batch.column("row").take(pa.array(v)), batch.column("vector").take(pa.array(v))],
                ["query", "score", "row", "vector"],
            )

    return run


def probes_needed(stored: DataFrame, asked: DataFrame, plan: Hashing, k: int, recall: float, trials: int, rows: int) -> int | None:
    """Probes a table that find ``recall`` of the true neighbours of ``trials`` queries, sought among all rows.

    None if no number below that of the rows is enough.
    """
    some = asked.orderBy(F.xxhash64("query_id", "query"), "query").limit(trials).toArrow()
    if not some.num_rows:
        return 1
    best = stored.mapInArrow(_exact(some, plan.width, k), "query bigint, score double, row bigint, vector binary")
    ranked = best.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "row")))
    true = ranked.where(F.col("nth") <= k).select("query", "vector").toArrow()
    if not true.num_rows:
        return 1
    of = true.column("query").to_numpy()
    places = plan.project(_matrix(true.column("vector"), plan.width), query=False)
    asked_at = plan.project(_matrix(some.column("vector"), plan.width), query=True)
    while True:
        tried = len(plan.perturbations())
        first = np.full(len(of), tried)
        for t in range(plan.tables):
            visited = plan.visits(asked_at[t])
            same = visited[of] == plan.bucket(np.floor(places[t]).astype(np.int64))[:, None]
            first = np.minimum(first, np.where(same.any(axis=1), same.argmax(axis=1), tried))
        needed = int(np.quantile(first, recall, method="higher"))
        if needed < tried:
            return needed + 1
        if tried < plan.probes or tried * plan.tables >= rows:
            return None  # no further buckets, or more of them than rows
        plan.probes *= 2


_QUERY = ["query", "query_id", "by_id", "vector"]


def usable_vectors(vectors: DataFrame, key: str, vector: str, keep: list[str] | None = None) -> DataFrame:
    """``(id, vector, width, norm)`` and ``keep``, without vectors that are null, empty, zero or hold a null or non-finite component.

    The vector is stored as bytes of doubles. Every row counts, also one that repeats an id.
    """
    keep = keep or []
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = (
        vectors.select(F.col(key).cast("bigint").alias("id"), wide.alias("vector"), *keep)
        .where(F.col("vector").isNotNull())
        .where(finite & F.exists("vector", lambda x: x != 0))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat, edges = np.asarray(lists.flatten(), np.float64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            rows = [flat[a:z] for a, z in zip(edges, edges[1:])]
            columns = [
                pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([len(r) for r in rows], pa.int32()),
                pa.array([float(np.sqrt((r * r).sum())) for r in rows], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns, *(batch.column(c) for c in keep)], ["id", "vector", "width", "norm", *keep])

    schema = T.StructType.fromDDL("id bigint, vector binary, width int, norm double")
    return good.mapInArrow(run, T.StructType([*schema.fields, *(good.schema[c] for c in keep)]))


def nearest(
    vectors: DataFrame,
    queries: DataFrame | Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    recall: float = RECALL,
    trials: int = TRIALS,
    part_queries: int = PART_QUERIES,
    **hashing: float,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each query among ``vectors``.

    ``queries`` is a condition on the rows of ``vectors`` that are asked for; such a
    row is no neighbour of its own. Or it is a table of its own, with the same two
    columns; then rows of a query's id are not among its neighbours. Larger inner
    products are nearer; ties go to the smaller id, null last. Null, zero and
    non-finite vectors, and vectors whose width differs from the most frequent one
    take no part. Rows that repeat an id or a whole row are rows, and queries, of
    their own; a null id is an id. Other columns are not read.

    ``trials`` queries are compared with all rows first; they set the number of
    probes that finds the share ``recall`` of their true neighbours, for all queries.
    Where no number of probes does, every query is compared with every row, and so
    is, in any case, a query that found fewer than ``k``.

    Parts of about ``PART_ROWS`` vectors hold whole buckets; a larger bucket is
    split over several, all of which its queries visit. A part that more than
    ``part_queries`` queries visit is compared by several tasks. A part keeps ``k``
    rows a query, so ties and hot buckets never widen the result.
    """
    inner = isinstance(queries, Column)
    marked = vectors.withColumn("__asked", F.coalesce(queries, F.lit(False))) if inner else vectors
    usable = usable_vectors(marked, key, vector, ["__asked"] if inner else [])
    kept = materialize(usable.withColumn("row", F.monotonically_increasing_id()))
    widths = kept.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"))
    most = widths.orderBy(F.desc("n"), "width").first()
    width, norm = (most["width"], most["norm"]) if most else (1, 1.0)
    even = kept.where(F.col("width") == width)
    stored = even.select("row", "id", "vector")
    if inner:
        asking = even.where("__asked").select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.lit(False).alias("by_id"), "vector")
    else:
        own = usable_vectors(queries, key, vector).where(F.col("width") == width)
        number = -1 - F.monotonically_increasing_id()
        asking = own.select(number.alias("query"), F.col("id").alias("query_id"), F.lit(True).alias("by_id"), "vector")
    asked = materialize(asking)
    plan, count = Hashing(width, norm, **hashing), stored.count()
    parts = max(1, -(-count // PART_ROWS))
    probes = probes_needed(stored, asked, plan, k, recall, trials, count)
    if probes is None:
        found = _best(_everything(stored, asked, parts, width, k, part_queries), k)
    else:
        plan.probes = probes
        found = materialize(_multiprobe(stored, asked, plan, parts, k, part_queries))
        few = materialize(asked.join(found.where(F.size("best") == k).select("query"), "query", "left_anti"))
        if few.limit(1).count():
            more = _best(_everything(stored, few, parts, width, k, part_queries), k)
            found = found.where(F.size("best") == k).unionByName(more)
    return found.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", "b.score"
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of what was found for each query, a row once."""
    merged = found.groupBy("query", "query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    far = F.struct((-F.col("score")).alias("far"), F.col("vec_id").isNull().alias("unnamed"), "vec_id", "row", "score")
    # at most k rows of each part that a query visits
    return merged.groupBy("query", "query_id").agg(F.slice(F.array_sort(F.collect_list(far)), 1, k).alias("best"))


def _compare(asking: DataFrame, rows: DataFrame, width: int, k: int, part_queries: int) -> DataFrame:
    """The nearest rows of every part that a query visits; a part that very many visit goes to several tasks, each with its own lot of queries."""
    lots = materialize(asking.groupBy("table", "part").agg(F.ceil(F.count(F.lit(1)) / part_queries).alias("lots")))
    some = asking.join(lots, ["table", "part"]).withColumn("lot", F.pmod(F.xxhash64("query"), F.col("lots")))
    wanted = rows.join(lots, ["table", "part"]).withColumn(
        "lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1))
    )
    return (
        some.drop("lots")
        .groupBy("table", "part", "lot")
        .cogroup(wanted.drop("lots").groupBy("table", "part", "lot"))
        .applyInArrow(_nearest(width, k), "query bigint, query_id bigint, row bigint, vec_id bigint, score double")
    )


def _everything(stored: DataFrame, asked: DataFrame, parts: int, width: int, k: int, part_queries: int) -> DataFrame:
    """The nearest of all rows: one bucket, in parts, which every query visits."""
    none = F.lit(0).cast("bigint")
    rows = stored.select(F.lit(0).alias("table"), F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part"), none.alias("bucket"), "row", "id", "vector")
    every = F.explode(F.sequence(none, F.lit(parts - 1).cast("bigint")))
    visits = asked.select(F.lit(0).alias("table"), every.alias("part"), *_QUERY, F.array(none).alias("buckets"))
    return _compare(visits.withColumn("enough", F.lit(float("-inf"))), rows, width, k, part_queries)


def _multiprobe(stored: DataFrame, asked: DataFrame, plan: Hashing, parts: int, k: int, part_queries: int) -> DataFrame:
    index = stored.mapInArrow(_index(plan), "table int, bucket bigint, row bigint, id bigint, vector binary")
    large = materialize(
        index.groupBy("table", "bucket")
        .count()
        .where(F.col("count") > PART_ROWS)
        .select("table", "bucket", F.ceil(F.col("count") / PART_ROWS).alias("pieces"))
    )
    # a bucket lies in the part of its number, a large one in the parts from there on
    piece = F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")), F.lit(0))
    rows = materialize(
        index.join(large, ["table", "bucket"], "left").select(
            "table", F.pmod(F.col("bucket") + piece, F.lit(parts)).alias("part"), "bucket", "row", "id", "vector"
        )
    )
    visits = materialize(
        asked.mapInArrow(
            _visits(plan, parts),
            "table int, part bigint, home boolean, query bigint, query_id bigint, by_id boolean, vector binary, buckets array<bigint>",
        )
    )
    further = (
        visits.select("table", "part", "home", *_QUERY, F.explode("buckets").alias("bucket"))
        .join(large, ["table", "bucket"])
        .withColumn("piece", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("pieces") - 1)))
        .withColumn("part", F.pmod(F.col("bucket") + F.col("piece"), F.lit(parts)))
        .groupBy("table", "part", "query", "query_id", "by_id")
        .agg(F.first("vector").alias("vector"), F.collect_set("bucket").alias("buckets"))  # at most a table's probes
        .select("table", "part", F.lit(False).alias("home"), *_QUERY, "buckets")
    )
    # the parts with the queries' own buckets first: what they yield bounds what the others need to return
    at_home = visits.where("home").withColumn("enough", F.lit(float("-inf")))
    near = materialize(_best(_compare(at_home, rows, plan.width, k, part_queries), k))
    bound = near.where(F.size("best") == k).select("query", F.element_at("best", k)["score"].alias("enough"))
    abroad = visits.where("not home").unionByName(further).join(bound, "query", "left")
    rest = _compare(abroad.withColumn("enough", F.coalesce("enough", F.lit(float("-inf")))), rows, plan.width, k, part_queries)
    first = near.select("query", "query_id", F.explode("best").alias("b")).select("query", "query_id", "b.row", "b.vec_id", "b.score")
    return _best(first.unionByName(rest), k)
