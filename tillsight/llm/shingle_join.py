"""Exact Jaccard join of word-shingle sets over an R-tree of count vectors.

1. Every whole text becomes its set of shingles. Texts with equal sets are one
   *node*; only nodes are compared.
2. Nodes are dealt out: a one-permutation sketch with refilled bins agrees in any
   bin with probability equal to the similarity; ``bands`` keys of ``rows`` bins
   each put two linked nodes into a common part. The numbers follow from the
   threshold such that a pair exactly at it is missed with probability below
   ``LOSS``; a more similar one is missed even more rarely.
3. Parts that share nodes are one cluster. In a cluster the shingles are hashed
   into ``GROUPS`` groups. The group counts are a point; an R-tree over the points
   is joined with itself. The overlap of two sets is at most the sum of the
   coordinate-wise minima, and that of two boxes at most the sum of the minima of
   their upper corners; a pair of boxes that cannot reach the threshold goes.
4. Surviving pairs are verified by exact intersection, unless both nodes are
   already connected; what leaves a task is a forest, not all pairs.

Large clusters are cut into blocks of bounded size and every pair of blocks is a
task of its own. Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm import bloom
from tillsight.llm import words as W
from tillsight.llm.components import connected_components
from tillsight.plans.materialize import drop, materialize

LOSS = 1e-10
GROUPS = 64
LEAF, FAN = 16, 8
#: Shingles in a block of a large cluster: 16 MB of hashes.
BLOCK_SHINGLES = 2_000_000
_U = np.uint64
_ROUNDS = 16


def bands_for(percent: int) -> tuple[int, int]:
    """``(bands, rows)`` that miss a pair at ``percent`` with probability below ``LOSS``."""
    t = min(percent / 100, 0.995)
    rows = max(1, min(8, round(math.log(0.36) / math.log(t))))
    return math.ceil(math.log(LOSS) / math.log(1 - t**rows)), rows


def sketch(texts: np.ndarray, hashes: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """A ``rows`` x ``bins`` table; two texts agree in a bin with the probability of their similarity.

    Each round throws all elements of a text into the bins; a bin keeps the
    smallest value of the first round that reaches it. What is still empty after
    the last round takes the minimum over all elements.
    """
    table = np.full(rows * bins, np.iinfo(np.uint64).max, _U)
    owner, value = texts, hashes
    for turn in range(_ROUNDS):
        x = W.mix(value + _U((turn * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
        place = owner * bins + (((x >> _U(32)) * _U(bins)) >> _U(32)).astype(np.int64)
        np.minimum.at(table, place, _U(turn << 56) | (W.mix(x) >> _U(8)))
        open_rows = (table.reshape(rows, bins) == np.iinfo(np.uint64).max).any(axis=1)
        keep = open_rows[owner]
        owner, value = owner[keep], value[keep]
        if not len(owner):
            break
    table = table.reshape(rows, bins)
    for row in np.unique(owner):
        own = value[slice(*np.searchsorted(owner, [row, row + 1]))]
        empty = np.flatnonzero(table[row] == np.iinfo(np.uint64).max)
        step = max(1, 1_000_000 // len(own))
        for at in range(0, len(empty), step):
            part = empty[at : at + step]
            seeds = W.mix(part.astype(_U) + _U(977))
            table[row, part] = (W.mix(own[:, None] ^ seeds[None, :]) >> _U(8)).min(axis=0) | _U(_ROUNDS << 56)
    return table


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, hash)`` of the distinct shingles, where each text's begin, and each text's node."""
    texts, hashes = W.distinct(*W.shingles(W.split(data, offsets, W.NON_SPACE), size))
    edges = np.searchsorted(texts, np.arange(len(offsets)))
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(W.mix(hashes ^ _U(0x5851F42D4C957F2D)), out=total[1:])
    return texts, hashes, edges, W.mix(total[edges[1:]] - total[edges[:-1]] + np.diff(edges).astype(_U)).view(np.int64)


def _node_batches(size: int, bands: int, band_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in W.text_blocks(batch.column("text")):
                n = stop - first
                texts, hashes, edges, node = _sets(data, offsets, size)
                counts = np.diff(edges)
                table = sketch(texts, hashes, n, bands * band_rows).reshape(n, bands, band_rows)
                key = np.broadcast_to(np.arange(bands, dtype=_U), (n, bands)).copy()
                for r in range(band_rows):
                    key = W.mix(key * _U(0xD6E8FEB86659FD93) + table[:, :, r])
                some = counts > 0
                keys = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)),
                    pa.array(key[some].ravel().view(np.int64)),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_id").slice(first, n),
                        pa.array(counts.astype(np.int64)),
                        pa.array(node, mask=~some),
                        keys,
                    ],
                    ["row_id", "n_shingles", "node", "keys"],
                )

    return run


def _set_batches(size: int, wanted: np.ndarray):
    """Sets of the texts whose node and key may be ``wanted``: those that stand for a node in a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in W.text_blocks(batch.column("text")):
                _, hashes, edges, node = _sets(data, offsets, size)
                rows = batch.slice(first, stop - first)
                key = rows.column("key").to_numpy().view(_U)
                own = np.flatnonzero(bloom.may_hold(wanted, node.view(_U) ^ key))
                sets = [hashes[edges[i] : edges[i + 1]].tobytes() for i in own]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("row_id").take(pa.array(own)), pa.array(node[own]), pa.array(sets, pa.binary())],
                    ["row_id", "node", "set"],
                )

    return run


def _shared_keys(wanted: np.ndarray):
    """The keys of every node that may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys").flatten().to_numpy()
            nodes = np.repeat(batch.column("node").to_numpy(), np.diff(np.asarray(batch.column("keys").offsets)))
            keep = bloom.may_hold(wanted, keys.view(_U))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(keys[keep])], ["node", "part"])

    return run


class CountTree:
    """R-tree over group counts; level 0 holds the points, each level above boxes of ``FAN`` below."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        widest = np.argsort(points.var(axis=0))[::-1][:2] if len(points) else [0, 0]
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (LEAF * FAN)
        self.order = np.lexsort((points[:, widest[1]], points[:, widest[0]], slab))
        self.points, self.sizes = points[self.order], sizes[self.order]
        high, least, most = self.points, self.sizes, self.sizes
        self.levels = []
        width = LEAF
        while True:
            cuts = np.arange(0, len(high), width)
            high, least, most = (
                np.maximum.reduceat(high, cuts),
                np.minimum.reduceat(least, cuts),
                np.maximum.reduceat(most, cuts),
            )
            self.levels.append((high, least, most))
            width = FAN
            if len(high) == 1:
                break

    def below(self, level: int, box: int) -> range:
        return range(box * FAN, min((box + 1) * FAN, len(self.levels[level - 1][0])))


def candidate_leaves(a: CountTree, b: CountTree, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of leaves whose boxes can hold a linked pair. With ``a is b`` each unordered pair comes once."""

    def reach(level_a: int, x: int, level_b: int, ys: np.ndarray) -> np.ndarray:
        high_a, least_a, most_a = (part[x] for part in a.levels[level_a])
        high_b, least_b, most_b = (part[ys] for part in b.levels[level_b])
        overlap = np.minimum(high_a, high_b).sum(axis=1)
        return (
            (overlap * (100 + percent) >= percent * (least_a + least_b))
            & (100 * most_b >= percent * least_a)
            & (100 * most_a >= percent * least_b)
        )

    todo = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while todo:
        la, x, lb, y = todo.pop()
        if la == 0 and lb == 0:
            yield x, y
            continue
        xs = a.below(la, x) if la >= lb and la else [x]
        ys = np.array(b.below(lb, y) if lb >= la and lb else [y])
        next_a, next_b = la - (la >= lb and la > 0), lb - (lb >= la and lb > 0)
        for i in xs:
            chosen = ys[ys >= i] if a is b and next_a == next_b else ys
            if len(chosen):
                todo.extend((next_a, i, next_b, int(j)) for j in chosen[reach(next_a, i, next_b, chosen)])


class _Forest:
    def __init__(self, size: int) -> None:
        self.label = np.arange(size)
        self.edges: list[tuple[int, int]] = []
        self.members = {i: [i] for i in range(size)}

    def link(self, i: int, j: int) -> None:
        a, b = int(self.label[i]), int(self.label[j])
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.label[self.members[b]] = a
        self.members[a] += self.members.pop(b)
        self.edges.append((i, j))


def linked_forest(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the linked pairs: within the sets, or across if ``side`` has both 0 and 1."""
    sizes = np.array([len(s) for s in sets], np.int64)
    points = np.stack([np.bincount((s >> _U(40)).astype(np.int64) % GROUPS, minlength=GROUPS) for s in sets])
    parts = [np.flatnonzero(side == s) for s in (0, 1) if (side == s).any()]
    trees = [CountTree(points[p], sizes[p]) for p in parts]
    ids = [p[t.order] for p, t in zip(parts, trees)]
    forest, same = _Forest(len(sets)), len(trees) == 1
    for x, y in candidate_leaves(trees[0], trees[-1], percent):
        left = np.arange(x * LEAF, min((x + 1) * LEAF, len(ids[0])))
        right = np.arange(y * LEAF, min((y + 1) * LEAF, len(ids[-1])))
        p, q = trees[0].points[left], trees[-1].points[right]
        n, m = trees[0].sizes[left], trees[-1].sizes[right]
        bound = np.minimum(p[:, None, :], q[None, :, :]).sum(axis=2)
        fits = bound * (100 + percent) >= percent * (n[:, None] + m[None, :])
        if same and x == y:
            fits &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        i, j = np.nonzero(fits)
        i, j = ids[0][left[i]], ids[-1][right[j]]
        while len(i):
            apart = forest.label[i] != forest.label[j]
            i, j = i[apart], j[apart]
            linked = False
            for at in range(len(i)):
                a, b = sets[i[at]], sets[j[at]]
                common = len(a) + len(b) - len(np.union1d(a, b))
                if common * (100 + percent) >= percent * (len(a) + len(b)):
                    forest.link(int(i[at]), int(j[at]))
                    linked = True
                    break
            if not linked:
                break
            i, j = i[at + 1 :], j[at + 1 :]
    return forest.edges


def _unit(percent: int):
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), _U) for x in table.column("set")]
        block, low = table.column("block").to_numpy(), table.column("low").to_numpy()
        edges = linked_forest(sets, (block != low).astype(int), percent)
        i, j = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        return pa.table({"u": pa.array(nodes[i], pa.int64()), "v": pa.array(nodes[j], pa.int64())})

    return run


def shingle_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90
) -> DataFrame:
    """``(key, n_shingles, component_id)`` for every row of ``docs``.

    Two rows are linked when ``100 * |A and B| >= percent * |A or B|`` for their
    sets of distinct ``size``-word shingles (A-Z lower-cased, words without ASCII
    white space; a shorter text is one shingle). ``component_id`` is the smallest
    key reachable by links, itself included.

    A null or wordless text has no shingles and is linked with nothing: its
    component is its own key. Repeated rows stay, in one component. A row with a
    null key brings no links; it gets the component of the rows with its own set,
    or null. The result is stored, and all that led to it deleted. Other columns of ``docs`` are not read. Shingles and nodes are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    bands, rows = bands_for(percent)
    named = docs.select(F.col(key).alias("row_id"), F.col(text).cast("string").alias("text"))
    id_type = named.schema["row_id"].dataType.simpleString()
    nodes = materialize(
        named.mapInArrow(
            _node_batches(size, bands, rows), f"row_id {id_type}, n_shingles bigint, node bigint, keys array<bigint>"
        )
    )
    # One row per node. Every text of a node has the same keys, so any will do.
    classes = materialize(
        nodes.where("node is not null and row_id is not null")
        .groupBy("node")
        .agg(F.min("row_id").alias("least_id"), F.min("n_shingles").alias("n"))
    )
    chosen = nodes.join(classes.select("node", F.col("least_id").alias("row_id")), ["node", "row_id"], "left_semi")
    dealt = materialize(chosen.select("node", "keys"))
    parts = dealt.select("node", F.explode("keys").alias("part"))
    # min and max are merged before the shuffle; parts with one node go here
    shared = parts.groupBy("part").agg(F.min("node").alias("hub"), F.max("node").alias("far")).where("hub < far")
    shared = materialize(shared.select("part", "hub"))
    held = dealt.mapInArrow(_shared_keys(bloom.build(shared, "part")), "node bigint, part bigint")
    stars = held.join(shared, "part").where("node != hub")
    clusters = (
        connected_components(stars.select(F.col("hub").alias("u"), F.col("node").alias("v")))
        .withColumnRenamed("root", "cluster")
        .join(classes, "node")
        .select("cluster", "node", "n", F.col("least_id").alias("row_id"), F.xxhash64("least_id").alias("key"))
    )
    sums = clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    clusters = materialize(clusters.join(sums, "cluster"))
    wanted = bloom.build(clusters.select(F.col("node").bitwiseXOR(F.col("key")).alias("pair")), "pair")
    sets = (
        named.withColumn("key", F.xxhash64("row_id"))
        .mapInArrow(_set_batches(size, wanted), f"row_id {id_type}, node bigint, set binary")
        .join(clusters, ["node", "row_id"])
        .dropDuplicates(["node", "row_id"])
    )
    units = (
        sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .select(
            "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block",
            "node", "set",
        )
    )
    forest = units.groupBy("cluster", "low", "high").applyInArrow(_unit(percent), "u bigint, v bigint")
    roots = connected_components(forest)
    labels = (
        classes.join(roots, "node", "left")
        .select("node", F.coalesce("root", "node").alias("root"), "least_id")
    )
    least = labels.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named_nodes = materialize(labels.join(least, "root").select("node", "component_id"))
    result = materialize(
        nodes.join(named_nodes, "node", "left").select(
            F.col("row_id").alias(key),
            "n_shingles",
            F.when(F.col("node").isNull(), F.col("row_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
    for inner in (nodes, classes, dealt, shared, clusters, named_nodes):
        drop(inner)
    return result
