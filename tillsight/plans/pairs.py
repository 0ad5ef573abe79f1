"""Top label pairs among items that share a group, without forming every pair.

Counting the pairs of a group is quadratic in its width, and a group may hold a
large part of the table. Three things keep the exact answer affordable:

* Pairs are counted by label as soon as they are formed, so they leave a task
  folded. Labels travel as numbers, not as text.
* Only pairs that can still reach the result are formed. The lines that two
  labels share are at most the product of their strengths (Cauchy-Schwarz over
  the groups), and the counts among a few frequent items give a floor that the
  result cannot fall below.
* The items of a wide group are paired within small blocks only. Across blocks,
  sums by label meet, so a wide group costs its width times its labels, not the
  square of its width, and the work is spread over many tasks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tillsight.plans.materialize import materialize

# Strengths are square roots in double; this covers their rounding.
_SLACK = 1.000001

# Pairs that one task is meant to form.
_PAIRS_PER_TASK = 5_000_000

# Lines of wide groups that one task numbers.
_PART_LINES = 250_000

# Labels in a piece of a half; two pieces meet in one task.
_PIECE_LABELS = 512


def distinct_lines(df: DataFrame, group: str, item: str) -> DataFrame:
    """One row per (group, item) with its number of lines, NULL keys left out.

    Shuffled by both columns, so the lines of one huge group stay spread out.
    """
    return (
        df.filter(F.col(group).isNotNull() & F.col(item).isNotNull())
        .groupBy(F.col(group).alias("_group"), F.col(item).alias("_item"))
        .agg(F.count(F.lit(1)).alias("_lines"))
    )


def _widths(lines: DataFrame) -> DataFrame:
    return lines.groupBy("_group").agg(F.count(F.lit(1)).alias("_width"))


def pair_volume(lines: DataFrame, block: int = 512) -> Row:
    """How many item pairs the groups make: in wide groups, in narrow ones, and the number of lines, of wide groups too."""
    width = F.col("_width").cast("double")
    is_wide = F.col("_width") > block
    pairs = width * (width - 1) / 2

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0))

    return (
        _widths(lines)
        .agg(
            total(F.when(is_wide, pairs)).alias("wide"),
            total(F.when(~is_wide, pairs)).alias("narrow"),
            total(width).alias("lines"),
            total(F.when(is_wide, width)).alias("wide_lines"),
        )
        .first()
    )


def pair_counts(
    lines: DataFrame, block: int = 512, volume: Row | None = None, reachable: Column | None = None
) -> DataFrame:
    """Line pairs per pair of labels (label_a, label_b, times), the lower item being a.

    ``lines`` is ``distinct_lines`` with a column ``_label``, possibly NULL, and
    columns that depend on the label alone. A pair of items counts the product of
    its line counts, which equals counting the joined lines one by one. Groups of
    up to ``block`` items are joined with themselves. A wider group is cut, in the
    order of its items, into blocks of that many. Within a block items are paired.
    Items of different blocks are in order already, so their lines are summed by
    label first: blocks are halves of pairs of blocks, those are halves of four,
    and so on, and the labels of every two halves meet once. ``volume`` is the
    lines' ``pair_volume`` where it is known, ``reachable`` a further condition
    on the columns of both sides, ``a`` and ``b``, that depend on the label.
    """
    volume = volume or pair_volume(lines, block)
    if not volume["wide_lines"]:
        return _folded(_near_pairs(lines, ["_group"], volume["narrow"], reachable))
    wide = _widths(lines).filter(F.col("_width") > block).select(F.col("_group").alias("_wide_group"))
    in_wide_group = F.col("_group") == F.col("_wide_group")
    narrow = lines.join(wide, in_wide_group, "left_anti")
    cut = _blocks(lines.join(wide, in_wide_group, "left_semi"), block, volume["wide_lines"])
    return _folded(
        _near_pairs(narrow, ["_group"], volume["narrow"], reachable)
        .unionByName(_near_pairs(cut, ["_group", "_block"], volume["wide_lines"] * block / 2, reachable))
        .unionByName(_far_pairs(cut, reachable))
    )


def _blocks(lines: DataFrame, block: int, rows: float) -> DataFrame:
    """``lines`` with ``_block``, from 0 in the order of a group's items, and ``_levels``, the bits of the last block.

    Lines are range-partitioned and stored with their part, so a group of any width
    is numbered by its parts and no task sees it whole.
    """
    parts = max(1, math.ceil(rows / _PART_LINES))
    ranged = lines.repartitionByRange(parts, "_group", "_item")
    stored = materialize(ranged.withColumn("_part", F.spark_partition_id()))
    of_group = Window.partitionBy("_group")
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_group",
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.length(F.bin(F.floor((F.sum("_n").over(of_group) - 1) / block))).alias("_levels"),
    )
    at = F.col("_start") + F.row_number().over(Window.partitionBy("_group", "_part").orderBy("_item")) - 1
    placed = stored.join(starts, ["_group", "_part"]).withColumn("_block", F.floor(at / block))
    return materialize(placed.drop("_part", "_start"))


def _near_pairs(lines: DataFrame, keys: list[str], volume: float, reachable: Column | None) -> DataFrame:
    spread = _spread(lines, keys, volume)
    return _pairs(spread, spread, keys, reachable)


def _far_pairs(cut: DataFrame, reachable: Column | None) -> DataFrame:
    """Pairs of items in different blocks, as label pairs of the two halves that part them.

    Halves of many labels are cut by label, and every two pieces are a join key of their own.
    """
    node = ["_group", "_level", "_node"]
    by_label = [c for c in cut.columns if c not in ("_group", "_item", "_lines", "_block", "_levels")]
    halves = materialize(
        cut.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_levels") - 1)))
        .withColumn("_half", F.expr("shiftright(_block, _level)"))
        .groupBy("_group", "_level", F.shiftright("_half", 1).alias("_node"), (F.col("_half") % 2).alias("_side"), *by_label)
        .agg(F.sum("_lines").alias("_lines"))
    )
    sizes = halves.groupBy(*node).agg(F.count_if(F.col("_side") == 0).alias("_low"), F.count_if(F.col("_side") == 1).alias("_high"))
    sizes = sizes.where("_low > 0 and _high > 0")
    volume = sizes.agg(F.sum(F.col("_low").cast("double") * F.col("_high"))).first()[0] or 0.0
    met = halves.join(sizes, node)

    def pieces(labels: str) -> Column:
        return F.ceil(F.col(labels) / _PIECE_LABELS).cast("int")

    def own(labels: str) -> Column:
        return F.pmod(F.xxhash64("_label"), pieces(labels)).cast("int")

    def every(labels: str) -> Column:
        return F.explode(F.sequence(F.lit(0), pieces(labels) - 1))

    sides = (
        met.where("_side = 0").withColumn("_from", own("_low")).withColumn("_to", every("_high")),
        met.where("_side = 1").withColumn("_to", own("_high")).withColumn("_from", every("_low")),
    )
    # Spark's size estimate does not know how far explode copies the lines, so no broadcast may be chosen by it
    keys = [*node, "_from", "_to"]
    first, second = [_spread(df, keys, volume).hint("merge") for df in sides]
    return _met(first, second, keys, reachable).select(
        F.col("a._label").alias("label_a"),
        F.col("b._label").alias("label_b"),
        (F.col("a._lines") * F.col("b._lines")).alias("_times"),
    )


def _spread(df: DataFrame, keys: list[str], volume: float) -> DataFrame:
    """Partition by the join keys, by the pairs to be formed instead of the bytes to be read."""
    tasks = math.ceil(volume / _PAIRS_PER_TASK)
    return df.repartition(tasks, *keys) if tasks > 1 else df


def _met(
    first: DataFrame, second: DataFrame, keys: list[str], reachable: Column | None, further: Column | None = None
) -> DataFrame:
    conditions = [F.col(f"a.{key}") == F.col(f"b.{key}") for key in keys]
    conditions += [c for c in (further, reachable) if c is not None]
    return first.alias("a").join(second.alias("b"), reduce(Column.__and__, conditions), "inner")


def _pairs(first: DataFrame, second: DataFrame, keys: list[str], reachable: Column | None) -> DataFrame:
    """Pairs of different items, each once, the lower one first."""
    return _met(first, second, keys, reachable, F.col("a._item") < F.col("b._item")).select(
        F.col("a._label").alias("label_a"),
        F.col("b._label").alias("label_b"),
        (F.col("a._lines") * F.col("b._lines")).alias("_times"),
    )


def _folded(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("label_a", "label_b").agg(F.sum("_times").alias("times"))


def _label_numbers(labels: DataFrame) -> DataFrame:
    """Items with the smallest item of their label, which stands for the label."""
    named = labels.filter(F.col("_label").isNotNull())
    lowest = named.groupBy("_label").agg(F.min("_item").alias("_number"))
    return named.join(lowest, "_label", "inner").select("_item", F.col("_number").alias("_label"))


def _best_named(counts: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """The counts that reach the ``n``-th largest one, with names: only these meet the label table."""
    last = counts.select("times").orderBy(F.desc("times")).limit(n).select(F.min("times")).scalar()
    best = counts.where(F.col("times") >= last)
    a = labels.select(F.col("_item").alias("label_a"), F.col("_label").alias("_name_a"))
    b = labels.select(F.col("_item").alias("label_b"), F.col("_label").alias("_name_b"))
    return (
        best.join(a, "label_a", "left")
        .join(b, "label_b", "left")
        .select(F.col("_name_a").alias("label_a"), F.col("_name_b").alias("label_b"), "times")
    )


def top_label_pairs(lines: DataFrame, labels: DataFrame, n: int, block: int = 512) -> DataFrame:
    """Counts of the label pairs that reach the ``n``-th largest count.

    ``labels`` has ``_item``, unique, and ``_label``; items without one share the
    NULL label. Ties with the ``n``-th are included, so that the caller can settle
    them.
    """
    lines = materialize(lines.join(_label_numbers(labels), "_item", "left"))
    floor = _floor(lines, n)
    strengths = materialize(_strengths(lines))
    most = strengths.select(F.max("_strength")).scalar()
    able = strengths.filter(F.col("_strength") * most >= floor)
    candidates = materialize(lines.join(able, F.col("_label").eqNullSafe(F.col("_strong")), "inner").drop("_strong"))
    reachable = F.col("a._strength") * F.col("b._strength") >= floor
    # read twice below; Spark would form the pairs anew
    counts = materialize(pair_counts(candidates, block, reachable=reachable))
    return _best_named(counts, labels, n)


def _floor(lines: DataFrame, n: int) -> float:
    """A count that the ``n``-th result reaches: the ``n``-th one among a few frequent items.

    No group holds more than those few items, so their pairs need no blocks.
    """
    few = 2 * math.ceil(math.sqrt(2 * n)) + 2
    weight = F.sum(F.col("_lines").cast("double") * F.col("_lines"))
    frequent = lines.groupBy("_item").agg(weight.alias("_weight")).orderBy(F.desc("_weight"), "_item").limit(few)
    chosen = lines.where(F.col("_item").isin([r["_item"] for r in frequent.select("_item").collect()]))
    sample = _folded(_pairs(chosen, chosen, ["_group"], None))
    best = [r["times"] for r in sample.orderBy(F.desc("times")).limit(n).select("times").collect()]
    return float(best[-1]) if len(best) == n else 0.0


def _strengths(lines: DataFrame) -> DataFrame:
    """Per label the length of its vector of line counts over the groups."""
    shared = lines.groupBy("_group", "_label").agg(F.sum("_lines").cast("double").alias("_n"))
    return shared.groupBy(F.col("_label").alias("_strong")).agg(
        (F.sqrt(F.sum(F.col("_n") * F.col("_n"))) * _SLACK).alias("_strength")
    )
