"""Mix sources to target weights along a time-varying curriculum. Spark expressions only.

Every source gets a target in words. Its stream is its documents in a fixed
shuffled order, repeated until the target is met. A schedule says how strongly a
source is wanted at each moment of training; the integral of the schedule, scaled
to the target, is the source's cumulative demand. The moment at which the demand
reaches a document's first word is the document's position in training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Schedule = list[tuple[float, float]]

#: Weight at each moment from 0 to 1, linear between the knots: fading, steady and rising.
SCHEDULES: list[Schedule] = [
    [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)],
    [(0.0, 1.0), (1.0, 1.0)],
    [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)],
]


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def stream_order(key: Column, text: Column) -> Column:
    """A hash that shuffles documents; equal keys with different texts differ."""
    return F.md5(
        F.concat_ws(
            ":",
            F.coalesce(key.cast("string"), F.lit("")),
            F.coalesce(F.md5(text.cast("string").cast("binary")), F.lit("")),
        ).cast("binary")
    )


def weigh_by_rank(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating over the sources by code point, null last; the schedule goes with the weight.

    ``sources`` has one row per source, as a mixture's configuration does; ranking
    it is the one window that is not split.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", rank % 3 + 1).withColumn("schedule", rank % 3)


def targets(sources: DataFrame, repeats: int = 3) -> DataFrame:
    """Adds ``target`` to ``(source, source_size, weight)``.

    The targets share the sum of all sizes by weight; none exceeds ``repeats``
    times its source, and what is cut off is shared again by weight. With sources
    in the order of ``cap / weight`` the cut ones come first, so one pass of
    running sums finds the share per unit of weight that all others get.
    """
    order = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    ranked = sources.withColumn("__cap", F.col("source_size") * repeats).withColumn(
        "__ratio", F.col("__cap") / F.col("weight")
    )
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - (F.sum("__cap").over(order) - F.col("__cap"))
    rest = F.sum("weight").over(whole) - (F.sum("weight").over(order) - F.col("weight"))
    shared = ranked.withColumn("__left", left).withColumn("__rest", rest)
    fits = F.col("__left") / F.col("__rest") <= F.col("__ratio")
    first = F.min(F.when(fits, F.struct("__ratio", F.col("source").isNull(), "source", "__left", "__rest"))).over(whole)
    return (
        shared.withColumn("__first", first)
        .withColumn(
            "target",
            F.when(fits, F.col("weight") * F.col("__first.__left") / F.col("__first.__rest")).otherwise(
                F.col("__cap").cast("double")
            ),
        )
        .select(*sources.columns, "target")
    )


def demand_met(fraction: Column, schedule: Schedule) -> Column:
    """The moment at which ``fraction`` of the schedule's integral has passed."""
    done, pieces = 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = (w0 + w1) / 2 * (t1 - t0)
        pieces.append((t0, w0, (w1 - w0) / (t1 - t0), done, done + area))
        done += area
    at = None
    for t0, w0, slope, low, high in pieces:
        more = fraction * F.lit(done) - F.lit(low)
        # the root of w0 x + slope x^2 / 2 = more, in the form that has no division by the slope
        here = F.lit(t0) + F.lit(2.0) * more / (
            F.lit(w0) + F.sqrt(F.lit(w0 * w0) + F.lit(2.0 * slope) * more)
        )
        inside = fraction * F.lit(done) < F.lit(high)
        at = F.when(inside, here) if at is None else at.when(inside, here)
    return at.otherwise(here)


def mix(
    docs: DataFrame,
    sources: DataFrame,
    source: str = "source",
    size: str = "size",
    order: str = "order",
    schedules: list[Schedule] | None = None,
    repeats: int = 3,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and ``copies``: its uses by the mix.

    ``docs`` has a ``size`` in words and an ``order`` (hexadecimal text) that
    shuffles it; ``sources`` is ``(source, source_size, weight, schedule, target)``,
    one row per source, null included. ``copies`` is an array of ``(epoch,
    position, words)``: one entry for each time the document is read. The last
    copy of a stream ends at the word that meets the target, so the words of a
    source add up to its target, rounded. A document is used ``repeats`` times at
    most; one that is not used, or has no words, has an empty array. Documents of a
    source that ``sources`` lacks are not used. Repeated rows are documents of
    their own. Columns named like a result are replaced.

    A hot source is split: its order is cut into 4,096 parts by prefix, each part
    sums its own sizes, and a part starts where those before it end.
    """
    schedules = schedules or SCHEDULES
    docs = docs.drop("source_size", "target", "copies")
    plan = sources.select(
        F.col("source").alias("__source"), "source_size", "target", F.col("schedule").alias("__schedule")
    )
    # the source as a key without null, so that the join and the window deal the documents out alike, once
    known = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    dealt = docs.withColumn("__of", known).withColumn("__part", F.substring(F.col(order), 1, 3))
    sums = dealt.groupBy("__of", "__part").agg(F.sum(size).alias("__words"))
    before = F.sum("__words").over(Window.partitionBy("__of").orderBy("__part")) - F.col("__words")
    starts = sums.select("__of", "__part", before.alias("__before"))
    within = Window.partitionBy("__of", "__part").orderBy(order, *[c for c in docs.columns if c == "doc_id"], size)
    placed = (
        dealt.join(starts, ["__of", "__part"])
        .withColumn(
            "__start",
            F.col("__before")
            + F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            - F.col(size),
        )
        .join(plan, F.col(source).eqNullSafe(F.col("__source")), "left")
    )
    cut = F.floor(F.col("target") + 0.5).cast("bigint")

    def use(epoch: Column) -> Column:
        begin = epoch * F.col("source_size") + F.col("__start")
        words = F.least(begin + F.col(size), cut) - F.least(begin, cut)
        part = begin.cast("double") / F.nullif(F.col("target"), F.lit(0.0))
        position = F.lit(None).cast("double")
        for i, schedule in enumerate(schedules):
            position = F.when(F.col("__schedule") == i, demand_met(part, schedule)).otherwise(position)
        return F.struct(epoch.cast("int").alias("epoch"), position.alias("position"), words.alias("words"))

    uses = F.filter(
        F.array(*[use(F.lit(e).cast("bigint")) for e in range(repeats)]), lambda c: F.coalesce(c["words"], F.lit(0)) > 0
    )
    return placed.withColumn("copies", uses).drop(
        "__part", "__of", "__before", "__start", "__source", "__schedule"
    )


def source_sizes(docs: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """``(source, source_size)``; null is a source."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per use of a document, with ``epoch``, ``position`` and ``words``, range-sorted by position."""
    used = mixed.drop("epoch", "position", "words").withColumn("__use", F.explode("copies"))
    return used.select(*[c for c in used.columns if c not in ("copies", "__use")], "__use.*").orderBy("position")


def replay(
    uses: DataFrame, document: str, row: str, source: str = "source", size: str = "size", order: str = "order"
) -> DataFrame:
    """``uses`` with ``epoch`` and ``position``: when each row of a mixed corpus is read.

    ``uses`` has a row for every use of a document, as a mix makes them: rows of one
    document and source are its epochs, told apart by ``row``. A source's target is
    the sum of its uses, so positions follow from the corpus alone. Rows without
    words have none. Rows of a document beyond those that the streams can hold get
    its last position. ``uses`` is narrow: it is shuffled by document.
    """
    same = [document, source]
    docs = uses.groupBy(*same).agg(F.first(size).alias(size), F.first(order).alias(order), F.count(F.lit(1)).alias("__uses"))
    docs = docs.withColumn("doc_id", F.col(document))
    taken = docs.groupBy(F.col(source).alias("__taker")).agg(F.sum(F.col(size) * F.col("__uses")).cast("double").alias("target"))
    sizes = weigh_by_rank(source_sizes(docs, source, size))
    plan = sizes.join(taken, F.col("source").eqNullSafe(F.col("__taker"))).drop("__taker")
    read = mix(docs, plan, source, size, order).select(
        F.col(document).alias("__document"), F.col(source).alias("__of"), F.col("copies").alias("__copies")
    )
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(row))
    met = uses.withColumn("__nth", nth).join(
        read, F.col(document).eqNullSafe(F.col("__document")) & F.col(source).eqNullSafe(F.col("__of")), "left"
    )
    copy = F.try_element_at("__copies", F.least(F.col("__nth"), F.size("__copies")))
    use = F.when(F.size("__copies") > 0, copy)
    return met.withColumns({"epoch": use["epoch"], "position": use["position"]}).drop("__nth", "__document", "__of", "__copies")
