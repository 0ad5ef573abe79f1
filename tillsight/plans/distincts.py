"""Several exact distinct counts per group of a dimension from one pass over the fact.

Every line becomes one narrow row per counted column. One shuffle deals these rows by key
and by a few lots of (column, value), which spreads a hot key and leaves a key of few lines
few partial results; behind it rows are folded by (key, column, value). They are not folded
before it: nearly all of them differ, and the fold would fill a task's memory and spill.
Counts per key follow from the folded pairs, with a map-side combine.

Distinct counts of several keys cannot be added up. Where keys share a group (all
keys that the dimension does not know share the NULL group), the pairs of just those
keys are looked up in the same shuffled pairs and folded again by group, measures too. A
broadcast set of hash buckets keeps other pairs out of that look-up's shuffle. It is
salted, so no key fills a task with or without adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that the pairs of one key are looked up by.
SALTS = 32

#: Tasks that fold the pairs, and tasks among them that one key's pairs are dealt to. Up to 200 parts
#: Spark writes each to a file of its own as rows come; beyond that it sorts a task's rows in memory.
PARTS = 200
LOTS = 8

#: Hash buckets of keys that share a group.
BUCKETS = 1 << 20

Measure = tuple[Callable[[Column | str], Column], str]


def distinct_by_group(
    fact: DataFrame,
    key: str,
    groups: DataFrame,
    measures: dict[str, Measure],
    distinct: dict[str, str],
    key_is_group: bool = False,
) -> DataFrame:
    """``_group`` with measures and distinct counts, the NULL group holding facts of unknown keys.

    ``groups`` has ``_member``, a unique key, and its ``_group``; with
    ``key_is_group`` no two keys share one. ``measures`` are names with a function
    that can be applied again to its own results (sum, min, max) and a column;
    ``distinct`` names with a column whose NULLs do not count.
    """
    values = [f"_v{i}" for i in range(len(distinct))]
    columns = list(distinct.values())

    def entry(i: int) -> Column:
        own = [(F.col(c) if j == i else F.lit(None).cast(fact.schema[c].dataType)).alias(v) for j, (c, v) in enumerate(zip(columns, values))]
        # measures go with the first column's rows only
        carried = [(F.col(c) if i == 0 else F.lit(None).cast(fact.schema[c].dataType)).alias(n) for n, (_, c) in measures.items()]
        return F.struct(F.lit(i).alias("_kind"), *own, *carried)

    again = [f(n).alias(n) for n, (f, _) in measures.items()]
    folded = again or [F.count(F.lit(1)).alias("_lines")]
    counts = [F.count_if((F.col("_kind") == i) & F.col(v).isNotNull()).alias(n) for i, (n, v) in enumerate(zip(distinct, values))]
    stacked = fact.select(F.col(key).alias("_key"), F.explode(F.array(*map(entry, range(len(columns))))).alias("_line"))
    dealt = stacked.select("_key", "_line.*").withColumn("_lot", _lot(LOTS, "_kind", *values))
    pairs = dealt.repartition(PARTS, "_key", "_lot").groupBy("_key", "_lot", "_kind", *values)
    # as a result of the fold, the bucket is not filtered before the shuffle, which both uses of the pairs share
    pairs = pairs.agg(*folded, F.max(_lot(BUCKETS, "_key")).alias("_bucket"))
    per_key = pairs.groupBy("_key").agg(*again, *counts)

    shared = F.col("_member").isNull()
    if not key_is_group:
        members = groups.groupBy(F.col("_group").alias("_of")).agg(F.count(F.lit(1)).alias("_members"))
        groups = groups.join(members, F.col("_group").eqNullSafe(F.col("_of"))).drop("_of")
        shared = shared | (F.col("_members") > 1)
    named = per_key.join(groups, F.col("_key") == F.col("_member"), "left")
    # which groups are shared shows behind the aggregate, and both uses of the pairs take all their columns:
    # so they stay the same plan and share one shuffle
    alone = named.groupBy("_group").agg(*again, *[F.max(n).alias(n) for n in distinct], F.bool_or(shared).alias("_shared"))
    alone = alone.where("not _shared").drop("_shared")

    keys = stacked.groupBy("_key").agg(F.count(F.lit(1)).alias("_lines"))
    # where no two keys share one, only unknown keys do: a filter by group then drops the look-up from the plan
    group = F.lit(None).cast(groups.schema["_group"].dataType) if key_is_group else F.col("_group")
    wanted = keys.join(groups, F.col("_key") == F.col("_member"), "left").where(shared)
    wanted = wanted.select(F.col("_key").alias("_wanted"), group.alias("_group"))
    # at most BUCKETS numbers, whatever the number of keys, keep most pairs out of the look-up's shuffle
    buckets = F.broadcast(wanted.select(_lot(BUCKETS, "_wanted").alias("_one_of")).distinct())
    likely = pairs.join(buckets, F.col("_bucket").eqNullSafe(F.col("_one_of")), "left_semi")
    salts = F.explode(F.array(*[F.lit(s) for s in range(SALTS)]))
    looked_up = F.col("_key").eqNullSafe(F.col("_wanted")) & F.col("_salt").eqNullSafe(F.col("_place"))
    met = likely.withColumn("_salt", _lot(SALTS, *values)).join(wanted.withColumn("_place", salts), looked_up)
    together = met.groupBy("_group", "_kind", *values).agg(*folded).groupBy("_group").agg(*again, *counts)
    return alone.unionByName(together)


def _lot(lots: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(lots)).cast("int")


def distinct_count_by(df: DataFrame, by: str, item: str, name: str) -> DataFrame:
    """``by`` with its number of distinct ``item``, NULLs not counted.

    Pairs are dealt by both columns before they are folded. Nearly all of them differ, so a fold
    before the shuffle saves no bytes and holds all pairs of a task in memory.
    """
    pairs = df.select(by, item).repartition(PARTS, by, item).distinct()
    return pairs.groupBy(by).agg(F.count(item).alias(name))
