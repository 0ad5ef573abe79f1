"""Import cleaning, calendar, pivots, slicers and the measures of the service dashboards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import exact_mean, first_matching_band, ratio, weekday_number
from tillsight.operators.exploration import revenue_share
from tillsight.operators.ranking import top_n
from tillsight.plans import counts_by_key, share_of_total


# ---- import and model ----


def clean_table(df: DataFrame, types: dict[str, str], key: Sequence[str] | None = None) -> DataFrame:
    """Trim text, turn blanks into NULL, cast what can be cast, drop repeated rows.

    Values that do not fit the wanted type become NULL. With ``key`` only rows
    that agree on the key are repeated; the smallest of them is kept, so that the
    result does not depend on partition order.
    """
    columns = []
    for name, kind in df.dtypes:
        value = F.col(name)
        if kind == "string":
            value = F.nullif(F.trim(value), F.lit(""))
        columns.append(value.try_cast(types[name]).alias(name) if name in types else value.alias(name))
    cleaned = df.select(*columns)
    if key is None:
        return cleaned.dropDuplicates()
    rest = [c for c in cleaned.columns if c not in key]
    if not rest:
        return cleaned.dropDuplicates()
    first = F.min(F.struct(*rest)).alias("_first")
    single = cleaned.dropDuplicates()
    return single.groupBy(*key).agg(first).select(*key, "_first.*").select(*cleaned.columns)


def calendar_table(
    df: DataFrame, date_col: str, week_start: str = "sunday", weekend_days: Sequence[int] = (7, 1)
) -> DataFrame:
    """One row per date from the first to the last date of ``df``, with its attributes.

    ``weekend_days`` are numbers of ``dayofweek``, 1 being Sunday.
    """
    day = F.col("date")
    span = df.agg(F.min(F.col(date_col).cast("date")).alias("lo"), F.max(F.col(date_col).cast("date")).alias("hi"))
    number = weekday_number(day, week_start)
    return span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date")).select(
        day,
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.date_sub(day, number - 1).alias("week_start"),
        number.alias("weekday_no"),
        F.date_format(day, "EEEE").alias("weekday_name"),
        F.dayofweek(day).isin(*weekend_days).alias("is_weekend"),
    )


def attach_calendar(df: DataFrame, calendar: DataFrame, date_col: str, measures: dict[str, Column]) -> DataFrame:
    """Daily measures on every calendar date; days without facts show zero.

    The facts are folded to one row per day before they meet the calendar. Facts
    without a date, or with one that the calendar lacks, stay, in one row per such
    date whose calendar columns are NULL. A measure that is NULL for a day with
    facts stays NULL.
    """
    day = F.col(date_col).cast("date").alias("_day")
    daily = df.groupBy(day).agg(*[m.alias(n) for n, m in measures.items()], F.lit(True).alias("_met"))
    joined = calendar.join(daily, F.col("date") == F.col("_day"), "full")
    filled = [F.when(F.col("_met").isNull(), F.lit(0)).otherwise(F.col(n)).alias(n) for n in measures]
    return joined.select(*calendar.columns, *filled)


def merge_tables(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Look up or combine two tables by key."""
    if how not in ("left", "inner"):
        raise ValueError(f"how must be 'left' or 'inner', not {how!r}")
    return left.join(right, on, how)


def merge_counts(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """How a merge by ``on`` would turn out: joined rows and rows without a partner on either side.

    Both sides are counted per key first, so no joined row is built and a
    frequent key weighs nothing.
    """
    a = counts_by_key(left, on, "_left").withColumnRenamed(on, "_left_key")
    b = counts_by_key(right, on, "_right").withColumnRenamed(on, "_right_key")
    both = a.join(b, F.col("_left_key") == F.col("_right_key"), "full")
    n_left, n_right = F.col("_left"), F.col("_right")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    return both.agg(
        total(n_left * n_right).alias("joined_rows"),
        total(F.when(n_right.isNull(), n_left)).alias("left_unmatched"),
        total(F.when(n_left.isNull(), n_right)).alias("right_unmatched"),
    )


def append_tables(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; a column that a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def apply_slicers(df: DataFrame, filters: dict[str, Sequence]) -> DataFrame:
    """Keep the rows whose columns hold one of the chosen values, for every slicer."""
    for name, values in filters.items():
        df = df.filter(F.col(name).isin(*values))
    return df


def slice_model(fact: DataFrame, slicers: Sequence[tuple[DataFrame, str, dict[str, list]]]) -> DataFrame:
    """Facts whose dimensions have the chosen attributes: ``(dimension, key, {attribute: values})`` for each slicer.

    A semi-join for each dimension, so no fact is repeated and attributes do not
    travel. Where the fact is partitioned by a key, Spark reads only the partitions
    that the sliced dimension holds. Facts of unknown keys are left out by a slicer on
    that key; no chosen attribute means no restriction.
    """
    for dimension, key, chosen in slicers:
        if chosen:
            fact = fact.join(apply_slicers(dimension, chosen).select(key), key, "left_semi")
    return fact


def pivot_table(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, measure: Column) -> DataFrame:
    """Rows by columns by one measure. The column values are given, so no extra pass looks for them."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(measure)


# ---- emergency room ----


def er_kpis(visits: DataFrame) -> DataFrame:
    """Patients, mean wait and mean satisfaction (unanswered ones left out)."""
    return visits.agg(
        F.countDistinct("patient_id").alias("total_patients"),
        F.avg("wait_minutes").alias("avg_wait_minutes"),
        exact_mean("satisfaction").alias("avg_satisfaction"),
    )


def daily_peaks(visits: DataFrame) -> DataFrame:
    """Patients per day and the day's rank, busiest first. The calendar bounds the ranked rows."""
    per_day = visits.groupBy(F.col("arrival_ts").cast("date").alias("visit_date")).agg(
        F.countDistinct("patient_id").alias("patients"), F.count(F.lit(1)).alias("visits")
    )
    return per_day.withColumn("peak_rank", F.dense_rank().over(Window.orderBy(F.desc("patients")))).orderBy(
        "peak_rank", "visit_date"
    )


def wait_by(visits: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """Mean wait and visits per department, day or any other columns."""
    return visits.groupBy(*columns).agg(
        F.avg("wait_minutes").alias("avg_wait_minutes"), F.count(F.lit(1)).alias("visits")
    )


def satisfaction_by_wait_band(visits: DataFrame, cuts: Sequence[float] = (15, 30, 60)) -> DataFrame:
    """Mean satisfaction per band of waiting time, shortest wait first."""
    wait = F.col("wait_minutes")
    names = [f"under {cuts[0]}", *[f"{lo} to under {hi}" for lo, hi in zip(cuts, cuts[1:])], f"{cuts[-1]} or more"]
    bands = [(wait < hi, name) for hi, name in zip(cuts, names)] + [(wait >= cuts[-1], names[-1])]
    position = F.array_position(F.array(*[F.lit(n) for n in [*names, "unknown"]]), F.col("wait_band"))
    return (
        visits.groupBy(first_matching_band(bands, "unknown").alias("wait_band"))
        .agg(F.count(F.lit(1)).alias("visits"), exact_mean("satisfaction").alias("avg_satisfaction"))
        .orderBy(position)
    )


def department_referrals(visits: DataFrame) -> DataFrame:
    """Referrals per department and their share; visits without a department are no referrals."""
    counts = visits.filter(F.col("department").isNotNull()).groupBy("department").agg(
        F.count(F.lit(1)).alias("referrals")
    )
    return counts.withColumn("pct_of_referrals", F.round(share_of_total(counts, "referrals"), 2)).orderBy(
        F.desc("referrals"), "department"
    )


# The first hour of each part of the day.
_DAY_PARTS = ((6, "Night"), (12, "Morning"), (17, "Afternoon"), (21, "Evening"))


def orders_by_hour(df: DataFrame, ts: str, name: str = "total_orders") -> DataFrame:
    """Rows per hour of the day, with the part of the day."""
    hour = F.col("hour")
    return (
        df.groupBy(F.hour(ts).alias("hour"))
        .agg(F.count(F.lit(1)).alias(name))
        .withColumn("day_part", first_matching_band([(hour < end, part) for end, part in _DAY_PARTS], "Night"))
        .orderBy("hour")
    )


# ---- food delivery ----


def _sales() -> Column:
    return F.sum("amount")


def _orders() -> Column:
    return F.countDistinct("order_id")


def food_kpis(orders: DataFrame) -> DataFrame:
    return orders.agg(
        _sales().alias("total_sales"),
        _orders().alias("total_orders"),
        F.avg("rating").alias("avg_rating"),
        ratio(_sales(), _orders()).alias("avg_order_value"),
    )


def sales_by_place(orders: DataFrame, level: str = "city") -> DataFrame:
    """Sales and orders per 'city', 'state' or another column, best first."""
    return (
        orders.groupBy(level)
        .agg(_sales().alias("total_sales"), _orders().alias("total_orders"))
        .orderBy(F.desc("total_sales"), level)
    )


def diet_distribution(orders: DataFrame) -> DataFrame:
    """Sales per diet and their share."""
    return revenue_share(orders, "diet", "amount", pct="pct_of_sales")


def top_cities(orders: DataFrame, n: int = 5) -> DataFrame:
    return top_n(orders, "city", _sales(), "total_sales", n)


def weekend_share(orders: DataFrame, weekend_days: Sequence[int] = (7, 1)) -> DataFrame:
    """Sales, orders and share of sales on weekend days and on weekdays.

    The grand total is a window over the two result rows.
    """
    kind = F.when(F.dayofweek("order_date").isin(*weekend_days), "Weekend").otherwise("Weekday")
    totals = orders.groupBy(kind.alias("day_type")).agg(
        _sales().alias("total_sales"), _orders().alias("total_orders")
    )
    share = ratio("total_sales", F.sum("total_sales").over(Window.partitionBy())) * 100
    return totals.withColumn("pct_of_sales", F.round(share, 2)).orderBy("day_type")
