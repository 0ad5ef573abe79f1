"""Scalar and aggregate rules that Spark's own functions do not give directly.

Everything here returns a Column built from JVM-side expressions, so callers
stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A day that is a Sunday; weekday names are taken from the days after it.
_A_SUNDAY = "2000-01-02"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_date(as_of: dt.date | str | Column | None) -> Column:
    """The reporting date: a literal, a column, or today when nothing is given."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of.cast("date")
    return F.lit(str(as_of)).cast("date")


def year_diff(start: Column | str, end: Column | str) -> Column:
    """Year boundaries crossed, so 31 December to 1 January is 1."""
    return F.year(_col(end)) - F.year(_col(start))


def month_diff(start: Column | str, end: Column | str) -> Column:
    """Month boundaries crossed, so 31 January to 1 February is 1."""
    start, end = _col(start), _col(end)
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def month_start(day: Column | str) -> Column:
    return F.trunc(_col(day), "month")


def month_name(month_number: Column | str) -> Column:
    """English name of a month number. Apply it after grouping, not per fact row."""
    return F.date_format(F.make_date(F.lit(2000), _col(month_number), F.lit(1)), "MMMM")


def weekday_number(day: Column | str, week_start: str = "sunday") -> Column:
    """1..7, counted from ``week_start`` ('sunday' or 'monday')."""
    if week_start == "sunday":
        return F.dayofweek(_col(day))
    if week_start == "monday":
        return F.weekday(_col(day)) + 1
    raise ValueError(f"week_start must be 'sunday' or 'monday', not {week_start!r}")


def weekday_name(number: Column | str, week_start: str = "sunday") -> Column:
    """English name of a ``weekday_number``. Apply it after grouping."""
    shift = {"sunday": 1, "monday": 0}[week_start]
    return F.date_format(F.date_add(F.lit(_A_SUNDAY).cast("date"), _col(number) - shift), "EEEE")


def blank_concat(*parts: Column | str, sep: str = " ") -> Column:
    """Join the parts with ``sep``; a NULL part counts as the empty string."""
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            pieces.append(F.lit(sep))
        pieces.append(F.coalesce(_col(part), F.lit("")))
    return F.concat(*pieces)


def pct_text(pct: Column | str) -> Column:
    """5.0 -> '5%', 10.50 -> '10.5%', NULL -> '%'."""
    digits = F.regexp_replace(_col(pct).cast("decimal(20,2)").cast("string"), r"\.?0+$", "")
    return blank_concat(digits, F.lit("%"), sep="")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Fractional division in double; a zero or NULL denominator gives NULL."""
    bottom = _col(denominator).cast("double")
    return _col(numerator).cast("double") / F.nullif(bottom, F.lit(0.0))


def exact_mean(c: Column | str) -> Column:
    """Mean of the non-NULL values of an exact type (whole numbers, decimals) as a double, over an exact sum."""
    value = _col(c)
    return ratio(F.sum(value), F.count(value))


def first_matching_band(bands: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first condition that is true; NULL conditions fall through."""
    label: Column | None = None
    for condition, name in bands:
        label = F.when(condition, name) if label is None else label.when(condition, name)
    if label is None:
        return F.lit(otherwise)
    return label.otherwise(otherwise)
