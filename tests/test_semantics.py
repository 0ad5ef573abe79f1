from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillsight import functions as sem

D = dt.date


def test_boundary_differences(spark):
    df = spark.createDataFrame(
        [
            (D(2024, 1, 31), D(2024, 2, 1)),
            (D(2023, 12, 31), D(2024, 1, 1)),
            (D(2024, 3, 1), D(2024, 3, 31)),
            (D(2024, 1, 1), None),
        ],
        "a date, b date",
    )
    assert rows(df.select(sem.month_diff("a", "b"), sem.year_diff("a", "b"))) == [(1, 0), (1, 1), (0, 0), (None, None)]


def test_null_names_count_as_empty(spark):
    df = spark.createDataFrame([("A", None), (None, "B"), (None, None), ("A", "B")], "f string, l string")
    assert rows(df.select(sem.blank_concat("f", "l"))) == [("A ",), (" B",), (" ",), ("A B",)]


@pytest.mark.parametrize(
    "value,text", [(5.0, "5%"), (100.0, "100%"), (10.5, "10.5%"), (0.0, "0%"), (None, "%"), (20.05, "20.05%"), (-3.1, "-3.1%")]
)
def test_pct_text(spark, value, text):
    df = spark.createDataFrame([(value,)], "p double")
    assert rows(df.select(sem.pct_text("p"))) == [(text,)]


def test_ratio_guards_zero_and_null(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (None, 2), (1, None), (None, 0)], "n int, d int")
    assert rows(df.select(sem.ratio("n", "d"))) == [(0.5,), (None,), (None,), (None,), (None,)]


def test_exact_mean_skips_null_and_survives_empty(spark):
    df = spark.createDataFrame([(1,), (None,), (4,)], "x int")
    assert rows(df.agg(sem.exact_mean("x"))) == [(2.5,)]
    assert rows(df.filter("x > 9").agg(sem.exact_mean("x"))) == [(None,)]


def test_weekday_and_month_names(spark):
    df = spark.createDataFrame([(D(2024, 1, 7),), (D(2024, 1, 8),), (D(2024, 1, 13),)], "d date")
    got = df.select(
        sem.weekday_number("d"),
        sem.weekday_name(sem.weekday_number("d")),
        sem.weekday_number("d", "monday"),
        sem.weekday_name(sem.weekday_number("d", "monday"), "monday"),
        sem.month_name(F.month("d")),
    )
    assert rows(got) == [
        (1, "Sunday", 7, "Sunday", "January"),
        (2, "Monday", 1, "Monday", "January"),
        (7, "Saturday", 6, "Saturday", "January"),
    ]
    with pytest.raises(ValueError):
        sem.weekday_number("d", "friday")


def test_as_of_date(spark):
    df = spark.range(1)
    assert rows(df.select(sem.as_of_date("2002-01-01"), sem.as_of_date(D(2002, 1, 1)))) == [(D(2002, 1, 1),) * 2]
    assert rows(df.select(sem.as_of_date(None) == F.current_date())) == [(True,)]


def test_rounding_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(0.125,), (-0.125,), (2.5,)], "x double")
    assert rows(df.select(F.round("x", 2))) == [(0.13,), (-0.13,), (2.5,)]


def test_differences_agree_with_calendar_arithmetic(spark):
    rng = random.Random(7)
    start = D(1990, 1, 1)
    pairs = [tuple(start + dt.timedelta(days=rng.randrange(15000)) for _ in range(2)) for _ in range(500)]
    df = spark.createDataFrame(pairs, "a date, b date")
    got = rows(df.select("a", "b", sem.month_diff("a", "b"), sem.year_diff("a", "b"), sem.month_start("a")))
    for a, b, months, years, first in got:
        assert months == (b.year * 12 + b.month) - (a.year * 12 + a.month)
        assert years == b.year - a.year
        assert first == a.replace(day=1)
