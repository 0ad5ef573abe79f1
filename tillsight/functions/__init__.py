"""Column-level semantics shared by every operator."""

from tillsight.functions.semantics import (
    as_of_date,
    blank_concat,
    exact_mean,
    first_matching_band,
    month_diff,
    month_name,
    month_start,
    pct_text,
    ratio,
    weekday_name,
    weekday_number,
    year_diff,
)

__all__ = [
    "as_of_date",
    "blank_concat",
    "exact_mean",
    "first_matching_band",
    "month_diff",
    "month_name",
    "month_start",
    "pct_text",
    "ratio",
    "weekday_name",
    "weekday_number",
    "year_diff",
]
