"""Column expressions shared by the loaders, KPI queries and models.

Everything here is a built-in expression, so it stays inside whole-stage
codegen and never blocks predicate pushdown of the columns it does not touch.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpiloom.functions.lookups import WHITESPACE

_DAY_MICROS = 86_400_000_000
_FENCE = "```(sql)?"


# -- dates ------------------------------------------------------------------

def date_parts(day: Column) -> dict[str, Column]:
    """Calendar attributes of a DATE column (ISO week, English names)."""
    return {
        "year": F.year(day),
        "quarter": F.quarter(day),
        "month": F.month(day),
        "month_name": F.date_format(day, "MMMM"),
        "week": F.weekofyear(day),
        "day_of_week": F.date_format(day, "EEEE"),
    }


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour periods from start to end, rounded down (−2 h is −1)."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.floor(micros / F.lit(_DAY_MICROS)).cast("int")


def days_before(day: Column, days: int) -> Column:
    return F.date_sub(day, days)


def following_days(last_day: Column, horizon: int) -> Column:
    """Array of the ``horizon`` calendar days after ``last_day``; explode it."""
    return F.sequence(F.date_add(last_day, 1), F.date_add(last_day, horizon))


def period_label(year: Column, month: Column) -> Column:
    """``YYYY-MM`` with a zero-padded month."""
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))


# -- numbers ----------------------------------------------------------------

def round_half_up(value: Column, digits: int) -> Column:
    """SQL ROUND, once and at the wanted digit: ties go away from zero."""
    return F.round(value, digits)


def ratio_half_up(part: Column, whole: Column, digits: int) -> Column:
    """``part / whole`` of non-negative exact numbers, rounded half up without an inexact step.

    NULL when ``whole`` is zero. Both may have up to four decimals.
    """
    p, w = part.cast("decimal(24,4)"), whole.cast("decimal(24,4)")
    twice = F.when(w > 0, 2 * w)
    scaled = F.call_function("div", p * F.lit(2 * 10**digits) + w, twice)
    return (scaled.cast("decimal(20,0)") / F.lit(10**digits)).cast(f"decimal(20,{digits})")


def round_half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def grams_to_kg(grams: Column) -> Column:
    """Kilograms at three digits, then stored at two: both roundings count."""
    return F.bround(grams / F.lit(1000), 3).cast("decimal(8,2)")


def freight_ratio(freight: Column, price: Column) -> Column:
    return freight.cast("double") / (price.cast("double") + F.lit(1.0))


def clip_lower(value: Column, bound: float = 0.0) -> Column:
    return F.greatest(value, F.lit(bound))


def exact_avg(value: Column) -> Column:
    """Average from the exact decimal or integer sum; independent of row order."""
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))


def percent_of(part: Column, whole: Column, digits: int = 1) -> Column:
    """``100 * part / whole`` rounded half up; NULL when ``whole`` is zero."""
    return ratio_half_up(part.cast("decimal(20,0)") * F.lit(100), whole, digits)


def percent_where(condition: Column, digits: int = 1) -> Column:
    """Share of rows meeting ``condition``; a NULL condition counts as not met."""
    hits = F.sum(F.when(condition, 1).otherwise(0))
    return percent_of(hits, F.count(F.lit(1)), digits)


# -- missing values and codes -----------------------------------------------

def fill_missing(value: Column, default: Any) -> Column:
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


def map_values(value: Column, mapping: Mapping[str, Any], default: Any) -> Column:
    """Look ``value`` up in a small literal map, falling back to ``default``."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, value), F.lit(default))


def tiered(value: Column, bounds: Iterable[tuple[float, str]], lowest: str) -> Column:
    """First label whose bound ``value`` exceeds, scanning from the top bound."""
    steps = list(bounds)
    start = F.when(value > steps[0][0], steps[0][1])
    return reduce(lambda c, s: c.when(value > s[0], s[1]), steps[1:], start).otherwise(lowest)


def to_int_or_null(value: Column) -> Column:
    """Cast raw text to INT; bad text becomes NULL instead of an ANSI error.

    The pattern comes first because a failing cast costs an exception per row.
    """
    text = value.cast("string")
    return F.when(F.rlike(text, F.lit(r"^\s*[+-]?[0-9]+\s*$")), text.try_cast("int"))


# -- text -------------------------------------------------------------------

def strip_space(text: Column) -> Column:
    """Trim every kind of white space from both ends, in linear time."""
    return F.btrim(text, F.lit(WHITESPACE))


def strip_fences(text: Column) -> Column:
    """Remove code fences and surrounding white space from generated SQL."""
    return strip_space(F.regexp_replace(text, _FENCE, ""))


def is_blank(text: Column) -> Column:
    return strip_space(text) == ""


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Case-insensitive substring test against a word list."""
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in words])
