"""Scalar expressions that the operators share. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TOKENS = ("", "none", "nan", "null", "<na>", "n/a")
"""Texts that stand for a missing value, in lower case."""


def money(c: Column | str) -> Column:
    """Exact two-place decimal, so sums do not depend on their order."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(12,2)")


def total(c: Column) -> Column:
    """An exact sum, as a double."""
    return F.sum(c).cast("double")


def mean(c: Column) -> Column:
    """The exact sum divided by the number of values."""
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


def round2(c: Column) -> Column:
    """Two places, half up; a nudge of 1e-9 makes binary ties decide alike in every engine."""
    return F.round(c + F.lit(1e-9), 2)


def safe_pct(part: Column, whole: Column) -> Column:
    """100 * part / whole with two places; a null part is 0, a null or zero whole gives null."""
    part, whole = F.coalesce(part.cast("double"), F.lit(0.0)), whole.cast("double")
    return round2(F.try_divide(part * 100, F.when(whole != 0, whole)))


def normalize_nulls(c: Column) -> Column:
    """Null for texts that only stand for a missing value."""
    text = F.trim(c)
    return F.when((F.octet_length(text) > max(map(len, NULL_TOKENS))) | ~F.lower(text).isin(*NULL_TOKENS), c)


def to_int(c: Column) -> Column:
    """Lenient integer: '2.7' is 2, '-3.9' is -3, and what is no number is null."""
    return F.when(F.abs(c.try_cast("double")) < 2147483648.0, c.try_cast("double").cast("long").cast("int"))


def to_date(c: Column) -> Column:
    return c.try_cast("date")


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def to_bool(c: Column) -> Column:
    return c.try_cast("boolean")


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def bins(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins: labels[i] for edges[i] < c <= edges[i + 1], else null."""
    found = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        found = F.when((c > lo) & (c <= hi), F.lit(label)).otherwise(found)
    return found


def bucket(c: Column, low: float, width: float) -> Column:
    """The fixed-width bin, from 0, that a value is in."""
    return F.floor((c - low) / width).cast("long")


def aging_bucket(days: Column) -> Column:
    """0-30 (future dates too), 31-60, 61-90, 91-120, 120+ (unknown days too)."""
    return F.when(days <= 30, "0-30").when(days <= 60, "31-60").when(days <= 90, "61-90").when(days <= 120, "91-120").otherwise("120+")


def by_rules(rules: list[tuple[Column, str]], default: Column) -> Column:
    """The label of the last rule that holds."""
    found = default
    for condition, label in rules:
        found = F.when(condition, F.lit(label)).otherwise(found)
    return found
