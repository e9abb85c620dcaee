"""Distinct counts that can be added up: a sketch for each group and month, merged for longer periods without a rescan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG = 12
"""The logarithm of a sketch's registers: 2 ** LG of them, about as many bytes."""


def error(lg: int = LG) -> float:
    """Three standard deviations of an estimate, as a share of the count (0.05 at the default)."""
    return 3 * 1.04 / 2 ** (lg / 2)


def monthly(df: DataFrame, by: list[str], day: str, value: str, lg: int = LG) -> DataFrame:
    """by, month, rows, sketch (null without values): of a bounded size for each group and month, however many its values."""
    return df.groupBy(*by, F.date_format(day, "yyyy-MM").alias("month")).agg(F.count("*").alias("rows"), F.hll_sketch_agg(F.col(value).cast("string"), F.lit(lg)).alias("sketch"))


def added(kept: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """The sketches with those of another batch: rows that come again add rows, but no distinct values."""
    both = kept.unionByName(more).groupBy(*by, "month")
    return both.agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))


def distinct_in(kept: DataFrame, by: list[str], first: str | None = None, last: str | None = None) -> DataFrame:
    """by, rows, distinct (an estimate within error()) over the months from first to last ("yyyy-MM"), from sketches alone."""
    if first:
        kept = kept.where(F.col("month") >= first)
    if last:
        kept = kept.where(F.col("month") <= last)
    return kept.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
