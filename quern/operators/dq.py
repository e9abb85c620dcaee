"""Detectors of data faults. Each gives rows (keys and what is wrong), so results can be unioned, counted or joined back."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import NULL_TOKENS
from quern.sources.scratch import new_folder


def issues(df: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """keys, issue: one row for each check that a row fails; null conditions never fail."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(label)) for label, c in checks.items())))
    return df.select(*keys, F.explode(found).alias("issue"))


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, missing, rows: nulls and texts that stand for one, in one pass."""
    gone = lambda c: F.col(c).isNull() | F.lower(F.trim(F.col(c).cast("string"))).isin(*NULL_TOKENS)
    one = df.agg(F.count("*").alias("rows"), *(F.count_if(gone(c)).alias(f"m_{c}") for c in columns))
    return one.select("rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"m_{c}").alias("missing")) for c in columns))).alias("x")).select("x.column_name", "x.missing", "rows")


def wrong_type(raw: Column, kind: str) -> Column:
    return raw.isNotNull() & raw.try_cast(kind).isNull()


def special_characters(c: Column) -> Column:
    return c.rlike(r"[#$%&*@^~|<>{}\\]")


def untidy_space(c: Column) -> Column:
    return c.rlike(r"^\s|\s$|\s{2,}")


def tidy_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def not_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def near_duplicates(df: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Rows whose content (null is one too) another row with a smaller key has.

    The least key of each repeated content is aggregated and joined back, a join that can be broadcast or split where skewed.
    """
    first = df.groupBy(*(F.col(c).alias(f"_{c}") for c in content)).agg(F.min(key).alias("original"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in content))
    return df.join(first, same & (F.col(key) > F.col("original"))).select(*df.columns, "original")


def begun_by(values: DataFrame, whole: Column) -> DataFrame:
    """value, full: for each value that is not whole, the least whole one that it begins, if any.

    values: distinct strings in the column value. In order, what a string begins stands right after it, so the least whole
    one is the next whole value or none. Ranges of the order are looked through one by one, and the first whole value of
    each range is carried to those before it: one row for each range. No values are paired.
    """
    spark = values.sparkSession
    path = new_folder(spark, "ordered")
    values.select("value", whole.alias("whole")).repartitionByRange("value").withColumn("range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    own = F.when(F.col("whole"), F.col("value"))
    heads = rows.groupBy("range").agg(F.min(own).alias("head"))
    after = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("range", F.last("head", ignorenulls=True).over(after).alias("carried"))
    before = Window.partitionBy("range").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.last(own, ignorenulls=True).over(before)).join(F.broadcast(heads), "range")
    rows = rows.where(~F.col("whole")).select("value", F.coalesce("next", "carried").alias("full"))
    return rows.where(F.col("full").startswith(F.col("value")))


def truncated(df: DataFrame, key: str, column: str, least: int, often: int) -> DataFrame:
    """Rows whose rare value, of at least so many characters, is a proper prefix of a frequent one; full: the least of these."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where(F.length("value") >= least)
    short = begun_by(counts, F.col("n") >= often)
    return df.join(short, F.col(column) == F.col("value")).select(key, column, "full")


def case_variants(df: DataFrame, column: str) -> DataFrame:
    """folded, variants, canonical: values that differ in case only; the most frequent form (then the first) is canonical."""
    forms = df.where(F.col(column).isNotNull()).groupBy(F.lower(column).alias("folded"), F.col(column).alias("form")).agg(F.count("*").alias("n"))
    return forms.groupBy("folded").agg(F.count("*").alias("variants"), F.min_by("form", F.struct(-F.col("n"), F.col("form"))).alias("canonical")).where("variants > 1")


def orphans(child: DataFrame, parent: DataFrame, foreign: str, key: str) -> DataFrame:
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)), foreign, "left_anti")


def amount_mismatch(header: DataFrame, lines: DataFrame, key: str, amount: str, line_amount: Column, tolerance: float) -> DataFrame:
    """Headers whose amount differs from the sum of their lines, which are summed before the join."""
    sums = lines.groupBy(key).agg(F.sum(line_amount).alias("line_total"))
    return header.join(sums, key).where(F.abs(F.col(amount) - F.col("line_total")) > tolerance)


def diff_report(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """column_name, nulls_before, nulls_after, changed over the keys that both have."""
    b = before.select(key, *(F.col(c).alias(f"b_{c}") for c in columns))
    both = b.join(after.select(key, *(F.col(c).alias(f"a_{c}") for c in columns)), key)
    sums = both.agg(*(x for c in columns for x in (F.count_if(F.col(f"b_{c}").isNull()).alias(f"x_{c}"), F.count_if(F.col(f"a_{c}").isNull()).alias(f"y_{c}"), F.count_if(~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))).alias(f"z_{c}"))))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"x_{c}").alias("nulls_before"), F.col(f"y_{c}").alias("nulls_after"), F.col(f"z_{c}").alias("changed")) for c in columns))
    return sums.select(F.explode(rows).alias("r")).select("r.*")
