"""Row-level operators: unions, stamps, hashes, watermarks, deduplication."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def business_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def safe_union(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column that a frame lacks is null there."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def project_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in that order."""
    return df.select(*(c for c in wanted if c in df.columns))


def with_typed_nulls(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds a typed null for each column that is missing."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def drop_meta(df: DataFrame) -> DataFrame:
    return df.select(*business_columns(df))


def row_hash(df: DataFrame, columns: list[str] | None = None, mode: str = "safe") -> Column:
    """md5 of a row's columns as text.

    mode "compat" joins them with bars and takes null for '', so ('a|b') and ('a', 'b'), or null and '', hash alike;
    "safe" writes each with its length and keeps null apart.
    """
    columns = business_columns(df) if columns is None else columns
    if mode == "compat":
        return F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.md5(F.concat_ws("|", *(part(F.col(c)) for c in columns)))


def stamp(df: DataFrame, layer: str, table: str, at: Column | None = None, hashed: bool = False) -> DataFrame:
    """Adds _<layer>_table, when it was made and on what date, and for bronze a row hash."""
    at = F.current_timestamp() if at is None else at
    names = {"bronze": ("_ingested_at", "_ingestion_date"), "silver": ("_cleaned_at", "_silver_date"), "gold": ("_computed_at", "_gold_date")}[layer]
    more = {"_row_hash": row_hash(df, mode="compat")} if hashed or layer == "bronze" else {}
    return df.withColumns({f"_{layer}_table": F.lit(table), names[0]: at, names[1]: F.to_date(at), **more})


def watermark_filter(df: DataFrame, column: str, after: str | None) -> DataFrame:
    """Rows whose event time is later than the last watermark. Without such a column all pass; unreadable times do not."""
    if column not in df.columns:
        return df
    return df.where(F.col(column).try_cast("timestamp_ntz") > F.lit(after or "1900-01-01 00:00:00").cast("timestamp_ntz"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in an order that should be total, so that reruns agree."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def sample_seeded(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows at most, the same ones in every run."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def top_k(df: DataFrame, by: str, k: int, ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), ties).limit(k)


def share_of_total(df: DataFrame, column: str, name: str, within: list[str] | None = None) -> DataFrame:
    """column as a percentage of its total. For an aggregate: without within, all rows of df meet in one task."""
    from quern.functions.scalars import safe_pct

    return df.withColumn(name, safe_pct(F.col(column), F.sum(column).over(Window.partitionBy(*(within or [F.lit(0)])))))
