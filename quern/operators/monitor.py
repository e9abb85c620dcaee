"""Checks over the audit table: layer, table_name, mode, status, input_rows, output_rows, dq_flagged, last_watermark, logged_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import safe_pct
from quern.operators.rows import latest, safe_union

AUDIT = "layer string, table_name string, mode string, status string, input_rows long, output_rows long, dq_flagged long, last_watermark string, logged_at timestamp_ntz"


def latest_runs(audit: DataFrame) -> DataFrame:
    return latest(audit, ["layer", "table_name"], [F.desc("logged_at"), F.desc("output_rows")])


def last_runs(audit: DataFrame, n: int = 50) -> DataFrame:
    """The last n runs of each table."""
    by_time = Window.partitionBy("layer", "table_name").orderBy(F.desc("logged_at"), F.desc("output_rows"))
    return audit.withColumn("_n", F.row_number().over(by_time)).where(F.col("_n") <= n).drop("_n")


def watermarks(audit: DataFrame) -> DataFrame:
    """The watermark of each table's last run that had one."""
    return audit.where("last_watermark is not null").groupBy("layer", "table_name").agg(F.max_by("last_watermark", F.struct("logged_at", "last_watermark")).alias("last_watermark"))


def _alerts(runs: DataFrame, check: str, when: Column, value: Column) -> DataFrame:
    return runs.where(when).select("layer", "table_name", F.lit(check).alias("check_name"), value.cast("double").alias("value"))


def check_dq_rate(audit: DataFrame, most: float = 10.0) -> DataFrame:
    rate = safe_pct(F.col("dq_flagged"), F.col("input_rows"))
    return _alerts(latest_runs(audit), "dq_rate", rate > most, rate)


def check_row_drop(audit: DataFrame, most: float = 10.0) -> DataFrame:
    rate = safe_pct(F.col("input_rows") - F.col("output_rows"), F.col("input_rows"))
    return _alerts(latest_runs(audit), "row_drop", rate > most, rate)


def check_stale_watermark(audit: DataFrame, as_of: str, hours: float = 26.0) -> DataFrame:
    """Watermarks older than so many hours; naive times are UTC, unreadable ones are passed over."""
    seen = F.col("last_watermark").try_cast("timestamp_ntz")
    age = F.timestamp_diff("MINUTE", seen, F.lit(as_of).cast("timestamp_ntz")) / 60
    return _alerts(latest_runs(audit), "stale_watermark", age > hours, age)


def check_zero_rows(audit: DataFrame) -> DataFrame:
    return _alerts(latest_runs(audit), "zero_rows", F.col("output_rows") == 0, F.col("output_rows"))


def check_null_keys(df: DataFrame, key: str, layer: str, table: str) -> DataFrame:
    """An alert if keys are null, before they are filtered."""
    return df.agg(F.count_if(F.col(key).isNull()).alias("n")).where("n > 0").select(F.lit(layer).alias("layer"), F.lit(table).alias("table_name"), F.lit("null_keys").alias("check_name"), F.col("n").cast("double").alias("value"))


def dq_report(audit: DataFrame, as_of: str) -> DataFrame:
    return safe_union([check_dq_rate(audit), check_row_drop(audit), check_stale_watermark(audit, as_of), check_zero_rows(audit)])


def run_summary(audit: DataFrame) -> DataFrame:
    """Tables, rows and flags by layer and status of the latest runs."""
    return latest_runs(audit).groupBy("layer", "status").agg(F.count("*").alias("tables"), F.sum("input_rows").alias("rows_in"), F.sum("output_rows").alias("rows_out"), F.sum("dq_flagged").alias("flagged"))
