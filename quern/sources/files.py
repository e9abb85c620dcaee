"""Bronze scans: CSV and Parquet files of a folder as text, without inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.rows import safe_union
from quern.sources.split_csv import CSV, split_records


PART_BYTES = 4 << 20
"""Input bytes for each partition where a task holds or sorts all that it meets."""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob has files, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def input_bytes(df: DataFrame) -> int:
    """The size of the files that a frame is read from; 0 if it is not read from files."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(x)) for x in df.inputFiles()]
    return sum(x.getFileSystem(conf).getFileStatus(x).getLen() for x in paths)


def scan_csv_all_string(spark: SparkSession, path: str, split: bool = True) -> DataFrame:
    """Header, quoted line breaks, doubled quotes, no inference: every column is text.

    split: a large file is read by many tasks (split_csv.py), unless a field has quotes that neither enclose it nor are
    doubled; then, and without split, each file is one task.
    """
    whole = spark.read.options(header=True, inferSchema=False, multiLine=True, **CSV).csv(path)
    return (split_records(spark, path, whole.schema) if split else None) or whole


def as_strings(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))


def scan_parquet_as_string(spark: SparkSession, path: str) -> DataFrame:
    return as_strings(spark.read.parquet(path))


def scan_mixed_folder(spark: SparkSession, folder: str, source: str) -> DataFrame | None:
    """All CSV and Parquet files of a folder, with _source; None if it has none."""
    frames = []
    if exists(spark, f"{folder}/*.csv"):
        frames.append(scan_csv_all_string(spark, f"{folder}/*.csv"))
    if exists(spark, f"{folder}/*.parquet"):
        frames.append(scan_parquet_as_string(spark, f"{folder}/*.parquet"))
    return safe_union(frames).withColumn("_source", F.lit(source)) if frames else None


def scan_multi_source(spark: SparkSession, folders: dict[str, str]) -> DataFrame | None:
    """The folders (source: path) that are there, together."""
    found = [df for df in (scan_mixed_folder(spark, path, source) for source, path in folders.items()) if df is not None]
    return safe_union(found) if found else None
