"""Incremental loads as Structured Streaming jobs that take what is there and end (availableNow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.evolution import evolved_union
from quern.operators.rows import latest, stamp
from quern.schema import TableSpec
from quern.sources.store import SnapshotStore, part_of, touched


def read_stream(spark: SparkSession, path: str, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """A stream of a folder's Parquet files, or of one file, with their schema; event_time gets a watermark.

    The last letter of the path is put in brackets, since a stream takes one file only as a pattern.
    """
    df = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return df.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay) if event_time else df


def append_bronze(stream: DataFrame, table: str, target: str, checkpoint: str) -> None:
    """Appends new files' rows, stamped, exactly once."""
    stamped = stamp(stream, "bronze", table)
    stamped.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start().awaitTermination()


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was not seen within the watermark, so replayed files add nothing."""
    return stream.dropDuplicatesWithinWatermark(keys)


def upsert_stream(stream: DataFrame, store: SnapshotStore, spec: TableSpec, checkpoint: str, mode: str = "append") -> None:
    """Upserts each micro-batch's latest row of a key. A batch that runs again after a failure changes nothing.

    The batch number is kept in the rows. With a watermark column a row gives way to a later event only, and otherwise
    (in update mode always) to one of the same or a later batch. A table with buckets has only those of the batch's keys
    read and written.
    """

    def apply(batch: DataFrame, number: int) -> None:
        upsert_batch(batch, number, store, spec, mode)

    stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_batch(batch: DataFrame, number: int, store: SnapshotStore, spec: TableSpec, mode: str = "append") -> None:
    """One micro-batch of upsert_stream."""
    timed = spec.watermark in batch.columns and mode == "append"
    later = [F.desc_nulls_last(spec.watermark)] if spec.watermark in batch.columns else []
    rest = [F.desc(c) for c in batch.columns if c not in (spec.key, spec.watermark)]
    new = latest(batch, [spec.key], [*later, *rest]).withColumn("_batch", F.lit(number).cast("long"))
    part, now = part_of(spec), store.snapshot(spec.name)
    parts = touched(new, part) if spec.buckets and now is not None else None
    target = store.read(spec.name, parts=parts)
    if target is not None:
        new = latest(evolved_union([target, new]), [spec.key], [*(later if timed else []), F.desc_nulls_last("_batch"), *rest])
    if part:
        store.replace(spec.name, new, part, parts)
    else:
        store.write(spec.name, new)


def windowed_counts(stream: DataFrame, event_time: str, width: str, by: list[str], value: str) -> DataFrame:
    """Count and sum of each tumbling window; with a watermark the state of closed windows is dropped."""
    return stream.groupBy(F.window(event_time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(12,2)")).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def late_rows(df: DataFrame, event_time: str, watermark: str) -> DataFrame:
    """How many rows an incremental load from that watermark would pass over, and how many have no readable time."""
    t = F.col(event_time).try_cast("timestamp_ntz")
    return df.agg(F.count_if(t <= F.lit(watermark).cast("timestamp_ntz")).alias("late"), F.count_if(t.isNull()).alias("unreadable"), F.count("*").alias("rows"))
