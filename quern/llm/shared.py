"""Tables between steps, in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quern.sources.scratch import new_folder, shared_folder


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and read as Parquet from the shared folder from now on, also after the loss of an executor."""
    path = new_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    rows.kept_path = path
    return rows


def discard(*frames: DataFrame) -> None:
    """Deletes what kept() wrote, once nothing reads it any more."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.kept_path)
        path.getFileSystem(conf).delete(path, True)


def kept_in_place(df: DataFrame) -> DataFrame:
    """Like kept(), and each partition stays as it is, in its order (a checkpoint)."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
