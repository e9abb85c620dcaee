"""The folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the context's; a folder of its own where both are unset on one machine.

    On a cluster an unset folder is an error, since a machine's own folder is not shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet. Whoever reads it last deletes it, or job() does."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    return path


_FOLDERS: list[str] = []
"""Of this driver, in the order of their making."""


@contextlib.contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the folders that were made in it: for a job that writes its results elsewhere before it ends.

    Results of operators are read from such folders when they are used, so they can't be used afterwards.
    """
    first = len(_FOLDERS)
    try:
        yield
    finally:
        for folder in _FOLDERS[first:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _FOLDERS[first:]


SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends, and not only once the driver collects its garbage."""
    before = spark.conf.get(SHUFFLES, "false")
    spark.conf.set(SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES, before)
