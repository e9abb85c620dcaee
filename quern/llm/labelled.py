"""Bounded samples of labelled rows, the fold that is held out, and scoring of whole texts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.spans import lean, portions, text_bytes

FOLDS = 5
"""Rows whose crc32(key as text) mod FOLDS is 0 are held out."""


def give_back() -> None:
    """Returns the memory that a fit has freed to the machine; without this, the driver keeps it for later fits."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, key: str, text: str) -> DataFrame:
    """text, label for at most `limit` labelled rows outside the held-out fold: the first by a hash of the key.

    At most `limit` keys are broadcast, so documents are not shuffled. Null labels and keys take no part; a key with
    several labels has the largest. A key that stands on several documents brings all of them; callers keep one row of
    each key, so that what they gather is bounded by `limit` rows.
    """
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    own = own.orderBy(F.xxhash64("key"), "key").limit(limit)
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(own), "key").select("key", "text", "label")


def scored(docs: DataFrame, scores: Callable[[np.ndarray, np.ndarray], np.ndarray], key: str, text: str, threshold: float, keep: tuple[str, ...]) -> DataFrame:
    """key, held_out, score, predicted and the columns in keep; scores: of the texts with these bytes and offsets.

    The text goes to the function once, also if it is kept.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0), *(scores(data, offs) for _, _, data, offs in portions(*text_bytes(batch.column(0))))]
            first = 0 if text in keep else 1
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], pa.array(np.concatenate(found))], [*batch.schema.names[first:], "score"])

    others = [c for c in keep if c not in (key, text)]
    rows = docs.select(F.col(text).cast("string").alias("input"), F.col(key).alias("key"), *(F.col(c).alias(f"keep_{c}") for c in others))
    fields = rows.schema.fields[0 if text in keep else 1 :]
    out = rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", score double")
    kept = [F.col("input" if c == text else f"keep_{c}").alias(c) for c in keep if c != key]
    return out.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *kept)
