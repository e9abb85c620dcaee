"""Operator 2: token counts, by batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.pieces import encoder
from quern.llm.spans import lean, text_bytes


def token_counts(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """One row for each row of docs: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    tokenizer: a tokenizers .json or sentencepiece .model file, at the same path on all executors. No begin, end or
    other special token is added; added tokens inside texts count as the library has them by default.
    Batches are balanced by bytes, and long texts are cut at safe boundaries (quern.llm.pieces); lengths come back, no
    ids. There is no shuffle, and what a worker keeps is bounded by KNOWN pieces and one Arrow batch.

    Null text: empty, so 0 tokens. Null keys and repeated rows: each row has its own result row. Empty table: no rows.
    Other columns of docs, whatever their names, are neither read nor returned.
    """

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(own.counts(data, offs))], ["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long").select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
