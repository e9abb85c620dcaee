"""The corpus pipeline: documents in, packed pieces out. Each stage is one operator of quern.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Null columns pass through; columns that docs has besides do not.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import mixing, ngram_jaccard, packing, quality, toxicity
from quern.sources.scratch import new_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "word_bpe_49k.json"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5.

    Null or empty text: scored like a text without terms. Very long texts are scored whole. Repeated rows, equal ids and
    null ids: each row by its own text. Without labels, or with labels of one kind, every score is their share. Empty
    table: no rows.
    """
    machine = toxicity.train(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, machine, threshold=0.5, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more.

    Nulls, empty and very long texts, repeated rows and tables without labels or rows: as in drop_toxic().
    """
    ranking = quality.train(docs, _labels(spark, sf_dir), at=0.3)
    return quality.score(docs, ranking, threshold=0.3, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that links connect, one: that with the smallest id (null last), then by a hash of its row.

    Rows are told apart by a hash of all they hold, so equal rows stand for one, and rows of one id with different texts and rows of
    null ids are decided on like all others. Texts without words are linked with nothing: each such row stays, and
    equal ones once. Very long texts are compared whole. Empty table: no rows.
    """
    missing = [F.col(c).isNull() for c in COLUMNS]
    own = (F.xxhash64(*COLUMNS, *missing).alias("one"), F.xxhash64(F.lit(1), *reversed(COLUMNS), *missing).alias("other"))
    rows = docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), *own).alias("row"))
    first = ngram_jaccard.near_duplicates(rows, key="row").where("row = component_id").select("row").distinct()
    return rows.join(first, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order; where a target ends inside one, its first words.

    Null, empty and wordless texts are never taken. Null source: a source of its own. Null ids and repeated rows: each
    row has its place. Very long texts are counted whole. Empty table: no rows.
    """
    mix = mixing.mixed(docs, keep=COLUMNS)
    due = mixing.training_order(mix)
    return due.select("doc_id", mixing.first_words(F.col("text"), F.col("words"), F.col("size")).alias("text"), "lang", "source", "n_chars").withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 ids.

    Null or empty text: its end id alone. Null ids and sources and repeated rows: packed each. Very long texts are cut
    into pieces. Empty table: no rows.
    """
    pieces = packing.pack(docs, public_tokenizers.path(TOKENIZER), window=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_windows)]

ORACLE_SQL = None
"""Learned scores and a tokenizer's ids can't be written in SQL."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
