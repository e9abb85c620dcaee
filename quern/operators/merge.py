"""Load modes as joins: each takes the target and a batch and gives the new target. No MERGE statement is needed."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.evolution import evolved_union
from quern.sources.scratch import new_folder

FOREVER = "9999-12-31"
WIDTH = 256
"""Coarse buckets of keys in a tree of digests, and fine ones in each of them."""
CHANGE = "_change"
"""What a merge did with a row, where it is asked to say so: I, U, D or N."""


def inserted(batch: DataFrame) -> DataFrame:
    return batch.withColumn(CHANGE, F.lit("I"))


def upsert(target: DataFrame, batch: DataFrame, key: list[str], tag: bool = False) -> DataFrame:
    """Target rows without a match, and the whole batch, which has one row for each key.

    Columns that one side lacks are null in its rows, and types widen (evolution.py). A null key matches nothing. tag: with
    CHANGE, I for new keys, U for those replaced, N for the rest.
    """
    new = batch
    if tag:
        marks = target.select(*key).distinct().withColumn(CHANGE, F.lit("U"))
        new = batch.join(marks, key, "left").withColumn(CHANGE, F.coalesce(CHANGE, F.lit("I")))
    old = target.join(batch.select(*key), key, "left_anti")
    return evolved_union([old.withColumn(CHANGE, F.lit("N")) if tag else old, new])


def soft_delete(target: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """The target with _is_deleted, true for the keys in gone; keys deleted before stay so. A CHANGE becomes D."""
    was = F.coalesce(F.col("_is_deleted"), F.lit(False)) if "_is_deleted" in target.columns else F.lit(False)
    marks = gone.select(*key).distinct().withColumn("_gone", F.lit(True))
    rows = target.join(marks, key, "left")
    if CHANGE in target.columns:
        rows = rows.withColumn(CHANGE, F.when(F.col("_gone").isNotNull() & ~was, "D").otherwise(F.col(CHANGE)))
    return rows.withColumn("_is_deleted", was | F.col("_gone").isNotNull()).drop("_gone")


def after(column: str, cutoff: Column) -> Column:
    """Whether a row's time is later than the cutoff; a time that can't be read is not."""
    return F.coalesce(F.col(column).try_cast("timestamp_ntz") > cutoff.cast("timestamp_ntz"), F.lit(False))


def window_replace(target: DataFrame, batch: DataFrame, column: str, cutoff: Column, tag: bool = False) -> DataFrame:
    """The target up to the cutoff, and from then on only the batch; running it twice changes nothing more."""
    late = after(column, cutoff)
    old, new = target.where(~late), batch.where(late)
    return evolved_union([old.withColumn(CHANGE, F.lit("N")), inserted(new)] if tag else [old, new])


def differs(tracked: list[str], null_safe: bool = True) -> Column:
    """Whether any tracked column (batch side: _new_<column>) changed; with null_safe, from or to null counts too."""
    found = F.lit(False)
    for c in tracked:
        one = ~F.col(c).eqNullSafe(F.col(f"_new_{c}")) if null_safe else F.coalesce(F.col(c) != F.col(f"_new_{c}"), F.lit(False))
        found = found | one
    return found


def scd2_init(batch: DataFrame, as_of: str) -> DataFrame:
    return batch.withColumns({"_effective_from": F.lit(as_of).cast("date"), "_effective_to": F.lit(FOREVER).cast("date"), "_is_current": F.lit(True)})


def scd2_merge(target: DataFrame, batch: DataFrame, key: list[str], tracked: list[str], as_of: str, null_safe: bool = True, tag: bool = False) -> DataFrame:
    """History with one more batch: changed current rows end on as_of and their new versions begin; new keys begin; the rest stays.

    One full outer join of current rows and batch says what each key needs, and one explode gives its rows.
    """
    columns = [c for c in batch.columns]
    old = [c for c in target.columns]
    new = batch.select(*key, *(F.col(c).alias(f"_new_{c}") for c in columns if c not in key), F.lit(True).alias("_in_batch"))
    both = target.where("_is_current").withColumn("_in_target", F.lit(True)).join(new, key, "full_outer")
    change = F.col("_in_target").isNotNull() & F.col("_in_batch").isNotNull() & differs(tracked, null_safe)
    begin = F.col("_in_target").isNull() | change
    same = lambda c: F.when(change, F.lit(as_of).cast("date")).otherwise(F.col(c)) if c == "_effective_to" else F.col(c) & ~change if c == "_is_current" else F.col(c)
    first = {"_effective_from": F.lit(as_of).cast("date"), "_effective_to": F.lit(FOREVER).cast("date"), "_is_current": F.lit(True)}
    fresh = lambda c: first[c] if c in first else F.col(c) if c in key else F.col(f"_new_{c}") if c in columns else F.lit(None).cast(target.schema[c].dataType)
    said = lambda kind: [kind.alias(CHANGE)] if tag else []
    kept = F.when(F.col("_in_target").isNotNull(), F.struct(*(same(c).alias(c) for c in old), *said(F.when(change, "U").otherwise("N"))))
    made = F.when(begin, F.struct(*(fresh(c).cast(target.schema[c].dataType).alias(c) for c in old), *said(F.lit("I"))))
    rows = both.select(F.explode(F.array_compact(F.array(kept, made))).alias("r")).select("r.*")
    past = target.where("not _is_current")
    return rows.unionByName(past.withColumn(CHANGE, F.lit("N")) if tag else past)


def scd2_expired(target: DataFrame, batch: DataFrame, key: list[str], tracked: list[str]) -> DataFrame:
    """The current rows that a batch ends."""
    new = batch.select(*key, *(F.col(c).alias(f"_new_{c}") for c in tracked))
    return target.where("_is_current").join(new, key).where(differs(tracked)).select(*target.columns)


def digests(df: DataFrame, key: list[str], hash_column: str, width: int = WIDTH) -> DataFrame:
    """coarse, fine, n, total, parity: a digest for each of width ** 2 buckets of keys, in width coarse ones.

    Sums and parities of two hashes of each row's key and hash, so they add up from any parts, and from fine to coarse.
    """
    fine = bucket(key, width)
    row = [*(F.col(c) for c in key), F.col(hash_column)]
    both = df.groupBy(F.floor(fine / width).alias("coarse"), fine.alias("fine"))
    return both.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*row).cast("decimal(20,0)")).alias("total"), F.bit_xor(F.xxhash64(F.lit("parity"), *row, F.col(hash_column).isNull())).alias("parity"))


def bucket(key: list[str], width: int = WIDTH) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), *key), F.lit(width * width))


def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """fine: the buckets in which two trees of digests differ; fine digests meet only below coarse ones that differ."""
    roll = lambda df, by: df.groupBy(by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("parity").alias("parity"))

    def differ(x: DataFrame, y: DataFrame, by: str) -> DataFrame:
        y = y.select(by, *(F.col(c).alias(f"_{c}") for c in ("n", "total", "parity")))
        same = F.col("n").eqNullSafe(F.col("_n")) & F.col("total").eqNullSafe(F.col("_total")) & F.col("parity").eqNullSafe(F.col("_parity"))
        return x.join(y, by, "full_outer").where(~same).select(by)

    coarse = differ(roll(a, "coarse"), roll(b, "coarse"), "coarse")
    return differ(*(roll(df.join(coarse, "coarse", "left_semi"), "fine") for df in (a, b)), "fine")


def parted(target: DataFrame, batch: DataFrame, key: list[str], hash_column: str, live: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Target rows of buckets that are as in the batch, and both sides' rows of the others; rows with a null key are in these.

    Only the list of unequal buckets is broadcast, WIDTH ** 2 numbers at most; rows of equal buckets are not shuffled. live:
    which rows of the target count.
    """
    spark, path = target.sparkSession, new_folder(target.sparkSession, "unequal")
    keyed = functools.reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in key))
    unequal(digests(target.where(keyed if live is None else keyed & live), key, hash_column), digests(batch.where(keyed), key, hash_column)).write.parquet(path)
    odd = F.broadcast(spark.read.parquet(path).withColumnRenamed("fine", "_fine"))
    # a null key has no bucket, and is joined
    mark = lambda df: df.withColumn("_of", F.when(keyed, bucket(key))).join(odd, F.col("_of") == F.col("_fine"), "left")
    of = lambda df, equal: mark(df).where(F.col("_of").isNotNull() & F.col("_fine").isNull() if equal else F.col("_of").isNull() | F.col("_fine").isNotNull()).select(*df.columns)
    return of(target, True), of(target, False), of(batch, False)


def fdc_classes(target: DataFrame, batch: DataFrame, key: list[str], hash_column: str = "_row_hash") -> DataFrame:
    """Key and class: I new, U changed, D gone, N the same. A null hash is a value of its own. One row for each key on a side.

    Rows meet in a full outer join on the key only in those buckets of keys whose digests differ.
    """
    equal, target, batch = parted(target, batch, key, hash_column)
    t = target.select(*key, F.col(hash_column).alias("_old"), F.lit(True).alias("_in_target"))
    b = batch.select(*key, F.col(hash_column).alias("_new"), F.lit(True).alias("_in_batch"))
    kind = F.when(F.col("_in_target").isNull(), "I").when(F.col("_in_batch").isNull(), "D").when(~F.col("_old").eqNullSafe(F.col("_new")), "U").otherwise("N")
    return t.join(b, key, "full_outer").select(*key, kind.alias("change")).unionByName(equal.select(*key, F.lit("N").alias("change")))


def fdc_merge(target: DataFrame, batch: DataFrame, key: list[str], hash_column: str = "_row_hash", tag: bool = False) -> DataFrame:
    """All classes applied: new and changed rows from the batch, gone keys kept with _is_deleted, the rest as it was.

    A column that the batch lacks keeps its values and is null in new rows; one that the target lacks is added, null in
    rows that the batch does not change. A null hash is a value of its own. Only keys of buckets whose digests differ are
    joined; the rows of the others stay as they are.
    """
    old = target if "_is_deleted" in target.columns else target.withColumn("_is_deleted", F.lit(False))
    equal, old, batch = parted(old, batch, key, hash_column, ~F.col("_is_deleted"))
    b = batch.withColumn("_is_deleted", F.lit(False)) if "_is_deleted" not in batch.columns else batch
    new = b.select(*key, *(F.col(c).alias(f"_new_{c}") for c in b.columns if c not in key), F.lit(True).alias("_in_batch"))
    both = old.withColumn("_in_target", F.lit(True)).join(new, key, "full_outer")
    take = F.col("_in_batch").isNotNull() & (F.col("_in_target").isNull() | ~F.col(hash_column).eqNullSafe(F.col(f"_new_{hash_column}")) | F.col("_is_deleted"))
    kept = lambda c: F.col("_in_batch").isNull() if c == "_is_deleted" else F.col(c) if c in old.columns else F.lit(None)
    value = lambda c: F.when(take, F.col(f"_new_{c}")).otherwise(kept(c)) if c in b.columns else F.col(c)
    gone = F.col("_in_batch").isNull() & ~F.col("_is_deleted")
    kind = F.when(F.col("_in_target").isNull(), "I").when(gone, "D").when(take, "U").otherwise("N")
    out = both.select(*key, *(value(c).alias(c) for c in dict.fromkeys([*old.columns, *b.columns]) if c not in key), *([kind.alias(CHANGE)] if tag else []))
    return evolved_union([out, equal.withColumn(CHANGE, F.lit("N")) if tag else equal])
