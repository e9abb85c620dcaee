"""Operator 5: mixing sources to target weights, as a curriculum whose weights change over training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import kept

WORD = r"[^\x20\x09-\x0D]+"
SCHEDULE = ((0.0, (1.0, 1.0, 0.5)), (0.5, (1.0, 1.0, 1.0)), (1.0, (1.0, 0.5, 1.5)))
"""Knots (time, relative weight of each source class); straight lines lie between them. Source k has class k mod 3."""


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """source, source_size, rank, target for each source, from (source, source_size).

    Sources by code point, null last, weigh as weights, repeating. Filling up to a common level L, a source gets
    min(most * size, L * weight). The sources that stop at most * size are those with the least size for their weight,
    so L follows from running sums in that order. One row for each source; no document is looked at.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, rest, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    # the first source, in that order, that its level does not fill sets the level of all later ones
    leveled = ranked.withColumn("level", level).withColumn("open", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))
    target = F.when(F.min("open").over(whole).isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.first("open", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.col("w")))
    return leveled.select("source", "source_size", "rank", target.alias("target"))


def integral(schedule, k: int) -> list[tuple[float, ...]]:
    """The integral of source class k's schedule: (t, span, share, w, slope) for each straight line.

    Over the segment that starts at time t and spans `span`, the weight is w + slope * s (s from 0 to span, as shares of
    the whole integral), and `share` is the integral up to t.
    """
    lines = [((a, u[k]), (b, v[k])) for (a, u), (b, v) in zip(schedule, schedule[1:], strict=False)]
    areas = [(b - a) * (u + v) / 2 for (a, u), (b, v) in lines]
    return [(a, b - a, sum(areas[:i]) / sum(areas), u / sum(areas), (v - u) / (b - a) / sum(areas)) for i, ((a, u), (b, v)) in enumerate(lines)]


def segments(kind: Column, schedule=SCHEDULE) -> Column:
    """integral(schedule, kind) as an array of structs."""
    names = ("t", "span", "share", "w", "slope")
    cases = [F.array(*(F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(x, names, strict=True))) for x in integral(schedule, k))) for k in range(len(schedule[0][1]))]
    return F.element_at(F.array(*cases), (kind + 1).cast("int"))


def time_of(share: Column, parts: Column) -> Column:
    """When a source's cumulative demand reaches a share (0 to 1) of its target: the integral, inverted in its segment."""
    part = F.element_at(F.filter(parts, lambda x: x["share"] <= share), -1)
    area = share - part["share"]
    root = F.sqrt(F.greatest(part["w"] * part["w"] + part["slope"] * area * 2, F.lit(0.0)))
    return part["t"] + F.least(part["span"], F.when(area <= 0, F.lit(0.0)).otherwise(area * 2 / (part["w"] + root)))


def mixed(
    docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, schedule=SCHEDULE, key: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()
) -> DataFrame:
    """For each row of docs: key, source, size, source_size, target, taken, takes; and the columns in keep.

    takes: an array of (at, position, words), one for each time the document is taken: at is the time in training (0 to
    1), position the place in the whole mix's words; words are its first so many words, all but for one document of each
    source, where the target falls inside it. taken is their sum. A source's documents stand in the order of a hash of
    the key, `most` times over, and the target, cut to whole words, is taken from the front, so a source's taken words
    sum to floor(target), no document gives more than `most` times its size, and reruns agree. The k-th word that a
    source gives is due when the integral of its schedule reaches k / target.

    Running sums within a source use two levels (blocks of hashes, then rows of a block), about the square root of the
    number of rows each, so no task gets a whole source.

    Null text and texts without words: size 0, never taken. Very long texts: their words are counted whole. Null source: a source of its own, last. Null keys: like any
    other. Repeated rows: each has its place. Empty table: no rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), size_of(F.col(text).cast("string")).alias("size"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    sizes = kept(rows.drop(*(f"keep_{c}" for c in keep)).groupBy("key", "source", "size").agg(F.count("*").alias("copies")))
    n = sizes.count()
    digits = max(1, round(n.bit_length() / 8))  # hexadecimal, so about the square root of n blocks
    sizes = sizes.withColumn("hash", F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")))).withColumn("block", F.substring("hash", 1, digits))
    blocks = sizes.groupBy("source", "block").agg(F.sum(F.col("size") * F.col("copies")).alias("block_size"))
    by_block = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("block_start", F.coalesce(F.sum("block_size").over(by_block), F.lit(0)))
    sources = kept(targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, most))
    inside = Window.partitionBy("source", "block").orderBy("hash", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sizes.withColumn("in_block", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
        .join(blocks.toDF("of", "in", "block_size", "block_start"), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in")))
        .select("key", "source", "size", "copies", (F.col("in_block") + F.col("block_start")).alias("start"))
    )
    return _taken(placed, sources, rows, most, schedule, len(weights), key, source, keep)


def _taken(placed: DataFrame, sources: DataFrame, rows: DataFrame, most: int, schedule, kinds: int, key: str, source: str, keep: tuple[str, ...]) -> DataFrame:
    kind = F.col("rank") % len(schedule[0][1])
    known = sources.select(F.col("source").alias("of"), "source_size", "rank", "target", segments(kind, schedule).alias("parts"))
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # repeated rows (copies) follow one another; each finds its own number
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("start", F.col("start") + (F.col("copy") - 1) * F.col("size"))
    quota = F.floor("target").cast("long")
    turn = lambda e: F.greatest(F.lit(0), F.least(F.col("size"), quota - (F.col("start") + F.col("source_size") * e))).cast("long")
    at = lambda e: time_of((F.col("start") + F.col("source_size") * e) / F.greatest(F.col("target"), F.lit(1.0)), F.col("parts"))
    takes = F.filter(F.array(*(F.struct(at(e).alias("at"), turn(e).alias("words")) for e in range(most))), lambda x: x["words"] > 0)
    placed = placed.select("key", "source", "size", "source_size", "target", takes.alias("takes"), F.aggregate(takes, F.lit(0).cast("long"), lambda s, x: s + x["words"]).alias("taken"), "copy")
    if keep:
        own = Window.partitionBy("key", "source", "size").orderBy(*(f"keep_{c}" for c in keep))
        rows = rows.withColumn("copy", F.row_number().over(own)).toDF(*(f"row_{c}" for c in rows.columns), "row_copy")
        same = [F.col(c).eqNullSafe(F.col(f"row_{c}")) for c in ("key", "source", "size", "copy")]
        placed = placed.join(rows, same[0] & same[1] & same[2] & same[3])
    return placed.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "taken", "takes", *(F.col(f"row_keep_{c}").alias(c) for c in keep if c not in (key, source)))


def training_order(mix: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each time a document is taken, range-sorted by its time in training, then key."""
    due = mix.withColumn("take", F.explode("takes")).withColumn("at", F.col("take.at")).withColumn("words", F.col("take.words")).drop("takes", "take")
    return due.repartitionByRange("at", key).sortWithinPartitions("at", key)


def first_words(text: Column, words: Column, size: Column) -> Column:
    """The text up to the end of its first so many words; the whole text if that is all."""
    parts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # each begins with a word, but for space before the first
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.when(words < size, F.array_join(F.slice(parts, F.lit(1), (words + lead).cast("int")), "")).otherwise(text)
