"""Records of one thing that differ in a field: agreement weights of fields, learnt without labels.

1. Candidate pairs share at least one blocking key. A pair belongs to the first key that it shares, so it is made once.
   Blocks of more than LARGEST rows are cut by a second key, the next of the list, so that no pair of such a block is lost
   that shares another key, and no block is paired whole.
2. A pair is the pattern of fields that agree. Patterns are counted; expectation-maximisation over these counts (2 to the
   number of fields rows at most, whatever the number of pairs) finds for each field how often it agrees among matches (m)
   and among others (u).
3. A pair's weight is the sum of log2(m / u) of fields that agree and log2((1 - m) / (1 - u)) of those that do not; it is
   decided once, by its pattern.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = 1000
"""Rows of a block up to which all its pairs are made."""


@dataclass(frozen=True)
class Weights:
    """share: of the pairs that are matches; m, u: of each field, how often it agrees among matches and others."""

    share: float
    m: tuple[float, ...]
    u: tuple[float, ...]

    def of(self, pattern: str) -> float:
        """The weight of a pattern: 1 agrees, 0 does not, - where a side is null."""
        parts = (math.log2(m / u) if x == "1" else math.log2((1 - m) / (1 - u)) for x, m, u in zip(pattern, self.m, self.u, strict=True) if x != "-")
        return sum(parts)

    def probability(self, pattern: str) -> float:
        odds = self.share / (1 - self.share) * 2 ** self.of(pattern)
        return odds / (1 + odds)


def expectation_maximisation(patterns: dict[str, int], fields: int, rounds: int = 200) -> Weights:
    """Weights from the counts of patterns; a start at rare matches that mostly agree, and bounds that keep logarithms finite."""
    share, m, u = 0.1, [0.9] * fields, [0.1] * fields
    clip = lambda x: min(max(x, 1e-4), 1 - 1e-4)
    for _ in range(rounds):
        now = Weights(clip(share), tuple(map(clip, m)), tuple(map(clip, u)))
        known = {p: now.probability(p) for p in patterns}
        match, other = sum(n * known[p] for p, n in patterns.items()), sum(n * (1 - known[p]) for p, n in patterns.items())
        share = match / max(match + other, 1e-9)
        for k in range(fields):
            seen = [(n, known[p], p[k] == "1") for p, n in patterns.items() if p[k] != "-"]
            m[k] = sum(n * w for n, w, hit in seen if hit) / max(sum(n * w for n, w, _ in seen), 1e-9)
            u[k] = sum(n * (1 - w) for n, w, hit in seen if hit) / max(sum(n * (1 - w) for n, w, _ in seen), 1e-9)
    return Weights(clip(share), tuple(map(clip, m)), tuple(map(clip, u)))


def candidate_pairs(df: DataFrame, key: str, fields: list[str], blocks: list[str]) -> DataFrame:
    """a, b (keys, a < b), pattern: each pair that shares a blocking expression, once. Null shares nothing.

    A block of more than LARGEST rows is paired only where the next expression agrees too (and so on, in a ring); pairs of
    its rows that share another expression are found by that.
    """
    names = [f"_block{k}" for k in range(len(blocks))]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *(F.col(c).alias(f"_field{k}") for k, c in enumerate(fields)), *(F.expr(e).cast("string").alias(n) for e, n in zip(blocks, names, strict=True)))
    found = []
    for k, name in enumerate(names):
        ring = names[k:] + names[:k]
        sizes = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n")).where("_n > 1")
        held = rows.join(sizes, name)
        # as many expressions of the ring as it takes: one for blocks up to LARGEST, two beyond
        held = held.withColumn("_by", F.when(F.col("_n") <= LARGEST, F.lit("")).otherwise(F.col(ring[1]) if len(ring) > 1 else F.col("_key").cast("string"))).where("_by is not null")
        side = lambda s, df=held: df.select(F.col(name).alias("_on"), "_by", *(F.col(c).alias(f"{s}{c}") for c in rows.columns))  # noqa: E731, B023
        pairs = side("a").join(side("b"), ["_on", "_by"]).where("a_key < b_key")
        first = functools.reduce(lambda x, y: x & y, (~F.coalesce(F.col(f"a{n}") == F.col(f"b{n}"), F.lit(False)) for n in names[:k]), F.lit(True))
        found.append(pairs.where(first))
    agree = [F.when(F.col(f"a_field{k}").isNull() | F.col(f"b_field{k}").isNull(), "-").when(F.col(f"a_field{k}") == F.col(f"b_field{k}"), "1").otherwise("0") for k in range(len(fields))]
    every = functools.reduce(lambda x, y: x.unionByName(y), found)
    return every.select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), F.concat(*agree).alias("pattern")).distinct()


def linked(df: DataFrame, key: str, fields: list[str], blocks: list[str], least: float = 0.9) -> DataFrame:
    """a, b, pattern, weight, probability for the pairs that are matches with at least that probability.

    Null fields say nothing; rows with a null key take no part; repeated keys are one record. An empty table: no rows.
    """
    pairs = candidate_pairs(df, key, fields, blocks)
    counts = {r.pattern: r.n for r in pairs.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # 3 ** len(fields) at most
    weights = expectation_maximisation(counts, len(fields))
    table = [(p, weights.of(p), weights.probability(p)) for p in counts]
    known = df.sparkSession.createDataFrame(table, "pattern string, weight double, probability double")
    return pairs.join(F.broadcast(known), "pattern").where(F.col("probability") >= least).select("a", "b", "pattern", "weight", "probability")
