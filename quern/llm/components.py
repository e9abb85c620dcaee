"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import discard, kept


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that links (a, b) reach from each node that has a link to another one.

    Each step takes minima by node (combined before the shuffle) and joins them back, so a node with very many links is
    a skewed join, which adaptive execution splits. The number of rounds grows with the logarithm of the longest chain.
    Links with a null end, links of a node to itself and repeated links change nothing.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = kept(links.where("a <> b").select(u, v).distinct())
    seen = None
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges, before = kept(small.where("u <> v").distinct()), edges
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
