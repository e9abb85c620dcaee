"""Record linkage: rows of which one field was edited are found, and no others."""

import math

from pyspark.sql import functions as F

from quern.operators import linkage
from tests.compare import SMALL

FIELDS = ["c_name", "c_nationkey", "c_mktsegment", "c_acctbal"]
BLOCKS = ["c_name", "c_acctbal", "c_nationkey"]


def customers(spark):
    """customer with copies of every tenth row, each with one field edited."""
    rows = spark.read.parquet(f"{SMALL}/customer.parquet").select("c_custkey", *FIELDS).withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(12,2)"))
    copy = rows.where("c_custkey % 10 = 3").withColumn("edit", (F.col("c_custkey") / 10).cast("int") % 3)
    copy = copy.withColumns({
        "c_name": F.when(F.col("edit") == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name")),
        "c_mktsegment": F.when(F.col("edit") == 1, F.lit("OTHER")).otherwise(F.col("c_mktsegment")),
        "c_acctbal": F.when(F.col("edit") == 2, F.col("c_acctbal") + 5000).otherwise(F.col("c_acctbal")),
    })
    return rows.union(copy.drop("edit").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))


def test_rows_with_one_edited_field_are_found(spark):
    df = customers(spark)
    found = {(r.a, r.b) for r in linkage.linked(df, "c_custkey", FIELDS, BLOCKS).collect()}
    want = {(r[0], r[0] + 1_000_000) for r in df.where("c_custkey % 10 = 3 and c_custkey < 1000000").select("c_custkey").collect()}
    assert want <= found and len(found - want) <= len(want) // 20


def test_candidates_by_brute_force(spark):
    """Every pair that shares a block, once; with small blocks only, and with blocks that are cut."""
    df = customers(spark).where("c_custkey % 10 in (3, 4)").withColumn("c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")))
    rows = [(r.c_custkey, r.c_name, r.c_acctbal, r.c_nationkey) for r in df.collect()]
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and any(p is not None and p == q for p, q in zip(x[1:], y[1:], strict=True))}
    pairs = linkage.candidate_pairs(df, "c_custkey", FIELDS, BLOCKS).collect()
    assert {(r.a, r.b) for r in pairs} == want and len(pairs) == len(want)


def test_large_blocks_are_not_paired_whole(spark, monkeypatch):
    monkeypatch.setattr(linkage, "LARGEST", 50)
    df = spark.range(2000).select("id", F.lit("hot").alias("x"), (F.col("id") / 2).cast("int").alias("y"))
    pairs = linkage.candidate_pairs(df, "id", ["x", "y"], ["x", "y"])
    assert {(r.a, r.b) for r in pairs.collect()} == {(2 * k, 2 * k + 1) for k in range(1000)}


def test_weights_are_learnt_from_counts():
    """Counts drawn from known shares give these back."""
    m, u, share, n = (0.95, 0.9, 0.8), (0.02, 0.1, 0.3), 0.05, 1_000_000
    pattern = lambda bits, q: math.prod(x if b == "1" else 1 - x for b, x in zip(bits, q, strict=True))
    counts = {b: round(n * (share * pattern(b, m) + (1 - share) * pattern(b, u))) for b in (f"{k:03b}" for k in range(8))}
    found = linkage.expectation_maximisation(counts, 3)
    assert abs(found.share - share) < 0.01 and all(abs(x - y) < 0.05 for x, y in zip((*found.m, *found.u), (*m, *u), strict=True))
    assert found.of("111") > found.of("110") > found.of("000") and found.of("---") == 0


def test_edges(spark):
    schema = "k long, f string, g string"
    rows = [(1, "a", "x"), (1, "a", "x"), (None, "a", "x"), (2, "a", "x"), (3, None, None)]
    pairs = linkage.candidate_pairs(spark.createDataFrame(rows, schema), "k", ["f", "g"], ["f"])
    assert [tuple(r) for r in pairs.collect()] == [(1, 2, "11")]
    assert linkage.linked(spark.createDataFrame([], schema), "k", ["f", "g"], ["f"]).count() == 0
