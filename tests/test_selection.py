"""Quantiles by selection and prefixes by order, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import dq
from quern.operators.quantiles import exact_quantiles

FRACTIONS = [0.0, 0.25, 0.5, 0.731, 0.99, 1.0]


def want(rows):
    out = {}
    for group, v in rows:
        out.setdefault(group, []).extend([] if v is None else [float(v)])
    return {g: [float(np.quantile(np.sort(x), p)) if x else None for p in FRACTIONS] for g, x in out.items()}


def check(spark, rows, limit):
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    found = {r[0]: [*r[1:]] for r in exact_quantiles(df, ["g"], "v", FRACTIONS, limit).collect()}
    expected = want(rows)
    assert found.keys() == expected.keys()
    for g, x in expected.items():
        assert all((a is None and b is None) or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-300) for a, b in zip(found[g], x, strict=True)), (g, found[g], x)


@pytest.mark.parametrize("limit", [100_000, 50])
def test_quantiles_of_odd_groups(spark, limit):
    """One hot group, ties, values of all sizes, nulls, a null group, small and empty groups."""
    rng = random.Random(1)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(6000)] + [(None, float(rng.randint(0, 3))) for _ in range(700)] + [("same", 7.5)] * 500 + [("steep", 2.0**k) for k in range(-500, 500)]
    rows += [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None), ("half", None), ("half", 4.0)] + [("hot", None)] * 50 + [("mostly", 0.0)] * 900 + [("mostly", float(k)) for k in range(-60, 60)]
    rng.shuffle(rows)
    check(spark, rows, limit)


def test_no_group_is_gathered(spark):
    """Of 100,000 values with few ties, a round leaves about a sixty-fourth; the limit holds for every gathered list."""
    df = spark.range(100_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    values = sorted((k * 7919 % 100_003) for k in range(100_000))
    found = exact_quantiles(df, ["g"], "v", [0.5, 0.9], 300).first()
    assert found.q1 == (values[49_999] + values[50_000]) / 2 and math.isclose(found.q2, values[89_999] + 0.1 * (values[90_000] - values[89_999]))


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5]).count() == 0
    two = spark.createDataFrame([(1, None, 2.0), (1, None, 4.0), (1, "x", None)], "a int, b string, v double")
    assert {tuple(r) for r in exact_quantiles(two, ["a", "b"], "v", [0.5]).collect()} == {(1, None, 3.0), (1, "x", None)}


def test_prefixes_are_found_in_order(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(600)}
    whole = {w for w in words if rng.random() < 0.3}
    rows = [(w, w in whole) for w in words]
    df = spark.createDataFrame(rows, "value string, whole boolean").repartition(5)
    found = {r.value: r.full for r in dq.begun_by(df, F.col("whole")).collect()}
    by_bytes = sorted(whole, key=str.encode)
    expected = {w: f for w in words - whole if (f := next((x for x in by_bytes if x.startswith(w)), None)) is not None}
    assert found == expected and len(expected) > 50


def test_many_values_of_one_block(spark):
    """A hundred thousand values that share their first characters; pairing them would be 10^10 rows."""
    df = spark.range(100_000).select(F.col("id"), F.concat(F.lit("shared-prefix-"), F.col("id").cast("string")).alias("v"))
    often = df.unionByName(df.where("id % 10 = 3"))
    found = dq.truncated(often, "id", "v", 5, 2)
    rows = {r.id: r.full for r in found.collect()}
    assert len(rows) > 5000 and all(f.startswith(f"shared-prefix-{k}") and int(f.rpartition("-")[2]) % 10 == 3 for k, f in rows.items())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert rows[1] == "shared-prefix-10003" and 3 not in rows and "NestedLoop" not in plan and "Cartesian" not in plan


def test_prefix_edges(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "ab"), (4, "a"), (5, None), (6, "abd"), (7, ""), (8, "abc")], "k int, v string")
    assert sorted(map(tuple, dq.truncated(df, "k", "v", 2, 2).collect())) == [(3, "ab", "abc")]
    assert dq.truncated(df.limit(0), "k", "v", 2, 2).count() == 0


def test_sketches_add_up(spark):
    """Months merge to years within the stated error, batches that overlap count once, and small counts are near exact."""
    from quern.operators import sketches

    df = spark.range(300_000).select((F.col("id") % 3).alias("g"), F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("day"), (F.col("id") * 7 % 90_000).alias("v"))
    kept = sketches.monthly(df.where("id % 2 = 0"), ["g"], "day", "v")
    kept = sketches.added(kept, sketches.monthly(df.where("id % 2 = 1 or id % 5 = 0"), ["g"], "day", "v"), ["g"])
    assert kept.count() == 3 * 23
    for first, last, where in ((None, None, "true"), ("2023-03", "2023-12", "day between '2023-03-01' and '2023-12-31'"), ("2024-01", "2024-01", "day between '2024-01-01' and '2024-01-31'")):
        exact = {r.g: r.n for r in df.where(where).groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
        found = {r.g: r.distinct for r in sketches.distinct_in(kept, ["g"], first, last).collect()}
        assert found.keys() == exact.keys() and all(abs(found[g] - n) <= sketches.error() * n for g, n in exact.items())
    few = sketches.distinct_in(sketches.monthly(df.limit(0), ["g"], "day", "v"), ["g"])
    assert few.count() == 0


def test_digest_trees_give_the_classes_of_a_full_join(spark):
    """New, changed, deleted and equal keys, null hashes and keys, revived rows; only unequal buckets reach the join."""
    from quern.operators import merge

    rng = random.Random(4)
    old = [(k, f"h{rng.randint(0, 3)}" if rng.random() < 0.95 else None) for k in range(3000)] + [(None, "x")]
    new = [(k, h if rng.random() < 0.99 else rng.choice(["new", None])) for k, h in old if k is not None and rng.random() < 0.99] + [(k, "n") for k in range(3000, 3040)] + [(None, "x")]
    t, b = (spark.createDataFrame(x, "k long, _row_hash string") for x in (old, new))
    of, nf = ({k: h for k, h in x if k is not None} for x in (old, new))
    want = [(k, "D" if k not in nf else "I" if k not in of else "N" if of[k] == nf[k] else "U") for k in of | nf] + [(None, "I"), (None, "D")]
    assert sorted(map(tuple, merge.fdc_classes(t, b, ["k"]).collect()), key=repr) == sorted(want, key=repr)
    equal, some, _ = merge.parted(t, b, ["k"], "_row_hash")
    assert equal.count() > 2500 and some.count() < 400
    assert merge.unequal(*(merge.digests(x, ["k"], "_row_hash") for x in (t, t))).count() == 0
    once = merge.fdc_merge(t.where("k is not null"), b.where("k is not null"), ["k"])
    assert {r.k: r._is_deleted for r in once.collect()} == {k: k not in nf for k in of | nf}
    again = {r.k: (r._row_hash, r._is_deleted) for r in merge.fdc_merge(once, t.where("k is not null"), ["k"]).collect()}
    assert again == {k: (of.get(k, nf.get(k)), k not in of) for k in of | nf}


def test_a_job_leaves_no_folders_behind(spark, tmp_path):
    import os

    from quern.sources import scratch

    df = spark.createDataFrame([("g", float(k)) for k in range(500)], "g string, v double")
    before = {*os.listdir(scratch.shared_folder(spark))}
    with scratch.job(spark):
        exact_quantiles(df, ["g"], "v", [0.5], 50).write.parquet(f"{tmp_path}/out")
        assert {*os.listdir(scratch.shared_folder(spark))} - before
    assert {*os.listdir(scratch.shared_folder(spark))} - before == set()
    assert spark.read.parquet(f"{tmp_path}/out").first().q1 == 249.5
