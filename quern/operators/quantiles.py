"""Exact quantiles by selection: no task holds the values of a group.

A group of up to LIMIT values is sorted in one aggregate. For each quantile of a larger group, the values are counted by
ranges between EDGES approximate quantiles (a sketch of bounded size), and the range that holds the rank is entered with
the rank that is left, until it holds one value, however often, or at most LIMIT. A round leaves about an EDGES-th of the
values, whatever their distribution.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import new_folder

LIMIT = 100_000
EDGES = 64


def _kept(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession, "quantiles")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(a: str, b: str, columns: list[str]) -> Column:
    """Equality of columns of two aliased frames; null is equal to null."""
    return functools.reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns), F.lit(True))


def exact_quantiles(df: DataFrame, by: list[str], value: str, fractions: list[float], limit: int | None = None) -> DataFrame:
    """by, and q1, q2, ... for each fraction: interpolated between the two nearest values, as the percentile aggregate does.

    Null values do not count (a group of only nulls has null quantiles), NaN is the largest value, null is a group of its
    own. Ties and repeated rows count each time. An empty table has no groups.
    """
    limit = LIMIT if limit is None else limit
    names = [f"q{i + 1}" for i in range(len(fractions))]
    rows = df.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col(value).cast("double").alias("_v"))
    keys = [c for c in rows.columns if c != "_v"]
    sizes = _kept(rows.groupBy(*keys).agg(F.count("_v").alias("_n")))
    large = sizes.where(F.col("_n") > limit)
    small = rows.alias("r").join(sizes.where(F.col("_n") <= limit).alias("s"), _same("r", "s", keys)).select(*(f"r.{c}" for c in keys), "r._v")
    q = F.percentile("_v", F.array(*map(F.lit, fractions)))
    out = small.groupBy(*keys).agg(q.alias("_q")).select(*keys, *(F.col("_q")[i].alias(n) for i, n in enumerate(names)))
    if not large.isEmpty():
        out = out.union(_selected(rows, keys, large, fractions, names, limit))
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), *names)


def _selected(rows: DataFrame, keys: list[str], large: DataFrame, fractions: list[float], names: list[str], limit: int) -> DataFrame:
    at = lambda p: F.lit(p) * (F.col("_n") - 1)
    ranks = F.array_distinct(F.array(*(f(at(p)).cast("long") for p in fractions for f in (F.floor, F.ceil))))
    state = large.select(*keys, F.explode(ranks).alias("_rank")).withColumns({"_left": F.col("_rank"), "_lo": F.lit(float("-inf")), "_hi": F.lit(float("nan")), "_count": F.lit(None).cast("long")})
    state, found = _kept(state), None
    while True:
        done = state.where((F.col("_lo") == F.col("_hi")) | (F.col("_count") <= limit))
        found = done if found is None else found.union(done)
        state = _kept(state.where(~((F.col("_lo") == F.col("_hi")) | (F.coalesce("_count", F.lit(limit + 1)) <= limit))))
        if state.isEmpty():
            break
        spans = state.select(*keys, "_lo", "_hi").distinct()
        own = [*keys, "_lo", "_hi"]
        held = rows.alias("r").join(spans.alias("s"), _same("r", "s", keys) & F.col("_v").between(F.col("_lo"), F.col("_hi"))).select(*(f"s.{c}" for c in own), "_v")
        steps = [k / EDGES for k in range(1, EDGES)]
        edges = _kept(held.groupBy(*own).agg(F.percentile_approx("_v", steps, 100 * EDGES).alias("_edges")))
        cut = rows.alias("r").join(edges.alias("s"), _same("r", "s", keys) & F.col("_v").between(F.col("_lo"), F.col("_hi"))).select(*(f"s.{c}" for c in own), "_v", "s._edges")
        # a value that is an edge has a range of its own, so that ties leave it at once
        bin = F.expr("2 * size(filter(_edges, e -> e < _v)) + if(array_contains(_edges, _v), 1, 0)")
        bins = cut.groupBy(*own, bin.alias("_bin")).agg(F.count("*").alias("_k"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        bins = bins.withColumn("_upto", F.sum("_k").over(Window.partitionBy(*own).orderBy("_bin")))  # EDGES ranges or so
        a, b = state.alias("a"), _kept(bins).alias("b")
        hit = (F.col("a._left") < F.col("b._upto")) & (F.col("a._left") >= F.col("b._upto") - F.col("b._k"))
        state = a.join(b, _same("a", "b", own) & hit)
        state = _kept(state.select(*(f"a.{c}" for c in keys), "a._rank", (F.col("a._left") - F.col("b._upto") + F.col("b._k")).alias("_left"), F.col("b._least").alias("_lo"), F.col("b._most").alias("_hi"), F.col("b._k").alias("_count")))
    found = _kept(found)
    one = found.where("_lo = _hi").select(*keys, "_rank", F.col("_lo").alias("_at"))
    few = found.where("_lo <> _hi").alias("s")
    lists = rows.alias("r").join(few.select(*keys, "_lo", "_hi").distinct().alias("t"), _same("r", "t", keys) & F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*(F.col(f"t.{c}").alias(c) for c in [*keys, "_lo", "_hi"])).agg(F.sort_array(F.collect_list("_v")).alias("_values"))
    own = [*keys, "_lo", "_hi"]
    more = few.join(lists.alias("l"), _same("s", "l", own)).select(*(f"s.{c}" for c in keys), "s._rank", F.get("_values", F.col("s._left").cast("int")).alias("_at"))
    values = one.union(more).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_at"))).alias("_of"))
    both = large.alias("n").join(values.alias("v"), _same("n", "v", keys)).select(*(f"n.{c}" for c in keys), "_n", "_of")

    def quantile(p: float):
        low, high = F.floor(at(p)).cast("long"), F.ceil(at(p)).cast("long")
        share = at(p) - low
        return F.when(low == high, F.col("_of")[low]).otherwise((F.lit(1.0) - share) * F.col("_of")[low] + share * F.col("_of")[high])

    return both.select(*keys, *(quantile(p).alias(n) for p, n in zip(fractions, names, strict=True)))
