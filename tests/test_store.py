"""Snapshot tables: schemas that change, parts by bucket and month, counts by kind."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import evolution, merge
from quern.plans.jobs import Pipeline
from quern.schema import TableSpec
from quern.sources.scratch import new_folder
from quern.sources.store import BUCKET, SnapshotStore, dispatch_write
from quern.streaming.jobs import upsert_batch


@pytest.fixture
def store(spark):
    return SnapshotStore(spark, new_folder(spark, "store"))


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_an_appended_column_stays(spark, store):
    store.write("t", table(spark, [(1, 1.5)], "id int, v double"))
    store.append("t", table(spark, [(2, 2.5, "x")], "id int, v double, extra string"))
    store.append("t", table(spark, [(3,)], "id int"))
    assert got(store.read("t"), "id", "v", "extra") == [(1, 1.5, None), (2, 2.5, "x"), (3, None, None)]
    assert got(store.read("t", ["extra"])) == [("x",), (None,), (None,)]


def test_types_widen_or_fail(spark, store):
    store.write("t", table(spark, [(1, 7)], "id int, v int"))
    store.append("t", table(spark, [(2**40, 8)], "id long, v long"))
    store.append("t", table(spark, [(3, 2.5)], "id int, v double"))
    assert got(store.read("t")) == [(1, 7.0), (2**40, 8.0), (3, 2.5)] and dict(store.read("t").dtypes) == {"id": "bigint", "v": "double"}
    store.append("t", table(spark, [(4, "text")], "id int, v string"))
    with pytest.raises(TypeError, match="column v"):
        store.read("t")


@pytest.mark.parametrize(("a", "b", "both"), [("int", "bigint", "bigint"), ("tinyint", "double", "double"), ("decimal(10,2)", "decimal(12,4)", "decimal(12,4)"), ("bigint", "decimal(10,2)", "decimal(21,2)"), ("decimal(38,0)", "decimal(38,10)", "double"), ("void", "string", "string"), ("date", "timestamp_ntz", "timestamp_ntz"), ("array<int>", "array<bigint>", "array<bigint>"), ("string", "int", None), ("boolean", "int", None), ("date", "string", None)])
def test_lattice(spark, a, b, both):
    kinds = [T._parse_datatype_string(f"c {k}")["c"].dataType if k != "void" else T.NullType() for k in (a, b)]
    for x, y in (kinds, kinds[::-1]):
        found = evolution.joined(x, y)
        assert (found.simpleString() if found else None) == both


def test_upsert_keeps_new_and_old_columns(spark):
    target, batch = table(spark, [(1, 1, "a"), (2, 2, "b")], "k int, n int, old string"), table(spark, [(2, 2**40, True), (3, 3, False)], "k int, n long, new boolean")
    assert got(merge.upsert(target, batch, ["k"]), "k", "n", "old", "new") == [(1, 1, "a", None), (2, 2**40, None, True), (3, 3, None, False)]


def test_pipeline_takes_a_new_column(spark):
    spec, p = TableSpec("e", "id", "at"), Pipeline(spark, new_folder(spark, "layers"), "2024-01-31")
    first = table(spark, [("1", "2024-01-01 00:00:00")], "id string, at string")
    p.ingest_table(spec, first)
    more = table(spark, [("1", "2024-01-01 00:00:00", "old"), ("2", "2024-01-02 00:00:00", "new")], "id string, at string, note string")
    assert p.ingest_table(spec, more, "INCREMENTAL")["output_rows"] == 1
    assert got(p.stores["bronze"].read("e"), "id", "note") == [("1", None), ("2", "new")]


def test_partition_values_keep_their_types(spark, store):
    """Values that look like numbers stay text, in every folder."""
    for v in ("2024", "2024-01", "007"):
        store.append("t", table(spark, [(1, v)], "k int, p string"), ("p",))
    assert got(store.read("t"), "p") == [("007",), ("2024",), ("2024-01",)]


def folders(store, name):
    return {k: max(v) for k, v in store.snapshot(name).parts.items()}


def test_a_batch_rewrites_only_its_buckets(spark, store):
    spec = TableSpec("t", "k", "at", buckets=16)
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit("2024-01-01").alias("at"))
    done = dispatch_write(store, spec, rows, "CDC", as_of="2024-01-10")
    assert (done, done.inserted, done.updated, done.deleted) == (1000, 1000, 0, 0) and len(folders(store, "t")) == 16
    before = folders(store, "t")
    done = dispatch_write(store, spec, table(spark, [(5, "b", "2024-01-02")], "k long, v string, at string"), "CDC", as_of="2024-01-10")
    after = folders(store, "t")
    assert len([p for p in after if after[p] != before[p]]) == 1 and (done.inserted, done.updated) == (0, 1) and done < 120
    assert BUCKET not in store.read("t").columns and dict(got(store.read("t").where("k in (5, 6)"), "k", "v")) == {5: "b", 6: "a"} and store.read("t").count() == 1000
    gone = table(spark, [(5,), (7,), (7,), (-1,)], "k long")
    done = dispatch_write(store, spec, table(spark, [(2000, "n", "2024-01-03")], "k long, v string, at string"), "CDC", as_of="2024-01-10", gone=gone)
    assert (done.inserted, done.updated, done.deleted) == (1, 0, 2)
    assert got(store.read("t").where("_is_deleted"), "k") == [(5,), (7,)] and store.read("t").count() == 1001


def test_null_keys_and_empty_batches_in_buckets(spark, store):
    spec = TableSpec("t", "k", "at", buckets=4)
    schema = "k long, v string, at string"
    dispatch_write(store, spec, table(spark, [], schema), "CDC", as_of="2024-01-10")
    assert store.read("t").count() == 0 and store.read("t").columns == ["k", "v", "at"]
    dispatch_write(store, spec, table(spark, [(None, "x", None), (1, "y", None)], schema), "CDC", as_of="2024-01-10")
    dispatch_write(store, spec, table(spark, [], schema), "CDC", as_of="2024-01-10")
    assert got(store.read("t"), "k", "v") == [(1, "y"), (None, "x")]


def test_streams_rewrite_their_buckets_and_older_batches_lose(spark, store):
    spec, schema = TableSpec("t", "k", buckets=8), "k long, n long"
    batch = lambda *rows: table(spark, rows, schema)
    upsert_batch(spark.range(200).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("n")), 0, store, spec, "update")
    before = folders(store, "t")
    upsert_batch(batch((3, 30)), 2, store, spec, "update")
    after = folders(store, "t")
    assert len([p for p in after if after[p] != before[p]]) == 1
    upsert_batch(batch((3, 10), (4, 40)), 1, store, spec, "update")  # an older batch that runs again
    assert got(store.read("t").where("k in (3, 4)"), "k", "n") == [(3, 30), (4, 40)]
    upsert_batch(batch((3, 30)), 2, store, spec, "update")
    assert got(store.read("t").where("k = 3"), "k", "n") == [(3, 30)] and store.read("t").count() == 200


def test_an_older_event_never_wins(spark, store):
    spec, schema = TableSpec("t", "k", "at", buckets=2), "k long, at string, v string"
    upsert_batch(table(spark, [(1, "2024-01-05", "late"), (2, "2024-01-01", "x")], schema), 0, store, spec)
    upsert_batch(table(spark, [(1, "2024-01-04", "early"), (2, "2024-01-02", "y")], schema), 1, store, spec)
    assert got(store.read("t"), "k", "v") == [(1, "late"), (2, "y")]


@pytest.mark.parametrize("by_month", [False, True])
def test_window_touches_only_the_months_after_the_cutoff(spark, store, by_month):
    spec = TableSpec("t", "k", "at", window_days=20, by_month=by_month)
    start = datetime.date(2023, 10, 1)
    days = [(k, (start + datetime.timedelta(days=k)).isoformat(), "old") for k in range(110)] + [(999, "no date", "old"), (998, None, "old")]
    dispatch_write(store, spec, table(spark, days, "k int, at string, v string"), "FULL", as_of="2024-01-15")
    before = folders(store, "t")
    batch = table(spark, [(k, d, "new") for k, d, _ in days if k % 2 == 0], "k int, at string, v string")
    for _ in range(2):
        done = dispatch_write(store, spec, batch, "WINDOW", as_of="2024-01-15")
        want = [(k, d, "old") for k, d, _ in days if d is None or d <= "2023-12-26" or d == "no date"] + [(k, d, "new") for k, d, _ in days if d and "2023-12-26" < d < "3" and k % 2 == 0]
        assert got(store.read("t"), "k", "at", "v") == sorted(want, key=repr)
        assert done.inserted == 11
    if by_month:
        after = folders(store, "t")
        assert {p for p in after if after[p] == before[p]} == {"_month=2023-10", "_month=2023-11", "_month=__HIVE_DEFAULT_PARTITION__"}


def test_counts_by_kind(spark, store):
    spec, schema = TableSpec("t", "k", "at", tracked=("v",)), "k int, v string, at string"
    rows = table(spark, [(1, "a", "2024-01-01"), (2, "b", "2024-01-01")], schema)
    more = table(spark, [(2, "c", "2024-01-02"), (3, "d", "2024-01-02")], schema)
    kinds = lambda d: (int(d), d.inserted, d.updated, d.deleted)
    assert kinds(dispatch_write(store, spec, rows, "SCD2", as_of="2024-01-01")) == (2, 2, 0, 0)
    assert kinds(dispatch_write(store, spec, more, "SCD2", as_of="2024-01-02")) == (4, 2, 1, 0)
    fdc = TableSpec("f", "k", "at")
    hashed = lambda df: df.withColumn("_row_hash", F.md5("v"))
    assert kinds(dispatch_write(store, fdc, hashed(rows), "FDC", as_of="2024-01-01")) == (2, 2, 0, 0)
    assert kinds(dispatch_write(store, fdc, hashed(more), "FDC", as_of="2024-01-02")) == (3, 1, 1, 1)
    assert kinds(dispatch_write(store, fdc, hashed(more), "FDC", as_of="2024-01-02")) == (3, 0, 0, 0)
    assert kinds(dispatch_write(store, TableSpec("g", "k"), more, "INCREMENTAL", as_of="2024-01-02")) == (2, 2, 0, 0)


def test_parts_and_old_snapshots_can_be_read(spark, store):
    spec = TableSpec("t", "k", buckets=4)
    dispatch_write(store, spec, spark.range(40).select(F.col("id").alias("k"), F.lit(0).alias("v")), "CDC", as_of="2024-01-01")
    since = store.pointer("t")
    dispatch_write(store, spec, spark.range(1).select(F.col("id").alias("k"), F.lit(1).alias("v")), "CDC", as_of="2024-01-01")
    assert store.read("t", at=since).where("v = 1").count() == 0 and store.read("t").where("v = 1").count() == 1
    old, new = store.changed("t", since)
    assert 0 < old.count() < 40 and old.count() == new.count()
    with pytest.raises(ValueError, match="by bucket or by month"):
        TableSpec("x", "k", buckets=2, by_month=True)
