"""Operators on hand-written rows, and properties of the load modes."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import scalars
from quern.operators import clean, dq, merge, monitor, rows
from quern.plans import star
from quern.plans.jobs import Pipeline
from quern.queries import QUERIES, SQL
from quern.schema import TABLES, Rule, TableSpec, register_table
from quern.sources import files
from quern.sources.scratch import new_folder
from quern.sources.store import SnapshotStore, dispatch_write
from tests.compare import assert_same, duck


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_lenient_casts(spark):
    df = table(spark, [("2.7",), ("-3.9",), ("TEXT",), (None,), ("1e99",)], "x string").select("x", scalars.to_int(F.col("x")).alias("i"))
    assert {r.x: r.i for r in df.collect()} == {"2.7": 2, "-3.9": -3, "TEXT": None, None: None, "1e99": None}
    one = table(spark, [("2024-02-30", "yes", "None")], "d string, b string, n string").select(scalars.to_date(F.col("d")), scalars.to_bool(F.col("b")), scalars.normalize_nulls(F.col("n"))).first()
    assert tuple(one) == (None, True, None)


def test_row_hash_modes(spark):
    df = table(spark, [("a|b", ""), ("a", "b|"), ("x", None), ("x", "")], "p string, q string")
    compat = [r[0] for r in df.select(rows.row_hash(df, mode="compat")).collect()]
    safe = [r[0] for r in df.select(rows.row_hash(df)).collect()]
    assert compat[2] == compat[3] and len({*safe}) == 4
    booleans = table(spark, [(1, True), (1, None)], "k int, flag boolean")
    assert booleans.select(rows.row_hash(booleans)).distinct().count() == 2


def test_safe_pct_and_buckets(spark):
    r = spark.range(1).select(scalars.safe_pct(F.lit(None), F.lit(5)), scalars.safe_pct(F.lit(1), F.lit(0)), scalars.safe_pct(F.lit(1), F.lit(3)), scalars.aging_bucket(F.lit(None).cast("int")), scalars.aging_bucket(F.lit(-4)), scalars.bins(F.lit(0), [0, 17], ["0-17"])).first()
    assert tuple(r) == (0.0, None, 33.33, "120+", "0-30", None)


def test_issues_before_repairs_in_rule_order(spark):
    rules = [Rule("swapped_days", "swapped", "a", "b", repair="swap"), Rule("negative_x", "negative", "x", repair="null")]
    df = table(spark, [(1, "2024-02-02", "2024-01-01", -1.0), (2, "2024-01-01", None, 2.0), (3, None, None, None)], "k int, a string, b string, x double").withColumns({c: F.col(c).cast("date") for c in "ab"})
    out = {r.k: r for r in clean.repaired(clean.flagged(df, rules), rules).collect()}
    assert out[1]._dq_issues == "swapped_days, negative_x" and out[1].x is None and out[1].a < out[1].b
    assert not out[2]._dq_flag and out[2]._dq_issues is None and out[2].b is None and not out[3]._dq_flag


def test_clean_is_repeatable_and_fails_loudly(spark):
    spec = TableSpec("t", "id", "at", casts={"n": "int", "at": "date"}, upper=("id",))
    data = [("a1", "1", "2024-01-01", "dirty"), ("A1 ", "2", "2024-01-02", "clean"), ("a1", "3", "2024-01-02", "dirty"), (None, "4", None, "clean"), ("none", "5", None, "clean")]
    df = table(spark, data, "id string, n string, at string, _source string")
    assert [(r.id, r.n) for r in clean.clean_table(df, spec).collect()] == [("A1", 2)]
    assert clean.clean_table(df.limit(0), spec).count() == 0
    with pytest.raises(ValueError, match="lacks"):
        clean.clean_table(df.drop("n"), spec)


def test_tables_are_consistent():
    assert len(TABLES) == 20
    for spec in TABLES.values():
        assert spec.mode != "SCD2" or spec.tracked
    with pytest.raises(ValueError, match="registered already"):
        register_table(TABLES["claims"])
    with pytest.raises(ValueError, match="unknown mode"):
        TableSpec("x", "id", mode="MERGE")


batches = st.dictionaries(st.integers(0, 8), st.sampled_from(["a", "b", None]), max_size=6)
few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@few
@given(batches, batches)
def test_merge_properties(spark, old, new):
    t, b = (table(spark, [*d.items()], "k int, v string") for d in (old, new))
    once = merge.upsert(t, b, ["k"])
    assert dict(got(once, "k")) == old | new == dict(got(merge.upsert(once, b, ["k"]), "k"))
    th, bh = (df.withColumn("_row_hash", rows.row_hash(df)) for df in (t, b))
    kinds = dict(got(merge.fdc_classes(th, bh, ["k"]), "k"))
    assert kinds == {k: "I" if k not in old else "D" if k not in new else "U" if old[k] != new[k] else "N" for k in old | new}
    full = merge.fdc_merge(th, bh, ["k"]).select("k", "v", "_is_deleted")
    assert {r.k: (r.v, r._is_deleted) for r in full.collect()} == {k: (new.get(k, old.get(k)) if k in new else old[k], k not in new) for k in old | new}


@few
@given(batches, batches, batches)
def test_scd2_history(spark, first, second, third):
    history = None
    days = (first, second, third)
    for i, data in enumerate(days):
        batch = table(spark, [*data.items()], "k int, v string")
        day = f"2024-01-0{i + 1}"
        history = merge.scd2_init(batch, day) if history is None else merge.scd2_merge(history, batch, ["k"], ["v"], day)
        again = merge.scd2_merge(history, batch, ["k"], ["v"], "2030-01-01")
        assert got(again.select("k", "v", F.col("_effective_from").cast("string"), "_is_current")) == got(history.select("k", "v", F.col("_effective_from").cast("string"), "_is_current"))
    found = history.collect()
    current = {r.k: r.v for r in found if r._is_current}
    want = {}
    for data in days:
        want |= data
    assert current == want and len(current) == sum(r._is_current for r in found)
    for k in current:
        versions = sorted((r for r in found if r.k == k), key=lambda r: r._effective_from)
        assert all(a._effective_to == b._effective_from for a, b in zip(versions, versions[1:], strict=False))


def test_window_replace_twice(spark):
    t = table(spark, [(1, "2024-01-01"), (2, "2024-01-20"), (3, None)], "k int, at string")
    b = table(spark, [(9, "2024-01-21"), (8, "2024-01-02")], "k int, at string")
    cutoff = F.lit("2024-01-10").cast("date")
    once = merge.window_replace(t, b, "at", cutoff)
    assert {r.k for r in once.collect()} == {1, 3, 9} == {r.k for r in merge.window_replace(once, b, "at", cutoff).collect()}


def test_soft_delete_stays(spark):
    t = table(spark, [(1,), (2,), (3,)], "k int")
    once = merge.soft_delete(t, table(spark, [(1,)], "k int"), ["k"])
    assert dict(got(merge.soft_delete(once, table(spark, [(2,), (2,)], "k int"), ["k"]))) == {1: True, 2: True, 3: False}


def test_store_modes(spark):
    store = SnapshotStore(spark, new_folder(spark, "store"))
    spec = TableSpec("t", "k", "at", window_days=5, tracked=("v",))
    df = table(spark, [(1, "a", "2024-01-01"), (2, "b", "2024-01-09")], "k int, v string, at string")
    assert store.read("t") is None and dispatch_write(store, spec, df, "FULL", as_of="2024-01-10") == 2
    twice = table(spark, [(2, "x", "2024-01-09"), (2, "y", "2024-01-10"), (3, "z", "2024-01-10")], "k int, v string, at string")
    assert dispatch_write(store, spec, twice, "CDC", as_of="2024-01-10") == 3
    assert got(store.read("t", ["k", "v"])) == [(1, "a"), (2, "y"), (3, "z")]
    dispatch_write(store, spec, twice.limit(0), "WINDOW", as_of="2024-01-10")
    assert got(store.read("t", ["k"])) == [(1,)] and store.version("t") == 3
    with pytest.raises(ValueError, match="unknown mode"):
        dispatch_write(store, spec, df, "UPSERT", as_of="2024-01-10")


def test_scans(spark):
    folder = new_folder(spark, "raw")
    assert files.scan_mixed_folder(spark, folder, "clean") is None and files.scan_multi_source(spark, {"clean": folder}) is None
    table(spark, [("1", 'a "q"\nb')], "id string, note string").write.options(header=True, escape='"').csv(folder)
    table(spark, [(2, True)], "id int, flag boolean").write.mode("append").parquet(folder)
    found = files.scan_multi_source(spark, {"clean": folder, "dirty": folder + "-none"})
    assert {(r.id, r.note, r.flag, r._source) for r in found.collect()} == {("1", 'a "q"\nb', None, "clean"), ("2", None, "true", "clean")}


def test_detectors(spark):
    df = table(spark, [(1, "north"), (2, "north"), (3, "nort"), (4, "North"), (5, None)], "k int, v string")
    assert got(dq.truncated(df, "k", "v", 3, 2)) == [(3, "nort", "north")]
    assert got(dq.case_variants(df, "v")) == [("north", 2, "north")]
    assert [r.k for r in dq.near_duplicates(df, "k", ["v"]).collect()] == [2]
    assert [r.k for r in dq.orphans(df, table(spark, [("north",)], "v string"), "v", "v").orderBy("k").collect()] == [3, 4]


def test_fact_without_inputs(spark):
    claims = table(spark, [(1, 1, 0.0, "2024-01-01", None, "paid")], "claim_id int, encounter_id int, total_charge double, submission_date string, adjudication_date string, claim_status string")
    r = star.fact_claims(claims).first()
    assert r.collection_rate is None and r.is_paid and r.total_paid is None and r.line_count is None


def test_monitor_on_empty_audit(spark):
    audit = table(spark, [], monitor.AUDIT)
    assert monitor.dq_report(audit, "2024-01-01 00:00:00").count() == 0 and monitor.run_summary(audit).count() == 0


def test_pipeline_incremental(spark):
    spec = TableSpec("e", "id", "at", casts={"n": "int"})
    p = Pipeline(spark, new_folder(spark, "layers"), "2024-01-31")
    df = table(spark, [("1", "5", "2024-01-01 00:00:00"), ("2", "6", "2024-01-02 00:00:00")], "id string, n string, at string")
    p.run_layers({spec: df}, [])
    late = df.union(table(spark, [("3", "x", "2024-01-03 00:00:00")], df.schema))
    done = p.run_layers({spec: late}, [], "INCREMENTAL", {"silver": "CDC"})
    assert [d["output_rows"] for d in done] == [1, 3] and p.watermark("bronze", "e").startswith("2024-01-03")
    assert p.run_layers({spec: df}, [], dry_run=True) == [{"layer": "bronze", "table": "e", "mode": "FULL"}, {"layer": "silver", "table": "e", "mode": "FULL"}]
    with pytest.raises(ValueError, match="unknown modes"):
        p.run_layers({spec: df}, [], "NIGHTLY")


def test_near_duplicates_group_without_a_window(spark):
    """A group of copies is aggregated, not sorted whole in one task; equal keys are no copies of each other."""
    df = spark.createDataFrame([(1, "x"), (1, "x"), (3, "x"), (2, None), (5, None), (4, ""), (6, "y"), (None, "x")], "k long, v string")
    found = dq.near_duplicates(df, "k", ["v"])
    assert sorted((r.k, r.v, r.original) for r in found.collect()) == [(3, "x", 1), (5, None, 2)]
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_text_count_under_any_source(spark, tmp_path):
    rows_ = [(1, "a", "en", "src1", 1), (2, "a", "de", "src2", 1), (3, "a", "en", "src1", 1), (4, None, "en", "src1", 0), (5, None, "fr", None, 0), (6, "b", "en", "src1", 1), (7, "", "en", "src1", 0)]
    spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    assert got(QUERIES["dq09_near_duplicate"](spark, str(tmp_path))) == [(2, 1), (3, 1), (5, 4)]
    assert_same(QUERIES["dq09_near_duplicate"](spark, str(tmp_path)), duck(str(tmp_path)), SQL["dq09_near_duplicate"])


def test_append_leaves_a_snapshot_that_is_read_as_it_was(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.append("t", spark.createDataFrame([(1, "a")], "k int, p string"), ("p",))
    before = store.read("t")
    assert store.append("t", spark.createDataFrame([(2, "b"), (3, "b")], "k int, p string"), ("p",)) == 2
    assert [*before.columns] == ["k", "p"] and before.count() == 1
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "a"), (2, "b"), (3, "b")]
    store.write("t", spark.createDataFrame([(4, "c")], "k int, p string"), ("p",))
    assert [tuple(r) for r in store.read("t").collect()] == [(4, "c")] and store.versions("t") == [3]


def test_fdc_keeps_columns_of_either_side_and_null_hashes(spark):
    old = spark.createDataFrame([(1, "a", None, 5), (2, "b", "y", 6), (3, "c", "z", 7)], "k int, v string, _row_hash string, only_old int")
    new = spark.createDataFrame([(1, "A", "x", 1.5), (2, "B", "y", 2.5), (4, "D", None, 4.5)], "k int, v string, _row_hash string, only_new double")
    found = {r.k: (r.v, r.only_old, r.only_new, r._is_deleted) for r in merge.fdc_merge(old, new, ["k"]).collect()}
    assert found == {1: ("A", 5, 1.5, False), 2: ("b", 6, None, False), 3: ("c", 7, None, True), 4: ("D", None, 4.5, False)}
    assert {tuple(r) for r in merge.fdc_classes(old, new, ["k"]).collect()} == {(1, "U"), (2, "N"), (3, "D"), (4, "I")}
