"""The gold layer: statuses in any case, what is open, and tables built through the pipeline."""

import datetime
import itertools
import os

import pytest
from pyspark.sql import functions as F

from quern import adapters
from quern.adapters import Lake
from quern.operators import clean
from quern.operators.rows import drop_meta
from quern.plans import jobs, kpi, star
from quern.plans.gold import GOLD
from quern.queries import layers
from quern.queries.dashboard import STATUSES, normal_status
from quern.schema import Rule, TableSpec
from quern.sources import scratch
from quern.sources.files import input_bytes
from tests.compare import SMALL

D = datetime.date


def test_fact_keeps_lines_and_payments_apart(spark):
    claims = spark.createDataFrame([(1, 10, 100.0, D(2024, 1, 1), D(2024, 1, 5), "paid"), (2, 11, 0.0, D(2024, 1, 1), None, "Denied"), (3, 12, 50.0, D(2024, 1, 1), None, None)], "claim_id int, encounter_id int, total_charge double, submission_date date, adjudication_date date, claim_status string")
    lines = spark.createDataFrame([(1, 100.0, 80.0, 60.0, 20.0), (1, 10.0, 8.0, 6.0, 2.0)], "claim_id int, billed_amount double, allowed_amount double, paid_amount double, patient_responsibility double")
    payments = spark.createDataFrame([(1, 30.0, D(2024, 1, 9)), (1, 3.333, D(2024, 1, 8)), (2, 1.0, D(2024, 1, 9))], "claim_id int, paid_amount double, payment_date date")
    visits = spark.createDataFrame([(10, D(2023, 12, 31), "11", "office")], "encounter_id int, encounter_date date, place_of_service_code string, encounter_type string")
    found = {r.claim_id: r for r in star.fact_claims(claims, lines, payments, visits).collect()}
    one, two, three = found[1], found[2], found[3]
    assert (one.total_billed, one.total_allowed, one.total_paid, one.total_patient_resp, one.line_count, one.payment_received, one.collection_rate) == (110.0, 88.0, 66.0, 22.0, 2, 33.333, 33.33)
    assert (one.encounter_type, one.days_to_adjudication, one.is_paid, one.is_denied, one.last_payment_date) == ("office", 4, True, False, D(2024, 1, 9))
    assert (two.collection_rate, two.is_denied, two.payment_received, three.collection_rate, three.payment_received, three.encounter_date) == (None, True, 1.0, None, None, None)


def test_statuses_count_in_any_case(spark):
    labs = spark.createDataFrame([("t", "l", f, 1.0) for f in ("Normal", "NORMAL", "normal", "High", "HIGH", None)], "test_name string, loinc_code string, abnormal_flag string, result_value double")
    assert {(r.abnormal_flag, r.share_of_abnormal, r.all_tests) for r in kpi.lab_abnormals(labs).collect()} == {("High", 50.0, 6), ("HIGH", 50.0, 6)}
    visits = spark.createDataFrame([(D(2024, 1, 1), "x", s, 10) for s in ("Completed", "COMPLETED", "no show", "Cancelled")], "appointment_date date, appointment_type string, appointment_status string, duration_minutes int")
    r = kpi.appointment_ops(visits).first()
    assert (r.completed, r.no_show, r.cancelled, r.completion_pct) == (2, 1, 1, 50.0)
    denials = spark.createDataFrame([(1, "co-1", "c", "r", s) for s in ("Approved", "APPROVED", "denied", None)], "claim_id int, denial_code string, denial_category string, denial_reason string, appeal_status string")
    r = kpi.denial_analysis(denials, spark.createDataFrame([(1, 5.0)], "claim_id int, total_charge double")).first()
    assert (r.appeal_count, r.overturn_pct) == (3, 66.67)
    diagnoses = spark.createDataFrame([(1, 7, "Primary"), (1, 7, "PRIMARY"), (2, 8, "secondary")], "patient_id int, encounter_id int, diagnosis_type string").withColumns({"icd10_code": F.lit("a"), "diagnosis_description": F.lit("b"), "chronic_flag": F.lit(True)})
    r = kpi.diagnosis_burden(diagnoses).first()
    assert (r.patients, r.encounters, r.primary_count, r.encounters_per_patient) == (2, 3, 2, 1.5)


def test_denied_claims_are_open(spark):
    rows = [(s, 7, 10.0, D(2024, 1, 1)) for s in ("denied", "Pending", "PAID", "void", "Adjusted", "REJECTED")]
    fact = spark.createDataFrame(rows, "claim_status string, payer_id int, total_charge double, submission_date date")
    r = kpi.ar_aging(fact, "2024-01-31").collect()
    assert [(x.claim_count, x.outstanding) for x in r] == [(3, 30.0)]


def test_seven_statuses(spark):
    texts = [" paid in full", "DENIED", "pending review", "Rejected", "appealed", "VOIDED", "adjusted", "Denied, appealed", " other ", "unpaid"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(normal_status(F.col("s"))).collect()]
    assert found == [*STATUSES, "Denied", "Other", "Unpaid"]


def test_gold_layer_through_the_pipeline(spark):
    """Tables built from text in bronze and casts in silver hold what the builders make of the stand-ins directly."""
    lake = Lake(spark, SMALL)
    p = layers.built(lake)
    assert {r.status for r in p.audit().collect()} == {"OK"} and p.audit().count() == 2 * len(layers.SPECS) + len(GOLD)
    fact = star.fact_claims(lake.claims, lake.claim_lines, lake.payments, lake.encounters)
    for name, direct, keys in (("kpi_revenue_summary", kpi.revenue_summary(fact), ("year", "month")), ("kpi_ar_aging", kpi.ar_aging(fact, layers.DAY), ("aging_bucket", "payer_id")), ("kpi_patient_risk", kpi.patient_risk(lake.patients, lake.diagnoses), ("patient_id",)), ("kpi_payer_mix", kpi.payer_mix(fact, lake.payers), ("payer_id",))):
        rows = p.stores["gold"].read(name)
        of = lambda df: {tuple(str(r[k]) for k in keys): r for r in df.collect()}  # noqa: E731, B023
        got, want = of(rows), of(direct)
        assert got.keys() == want.keys() and len(want) > 0
        for k, r in want.items():
            for c in direct.columns:
                x, y = r[c], got[k][c]
                assert abs(float(x) - float(y)) < 0.011 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) == str(y), (name, k, c)


def test_tables_that_read_each_other_are_made_in_turn(spark):
    levels = jobs._levels([name for name, _, _ in GOLD])
    assert {x for x, n in levels.items() if n == 1} == {"kpi_revenue_summary", "kpi_ar_aging", "kpi_provider_scorecard", "kpi_payer_mix"} and {*levels.values()} == {0, 1}
    assert jobs._levels(["kpi_ar_aging", "fact_claims", "kpi_payer_mix"]) == {"kpi_ar_aging": 0, "fact_claims": 1, "kpi_payer_mix": 2}


def test_silver_shuffles_only_rows_of_repeated_keys(spark):
    """The rows are those of the plain way, whatever case, space or null the keys have."""
    spec = TableSpec("t", "id", "day", upper=("id",), casts={"n": "decimal(12,2)", "day": "date"}, rules=(Rule("negative_n", "negative", "n", repair="null"),))
    data = [("a", "1", "2024-01-01"), (" A ", "2", "2024-01-02"), ("b", "-3", None), ("b", "-3", None), ("c", "x", "2024-01-01"), (None, "5", None), ("null", "6", None), ("", "7", None), ("nullable", "8", None), ("d", None, "2024-02-30")]
    df = spark.createDataFrame(data, "id string, n string, day string")
    repeated = clean.repeated_keys(df, spec)
    assert repeated.count() == 2
    rows = lambda found: sorted(map(repr, found.collect()))
    made = clean.clean_table(df, spec, repeated=repeated)
    assert rows(made) == rows(clean.clean_table(df, spec)) and {r.id for r in made.collect()} == {"A", "B", "C", "D", "NULLABLE"} and made.count() == 5
    assert rows(clean.clean_table(df, spec, repeated=repeated.limit(0))) != rows(made)  # other rows are not looked at
    swapping = TableSpec("t", "id", rules=(Rule("s", "swapped", "id", "n", repair="swap"),))
    assert rows(clean.clean_table(df, swapping, repeated=clean.repeated_keys(df, swapping))) == rows(clean.clean_table(df, swapping))


def test_diagnoses_are_dealt_to_parts_by_the_size_of_the_input(spark, monkeypatch):
    lake = Lake(spark, SMALL)
    rows = lambda: sorted(map(repr, kpi.diagnosis_burden(lake.diagnoses).collect()))
    want = rows()
    size = input_bytes(lake.lineitem)
    assert size == os.path.getsize(f"{SMALL}/lineitem.parquet") and input_bytes(spark.range(3)) == 0
    monkeypatch.setattr(adapters, "NO_BROADCAST", 0)
    for share in (7, 21):
        monkeypatch.setattr(adapters, "PART_BYTES", size / share)
        monkeypatch.setattr(kpi, "PART_BYTES", input_bytes(lake.diagnoses) / share)
        plan = kpi.diagnosis_burden(lake.diagnoses)._jdf.queryExecution().executedPlan().toString()
        assert plan.count(f", {share}), REPARTITION_BY_NUM") == 3
        assert rows() == want and len(want) > 100


def test_layers_that_nothing_reads_any_more_are_deleted(spark, monkeypatch):
    """build_gold_layer holds the tables of bronze and silver that are still read, and what it returns is that of kept layers."""
    lake, make, seen = Lake(spark, SMALL), layers.built, []
    monkeypatch.setattr(layers, "built", lambda lake, **keep: seen.append(make(lake, **keep)) or seen[-1])
    found = sorted(map(tuple, layers.build_gold_layer(lake).collect()))
    some, kept = seen[0], make(lake)
    root = some.stores["gold"].root.removesuffix("/gold").removeprefix("file:")
    assert not [f for layer in ("bronze", "silver") for _, _, files in os.walk(f"{root}/{layer}") for f in files]
    assert {f for _, _, files in os.walk(f"{root}/gold") for f in files if f.endswith(".parquet")} and not [f for _, _, files in os.walk(root) for f in files if f.endswith(".snappy.parquet")]
    assert all(kept.stores[layer].version(spec.name) == 1 for layer in ("bronze", "silver") for spec in layers.SPECS)
    assert found == sorted((name, kept.stores["gold"].read(name).count()) for name, _, _ in GOLD)
    for name, _, _ in GOLD:
        rows = lambda p: sorted(repr(r) for r in drop_meta(p.stores["gold"].read(name)).collect())  # noqa: E731, B023
        assert rows(some) == rows(kept), name
    of = lambda p: sorted(p.audit().drop("logged_at").collect(), key=repr)
    assert of(some) == of(kept)
    with pytest.raises(ValueError, match="in full"):
        some.run_layers(layers.sources(lake), [], "CDC", keep=("gold",))


def test_tables_of_a_later_layer_stay_until_their_last_reader(spark, monkeypatch):
    lake, dropped = Lake(spark, SMALL), []
    p = jobs.Pipeline(spark, scratch.new_folder(spark, "layers"), layers.DAY)
    for layer in ("bronze", "silver"):
        monkeypatch.setattr(p.stores[layer], "drop", lambda name, layer=layer: dropped.append((layer, name, sorted(x for x, _, _ in GOLD if p.stores["gold"].version(x)))))
    took = {s: df for s, df in layers.sources(lake).items() if s.name in ("patients", "diagnoses", "patient_insurance", "payers")}
    done = p.run_layers(took, ["dim_patients", "kpi_diagnosis_burden", "kpi_patient_risk"], keep=("gold",))
    assert [d["table"] for d in done[:4]] == [s.name for s in took] and [d["layer"] for d in done] == ["bronze"] * 4 + ["silver"] * 4 + ["gold"] * 3
    assert sorted(x[:2] for x in dropped) == sorted((layer, s.name) for layer in ("bronze", "silver") for s in took)
    readers = {name: set(gold) for layer, name, gold in dropped if layer == "silver"}
    assert readers["diagnoses"] >= {"kpi_diagnosis_burden", "kpi_patient_risk"} and readers["patients"] >= {"dim_patients", "kpi_patient_risk"} and readers["patient_insurance"] >= {"dim_patients"}


def test_a_run_of_layers_ends_at_its_first_error_and_leaves_the_session_as_it_was(spark, monkeypatch):
    lake, before = Lake(spark, SMALL), spark.conf.get(scratch.SHUFFLES, "false")
    p, seen = jobs.Pipeline(spark, scratch.new_folder(spark, "layers"), layers.DAY), []

    def fails(spec, source, mode):
        seen.append(spark.conf.get(scratch.SHUFFLES))
        raise KeyError(spec.name)

    monkeypatch.setattr(p, "ingest_table", fails)
    with pytest.raises(KeyError):
        p.run_layers(layers.sources(lake), [name for name, _, _ in GOLD])
    assert {*seen} == {"true"} and spark.conf.get(scratch.SHUFFLES, "false") == before and p.stores["gold"].version("dim_clinics") is None


def test_fact_shuffles_sums_once(spark):
    lake = Lake(spark, SMALL)
    tables = (lake.claims, lake.claim_lines, lake.payments, lake.encounters)
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        plan = star.fact_claims(*tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 5
    ends = [*star.LINES.values(), "line_count", *star.VISIT, "payment_received", "last_payment_date", "days_to_adjudication", "is_paid", "is_denied", "collection_rate"]
    for lines, payments, encounters in itertools.product((0, 1), repeat=3):
        first = ["claim_id", "encounter_id"][:: 1 if payments else -1] if encounters else ["claim_id"]
        made = star.fact_claims(tables[0], *(t if use else None for t, use in zip(tables[1:], (lines, payments, encounters), strict=True)))
        assert made.columns == [*first, *(c for c in tables[0].columns if c not in first), *ends]
