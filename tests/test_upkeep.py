"""Gold tables after a batch equal their full rebuild, and only touched groups are computed."""

import json

import pytest
from pyspark.sql import functions as F

from quern.adapters import Lake
from quern.operators.rows import drop_meta
from quern.plans import upkeep
from quern.plans.gold import GOLD, OPTIONAL
from quern.plans.jobs import KPIS, Pipeline
from quern.queries import layers
from quern.sources.scratch import new_folder
from tests.compare import SMALL

NAMES = [name for name, _, _ in GOLD]


def rows(p, name):
    df = drop_meta(p.stores["gold"].read(name))
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def silver(p, frames):
    for spec, df in frames.items():
        p.stores["silver"].write(spec.name, df)


@pytest.fixture(scope="module")
def lake(spark):
    return Lake(spark, SMALL)


def test_every_gold_table_after_a_batch(spark, lake):
    """New, changed and deleted rows of every input, nulls in group columns among them."""
    frames = layers.sources(lake)
    frames = {s: spark.createDataFrame(df.toArrow()) for s, df in frames.items()}
    p = Pipeline(spark, new_folder(spark, "layers"), layers.DAY)
    silver(p, frames)
    for name in NAMES:
        assert p.process_gold_table(name, "INCREMENTAL")["mode"] == "FULL"  # nothing to keep up yet
    first = {name: rows(p, name) for name in NAMES}
    change = {
        "claims": lambda df: df.where("claim_id % 97 <> 3").withColumn("claim_status", F.when(F.col("claim_id") % 89 == 1, "PAID").otherwise(F.col("claim_status"))).withColumn("payer_id", F.when(F.col("claim_id") % 211 == 5, F.lit(None)).otherwise(F.col("payer_id"))),
        "claim_lines": lambda df: df.where("claim_id % 101 <> 7"),
        "payments": lambda df: df.withColumn("paid_amount", F.when(F.col("claim_id") % 113 == 2, F.col("paid_amount") + 1).otherwise(F.col("paid_amount"))),
        "encounters": lambda df: df.withColumn("encounter_type", F.when(F.col("encounter_id") % 127 == 0, "other").otherwise(F.col("encounter_type"))),
        "denials": lambda df: df.where("claim_id % 31 <> 1"),
        "diagnoses": lambda df: df.withColumn("icd10_code", F.when(F.col("row_id") % 53 == 0, F.lit(None)).otherwise(F.col("icd10_code"))),
        "appointments": lambda df: df.where("appointment_id % 67 <> 2"),
        "labs": lambda df: df.withColumn("test_name", F.when(F.col("lab_id") % 71 == 0, F.lit(None)).otherwise(F.col("test_name"))),
        "patients": lambda df: df.where("patient_id % 41 <> 1"),
        "providers": lambda df: df.withColumn("specialty", F.when(F.col("provider_id") == 1, "new").otherwise(F.col("specialty"))),
        "clinics": lambda df: df.withColumn("clinic_type", F.when(F.col("clinic_id") == 1, "new").otherwise(F.col("clinic_type"))),
        "payers": lambda df: df.withColumn("payer_name", F.when(F.col("payer_id") == 1, "new").otherwise(F.col("payer_name"))),
    }
    new = {s: change.get(s.name, lambda df: df)(df) for s, df in frames.items()}
    silver(p, new)
    kept = {name: p.process_gold_table(name, "CDC") for name in NAMES}
    full = Pipeline(spark, new_folder(spark, "layers"), layers.DAY)
    silver(full, new)
    for name in NAMES:
        full.process_gold_table(name)
        assert kept[name]["mode"] == "CDC" and kept[name]["status"] == "OK"
        assert rows(p, name) == rows(full, name), name
    assert sum(rows(p, name) != first[name] for name in NAMES) == len(NAMES)
    again = p.process_gold_table("kpi_revenue_summary", "WINDOW")
    assert again["status"] == "OK" and rows(p, "kpi_revenue_summary") == rows(full, "kpi_revenue_summary")


def test_only_rows_of_touched_groups_reach_the_builder(spark, lake, monkeypatch):
    p = Pipeline(spark, new_folder(spark, "layers"), layers.DAY)
    p.stores["silver"].write("appointments", lake.appointments)
    p.process_gold_table("kpi_appointment_ops")
    one = lake.appointments.orderBy("appointment_id").limit(1).withColumn("appointment_id", F.lit(-1).cast("long"))
    p.stores["silver"].append("appointments", one)
    real, seen = KPIS["kpi_appointment_ops"], []
    monkeypatch.setitem(KPIS, "kpi_appointment_ops", type(real)(lambda df: seen.append(df.count()) or real.build(df), real.inputs, real.dated, real.optional, real.groups))
    p.process_gold_table("kpi_appointment_ops", "INCREMENTAL")
    group = one.select(F.year("appointment_date"), F.month("appointment_date"), "appointment_type").first()
    want = lake.appointments.where((F.year("appointment_date") == group[0]) & (F.month("appointment_date") == group[1]) & (F.col("appointment_type") == group[2])).count() + 1
    assert seen == [want] and want < lake.appointments.count() / 4


def test_ageing_is_built_anew_on_another_day(spark, lake):
    p = Pipeline(spark, new_folder(spark, "layers"), layers.DAY)
    for name in ("claims", "claim_lines", "payments", "encounters"):
        p.stores["silver"].write(name, getattr(lake, name))
    p.run_layers({}, ["fact_claims", "kpi_ar_aging"])
    assert [s["mode"] for s in p.run_layers({}, ["fact_claims", "kpi_ar_aging"], "CDC", layers=("gold",), dry_run=True)] == ["CDC", "CDC"]
    p.as_of = "2002-01-01"
    assert p.process_gold_table("kpi_ar_aging", "CDC")["mode"] == "FULL"
    assert json.loads(p.stores["gold"].note("kpi_ar_aging", "INPUTS"))["as_of"] == "2002-01-01"


def test_optional_inputs(spark, lake):
    p = Pipeline(spark, new_folder(spark, "layers"), layers.DAY)
    p.stores["silver"].write("claims", lake.claims)
    p.stores["silver"].write("denials", lake.denials)
    done = {d["table"]: d["status"] for d in p.run_layers({}, NAMES, layers=("gold",))}
    assert {k for k, v in done.items() if v == "OK"} == {"fact_claims", "kpi_revenue_summary", "kpi_denial_analysis", "kpi_ar_aging", "kpi_provider_scorecard"}
    fact = p.stores["gold"].read("fact_claims")
    assert fact.count() == lake.claims.count() and fact.where("total_billed is not null or last_payment_date is not null or encounter_type is not null").count() == 0
    p.stores["silver"].write("payments", lake.payments)  # an input more: built in full, with the payments
    assert p.process_gold_table("fact_claims", "CDC")["mode"] == "FULL" and p.stores["gold"].read("fact_claims").where("payment_received is not null").count() > 0
    assert {*OPTIONAL} <= {*NAMES}


def test_net_changes_count_rows(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "d"), (None, "n")], "k int, v string")
    found = upkeep.net_changes(old.withColumn("_at", F.lit(1)), new.withColumn("_at", F.lit(2)))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted([(1, "a"), (3, "c"), (3, "d"), (None, "n")], key=repr)
    assert upkeep.net_changes(old, old).count() == 0
