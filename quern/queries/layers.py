"""All gold tables, built from the stand-ins through bronze and silver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.adapters import Lake
from quern.operators.rows import safe_union
from quern.plans.gold import GOLD
from quern.plans.jobs import LAYERS, Pipeline
from quern.queries import gold  # noqa: F401  registers the SQL of the single tables
from quern.queries.base import SQL, query
from quern.schema import TableSpec
from quern.sources.scratch import new_folder

DAY = "2001-08-31"
MONEY = dict.fromkeys(("billed_amount", "allowed_amount", "paid_amount", "adjustment_amount", "patient_responsibility"), "decimal(18,6)")
SPECS = (
    TableSpec("patients", "patient_id", casts={"balance": "decimal(12,2)", "age": "int"}),
    TableSpec("patient_insurance", "row_id", casts={"effective_date": "date"}),
    TableSpec("providers", "provider_id", casts={"balance": "decimal(12,2)"}),
    TableSpec("clinics", "clinic_id", casts={"bed_count": "int"}),
    TableSpec("payers", "payer_id"),
    TableSpec("procedures", "cpt_code", casts={"charge": "decimal(12,2)"}),
    TableSpec("encounters", "encounter_id", casts={"encounter_date": "date"}),
    TableSpec("claims", "claim_id", "submission_date", casts={"total_charge": "decimal(12,2)", "submission_date": "date", "adjudication_date": "date"}),
    TableSpec("claim_lines", "row_id", casts=MONEY | {"service_date": "date"}),
    TableSpec("payments", "row_id", casts={"paid_amount": "decimal(18,6)", "payment_date": "date"}),
    TableSpec("denials", "row_id", casts={"denial_date": "date"}),
    TableSpec("diagnoses", "row_id", casts={"chronic_flag": "boolean"}),
    TableSpec("appointments", "appointment_id", casts={"appointment_date": "date", "duration_minutes": "int"}),
    TableSpec("labs", "lab_id", casts={"result_value": "double", "result_date": "date"}),
)


def sources(lake: Lake) -> dict[TableSpec, DataFrame]:
    """The stand-ins by specification; a table without a key of one column gets one, as its rows repeat."""
    numbered = lambda df: df.withColumn("row_id", F.monotonically_increasing_id())
    return {spec: numbered(df) if spec.key == "row_id" else df for spec in SPECS for df in (getattr(lake, spec.name),)}


def built(lake: Lake, keep: tuple[str, ...] = LAYERS) -> Pipeline:
    p = Pipeline(lake.spark, new_folder(lake.spark, "layers"), DAY)
    p.run_layers(sources(lake), [name for name, _, _ in GOLD], keep=keep)
    return p


@query("build_gold_layer", " union all ".join(f"select '{name}' as table_name, count(*) as n from ({SQL[name]})" for name, _, _ in GOLD))
def build_gold_layer(lake: Lake) -> DataFrame:
    store = built(lake, keep=("gold",)).stores["gold"]
    return safe_union([store.read(name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n")).select("table_name", "n") for name, _, _ in GOLD])
