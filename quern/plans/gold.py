"""The gold layer: dimensions, the fact and the KPIs as tables that a Pipeline builds, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.rows import share_of_total
from quern.plans import kpi, star
from quern.plans.jobs import KPIS, register_kpi
from quern.plans.upkeep import Groups

GOLD = (
    ("dim_patients", star.dim_patients, ("patients", "patient_insurance")),
    ("dim_providers", star.dim_providers, ("providers", "clinics")),
    ("dim_clinics", lambda df: star.dim_plain(df, "clinic_id"), ("clinics",)),
    ("dim_payers", lambda df: star.dim_plain(df, "payer_id"), ("payers",)),
    ("fact_claims", star.fact_claims, ("claims", "claim_lines", "payments", "encounters")),
    ("kpi_revenue_summary", kpi.revenue_summary, ("fact_claims",)),
    ("kpi_denial_analysis", kpi.denial_analysis, ("denials", "claims")),
    ("kpi_ar_aging", kpi.ar_aging, ("fact_claims",)),
    ("kpi_provider_scorecard", kpi.provider_scorecard, ("fact_claims", "providers")),
    ("kpi_payer_mix", kpi.payer_mix, ("fact_claims", "payers")),
    ("kpi_procedure_revenue", kpi.procedure_revenue, ("claim_lines", "procedures")),
    ("kpi_diagnosis_burden", kpi.diagnosis_burden, ("diagnoses",)),
    ("kpi_appointment_ops", kpi.appointment_ops, ("appointments",)),
    ("kpi_patient_risk", kpi.patient_risk, ("patients", "diagnoses")),
    ("kpi_lab_abnormals", kpi.lab_abnormals, ("labs",)),
)
DATED = ("kpi_ar_aging",)
OPTIONAL = {"dim_patients": ("patient_insurance",), "fact_claims": ("claim_lines", "payments", "encounters"), "kpi_denial_analysis": ("claims",), "kpi_provider_scorecard": ("providers",)}
"""Inputs that a table can do without; its columns from them are null then."""


def _through(other: str, key: str, columns: dict[str, str]):
    """Groups of changed rows of one input, found by a key in another."""

    def find(changed: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
        rows = inputs[other].join(changed.select(key).distinct(), key, "left_semi")
        return rows.select(*(F.expr(e).alias(c) for c, e in columns.items()))

    return find


_DENIAL = {"denial_code": "upper(denial_code)", "denial_category": "denial_category", "denial_reason": "denial_reason"}
_MONTH = lambda day: (f"year({day})", f"month({day})")
UPKEEP = {
    "dim_patients": Groups(("patient_id",), {"patients": ("patient_id",), "patient_insurance": ("patient_id",)}),
    "dim_providers": Groups(("provider_id",), {"providers": ("provider_id",)}, {"clinics": _through("providers", "clinic_id", {"provider_id": "provider_id"})}),
    "dim_clinics": Groups(("clinic_id",), {"clinics": ("clinic_id",)}),
    "dim_payers": Groups(("payer_id",), {"payers": ("payer_id",)}),
    "fact_claims": Groups(("claim_id",), {i: ("claim_id",) for i in ("claims", "claim_lines", "payments")}, {"encounters": _through("claims", "encounter_id", {"claim_id": "claim_id"})}),
    "kpi_revenue_summary": Groups(("year", "month"), {"fact_claims": _MONTH("submission_date")}),
    "kpi_denial_analysis": Groups(tuple(_DENIAL), {"denials": tuple(_DENIAL.values())}, {"claims": _through("denials", "claim_id", _DENIAL)}),
    "kpi_ar_aging": Groups(("payer_id",), {"fact_claims": ("payer_id",)}),
    "kpi_provider_scorecard": Groups(("provider_id",), {"fact_claims": ("provider_id",), "providers": ("provider_id",)}),
    "kpi_payer_mix": Groups(("payer_id",), {"fact_claims": ("payer_id",), "payers": ("payer_id",)}, finish=lambda df: share_of_total(df.drop("revenue_share_pct"), "paid", "revenue_share_pct")),
    "kpi_procedure_revenue": Groups(("cpt_code",), {"claim_lines": ("cpt_code",), "procedures": ("cpt_code",)}),
    "kpi_diagnosis_burden": Groups(("icd10_code", "diagnosis_description", "chronic_flag"), {"diagnoses": ("icd10_code", "diagnosis_description", "chronic_flag")}),
    "kpi_appointment_ops": Groups(("year", "month", "appointment_type"), {"appointments": (*_MONTH("appointment_date"), "appointment_type")}),
    "kpi_patient_risk": Groups(("patient_id",), {"patients": ("patient_id",), "diagnoses": ("patient_id",)}),
    "kpi_lab_abnormals": Groups(("test_name",), {"labs": ("test_name",)}),
}

for name, build, inputs in GOLD:
    if name not in KPIS:
        register_kpi(name, build, inputs, name in DATED, optional=OPTIONAL.get(name, ()), groups=UPKEEP[name])
