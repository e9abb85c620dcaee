"""Star schema: dimensions and the claim fact. Builders take DataFrames, so any source can feed them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import round2
from quern.operators.rows import drop_meta, latest


def dim_patients(patients: DataFrame, insurance: DataFrame | None = None) -> DataFrame:
    """Patients with the payer and plan of their primary insurance, the earliest one if there are several."""
    base = drop_meta(patients)
    if insurance is None:
        return base.withColumns({"payer_id": F.lit(None).cast("int"), "plan_name": F.lit(None).cast("string")})
    primary = latest(insurance.where(F.upper("insurance_priority") == "PRIMARY"), ["patient_id"], [F.asc("effective_date"), F.asc("payer_id")])
    return base.join(primary.select("patient_id", "payer_id", "plan_name"), "patient_id", "left")


def dim_providers(providers: DataFrame, clinics: DataFrame) -> DataFrame:
    return drop_meta(providers).join(clinics.select("clinic_id", "clinic_name", "clinic_type"), "clinic_id", "left")


def dim_plain(df: DataFrame, key: str) -> DataFrame:
    """A dimension as it is, without technical columns, one row for each key."""
    return latest(drop_meta(df), [key], [F.col(c) for c in drop_meta(df).columns if c != key])


LINES = {"billed_amount": "total_billed", "allowed_amount": "total_allowed", "paid_amount": "total_paid", "patient_responsibility": "total_patient_resp"}
VISIT = {"encounter_date": "date", "place_of_service_code": "string", "encounter_type": "string"}


def fact_claims(claims: DataFrame, lines: DataFrame | None = None, payments: DataFrame | None = None, encounters: DataFrame | None = None) -> DataFrame:
    """One row for each claim. Lines and payments are summed before the join, so no claim row is multiplied.

    total_paid is what the lines say, payment_received what came in. A missing input leaves typed nulls. collection_rate,
    in percent, is null without a payment and unless the charge is above 0.
    """
    out = drop_meta(claims)
    columns = out.columns
    # encounters first: what is joined by claim stays dealt by claim then, and sums are not shuffled again
    if encounters is not None:
        out = out.join(encounters.select("encounter_id", *VISIT), "encounter_id", "left")
        columns = ["encounter_id", *(c for c in columns if c != "encounter_id")]
    else:
        out = out.withColumns({name: F.lit(None).cast(kind) for name, kind in VISIT.items()})
    if lines is not None:
        out = out.join(lines.groupBy("claim_id").agg(*(F.sum(c).alias(name) for c, name in LINES.items()), F.count("*").alias("line_count")), "claim_id", "left")
    else:
        out = out.withColumns({name: F.lit(None).cast("decimal(38,6)") for name in LINES.values()} | {"line_count": F.lit(None).cast("long")})
    if payments is not None:
        out = out.join(payments.groupBy("claim_id").agg(F.sum("paid_amount").alias("payment_received"), F.max("payment_date").alias("last_payment_date")), "claim_id", "left")
    else:
        out = out.withColumns({"payment_received": F.lit(None).cast("decimal(38,6)"), "last_payment_date": F.lit(None).cast("date")})
    if payments is not None or (lines is not None and encounters is None):
        columns = ["claim_id", *(c for c in columns if c != "claim_id")]
    out = out.select(*columns, *LINES.values(), "line_count", *VISIT, "payment_received", "last_payment_date")
    charge, received = F.col("total_charge").cast("double"), F.col("payment_received").cast("double")
    return out.withColumns({
        "days_to_adjudication": F.datediff("adjudication_date", "submission_date"),
        "is_paid": F.upper("claim_status") == "PAID",
        "is_denied": F.upper("claim_status") == "DENIED",
        "collection_rate": F.when(charge > 0, round2(received / charge * 100)),
    })
