"""Table specifications: what a table's key, casts, casing and checks are. A table of any domain can be registered."""

from __future__ import annotations

from dataclasses import dataclass, field

# Patterns of well-formed codes.
PATTERNS = {
    "npi": r"^\d{10}$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "zip": r"^\d{5}$",
    "icd10": r"^[A-Z]\d{2}(\.\d+)?$",
    "phone": r"^\+?[\d\-\(\) ]{7,}$",
    "ssn4": r"^\d{4}$",
    "cpt": r"^\d{5}$",
}

MONEY = "decimal(18,2)"
"""The type of amounts: their sums are exact in any order."""

MODES = ("FULL", "INCREMENTAL", "WINDOW", "CDC", "SCD2", "FDC")


@dataclass(frozen=True)
class Rule:
    """One check on a column. kind: regex, range, negative, not_positive, less_than, after_today, or swapped (column, other).

    repair: what happens to a value that fails: null, swap, or nothing.
    """

    label: str
    kind: str
    column: str
    value: object = None
    high: object = None
    repair: str = ""


@dataclass(frozen=True, eq=False)
class TableSpec:
    """buckets: parts by a hash of the key, for merges of small batches; by_month: parts by the watermark's month, for windows."""

    name: str
    key: str
    watermark: str = ""
    mode: str = "FULL"
    window_days: int = 30
    initcap: tuple[str, ...] = ()
    upper: tuple[str, ...] = ()
    lower: tuple[str, ...] = ()
    casts: dict[str, str] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    tracked: tuple[str, ...] = ()
    partitions: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    buckets: int = 0
    by_month: bool = False

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}; one of {MODES}")
        if self.buckets and self.by_month:
            raise ValueError("a table has parts by bucket or by month")


TABLES: dict[str, TableSpec] = {}


def register_table(spec: TableSpec) -> TableSpec:
    if spec.name in TABLES:
        raise ValueError(f"{spec.name} is registered already")
    TABLES[spec.name] = spec
    return spec


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


def _casts(**kinds: str) -> dict[str, str]:
    return {c: MONEY if kind == "money" else kind for kind, columns in kinds.items() for c in columns.split()}


def negative(columns: str, repair: str = "null") -> tuple[Rule, ...]:
    return tuple(Rule(f"negative_{c}", "negative", c, repair=repair) for c in columns.split())


def swapped(start: str, end: str, label: str) -> Rule:
    return Rule(f"swapped_{label}", "swapped", start, end, repair="swap")


def well_formed(column: str, pattern: str) -> Rule:
    return Rule(f"invalid_{column}", "regex", column, PATTERNS[pattern])


def between(column: str, low: float, high: float, repair: str = "", label: str = "") -> Rule:
    return Rule(label or f"{column}_out_of_range", "range", column, low, high, repair)


# The tables of a medical billing lake.
for _spec in (
    TableSpec("clinics", "clinic_id", "created_at", initcap=_words("clinic_name address city state"), upper=_words("clinic_id npi tax_id"), casts=_casts(int="bed_count"), rules=(well_formed("npi", "npi"),)),
    TableSpec("providers", "provider_id", "created_at", "SCD2", initcap=_words("first_name last_name specialty"), upper=_words("provider_id npi"), lower=("email",), casts=_casts(int="years_experience", boolean="board_certified accepting_new_patients"), rules=(well_formed("npi", "npi"), *negative("years_experience", "")), tracked=_words("specialty clinic_id status")),
    TableSpec("payers", "payer_id", initcap=_words("payer_name payer_type"), upper=("payer_id",), casts=_casts(int="timely_filing_limit_days", boolean="supports_electronic_claims"), rules=negative("timely_filing_limit_days", "")),
    TableSpec("patients", "patient_id", "updated_at", "SCD2", initcap=_words("first_name last_name city state gender"), upper=("patient_id",), lower=("email",), casts=_casts(date="dob", int="age"), rules=(between("age", 0, 120, label="age_out_of_range"), Rule("future_dob", "after_today", "dob"), well_formed("email", "email"), well_formed("zip_code", "zip")), tracked=_words("address city state zip_code phone")),
    TableSpec("patient_insurance", "patient_insurance_id", "effective_date", "SCD2", upper=_words("patient_insurance_id patient_id payer_id plan_name plan_type member_id"), casts=_casts(date="effective_date termination_date", money="copay_office copay_specialist copay_er deductible_individual deductible_family deductible_met out_of_pocket_max out_of_pocket_met", boolean="requires_referral requires_prior_auth"), rules=(swapped("effective_date", "termination_date", "effective_termination"), *negative("copay_office copay_specialist copay_er deductible_individual deductible_family")), tracked=_words("payer_id plan_type termination_date")),
    TableSpec("appointments", "appointment_id", "appointment_date", "WINDOW", upper=_words("appointment_id patient_id provider_id clinic_id appointment_type appointment_status"), casts=_casts(date="appointment_date", int="duration_minutes"), rules=(between("duration_minutes", 5, 480, "null", "duration_out_of_range"),)),
    TableSpec("encounters", "encounter_id", "encounter_date", "CDC", upper=_words("encounter_id patient_id provider_id clinic_id encounter_type drg_code place_of_service_code"), casts=_casts(date="encounter_date admit_date discharge_date", int="los_days", money="drg_base_rate"), rules=(swapped("admit_date", "discharge_date", "admit_discharge"), *negative("los_days", ""))),
    TableSpec("vitals", "vital_id", "recorded_at", "INCREMENTAL", upper=_words("vital_id patient_id encounter_id"), casts=_casts(double="height_inches weight_lbs bmi systolic_bp diastolic_bp heart_rate respiratory_rate temperature_f oxygen_saturation pain_scale"), rules=(between("height_inches", 36, 96), between("weight_lbs", 50, 700), between("bmi", 10, 80), between("systolic_bp", 60, 250), between("diastolic_bp", 30, 150), between("heart_rate", 20, 250), between("temperature_f", 90, 110), between("oxygen_saturation", 50, 100), between("pain_scale", 0, 10))),
    TableSpec("diagnoses", "diagnosis_id", mode="CDC", initcap=("diagnosis_description",), upper=_words("diagnosis_id patient_id encounter_id icd10_code diagnosis_type"), casts=_casts(boolean="chronic_flag"), rules=(well_formed("icd10_code", "icd10"),)),
    TableSpec("procedures", "procedure_id", mode="CDC", upper=_words("procedure_id patient_id encounter_id provider_id cpt_code revenue_code"), casts=_casts(int="units", money="procedure_charge"), rules=(between("units", 1, 99), *negative("procedure_charge"))),
    TableSpec("lab_results", "lab_id", "result_date", "INCREMENTAL", upper=_words("lab_id patient_id encounter_id loinc_code abnormal_flag status"), casts=_casts(date="order_date result_date", double="result_value reference_range_low reference_range_high"), rules=(swapped("order_date", "result_date", "order_result_dates"),)),
    TableSpec("medications", "medication_id", "prescribed_date", "CDC", upper=_words("medication_id patient_id encounter_id prescriber_id ndc_code status"), casts=_casts(date="prescribed_date fill_date", int="quantity days_supply refills", boolean="prior_auth_required"), rules=(Rule("quantity_not_positive", "not_positive", "quantity"), swapped("prescribed_date", "fill_date", "prescribed_fill_dates"))),
    TableSpec("prior_authorizations", "auth_id", "request_date", "CDC", upper=_words("auth_id patient_id provider_id payer_id service_type status"), casts=_casts(date="request_date decision_date approved_from_date approved_to_date", int="approved_units"), rules=(swapped("request_date", "decision_date", "request_decision"), swapped("approved_from_date", "approved_to_date", "approved_dates"), *negative("approved_units", ""))),
    TableSpec("claims", "claim_id", "submission_date", "CDC", upper=_words("claim_id patient_id provider_id payer_id encounter_id claim_type claim_status rendering_provider_npi billing_provider_npi"), casts=_casts(date="submission_date adjudication_date", money="total_charge"), rules=(swapped("submission_date", "adjudication_date", "submission_adjudication"), *negative("total_charge"), well_formed("rendering_provider_npi", "npi"), well_formed("billing_provider_npi", "npi"))),
    TableSpec("claim_lines", "claim_line_id", "service_date", "CDC", upper=_words("claim_line_id claim_id cpt_code revenue_code modifier"), casts=_casts(date="service_date", int="units", money="billed_amount allowed_amount paid_amount patient_responsibility coinsurance_amount copay_amount deductible_amount adjustment_amount"), rules=(*negative("billed_amount allowed_amount paid_amount"), Rule("units_less_than_1", "less_than", "units", 1))),
    TableSpec("remittances", "remittance_id", "payment_date", "CDC", upper=_words("remittance_id payer_id payment_method eft_trace_number"), casts=_casts(date="payment_date", money="total_payment_amount", int="claim_count"), rules=negative("total_payment_amount")),
    TableSpec("payments", "payment_id", "payment_date", "CDC", upper=_words("payment_id claim_id remittance_id payment_source"), casts=_casts(date="payment_date posted_date", money="paid_amount"), rules=(*negative("paid_amount"), swapped("payment_date", "posted_date", "payment_posted"))),
    TableSpec("denials", "denial_id", "denial_date", "CDC", upper=_words("denial_id claim_id denial_code denial_category appeal_status"), casts=_casts(date="denial_date appeal_deadline", boolean="corrected_claim_submitted"), rules=(swapped("denial_date", "appeal_deadline", "denial_appeal_deadline"),)),
    TableSpec("appeals", "appeal_id", "submitted_date", "CDC", upper=_words("appeal_id denial_id claim_id patient_id appeal_type decision"), casts=_casts(date="submitted_date decision_date"), rules=(swapped("submitted_date", "decision_date", "submission_decision"),)),
    TableSpec("eligibility_checks", "eligibility_id", "check_date", "WINDOW", upper=_words("eligibility_id patient_id payer_id appointment_id response_status"), casts=_casts(date="check_date", money="copay_verified"), rules=negative("copay_verified")),
):
    register_table(_spec)
