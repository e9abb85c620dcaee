"""Star schema and KPI queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.adapters import AS_OF, Lake
from quern.plans import kpi, star
from quern.queries.base import dsum, pct, query, r2

FACT = f"""fact as (
  select c.*, l.total_billed, l.total_allowed, l.total_paid, l.total_patient_resp, l.line_count, e.encounter_date, e.place_of_service_code, e.encounter_type, p.payment_received, p.last_payment_date, adjudication_date - submission_date as days_to_adjudication,
    upper(claim_status) = 'PAID' as is_paid, upper(claim_status) = 'DENIED' as is_denied,
    case when total_charge > 0 then {r2('cast(p.payment_received as double) / cast(total_charge as double) * 100')} end as collection_rate
  from claims c left join (select claim_id, sum(billed_amount) as total_billed, sum(allowed_amount) as total_allowed, sum(paid_amount) as total_paid, sum(patient_responsibility) as total_patient_resp, count(*) as line_count from claim_lines group by claim_id) l on l.claim_id = c.claim_id
  left join (select claim_id, sum(paid_amount) as payment_received, max(payment_date) as last_payment_date from payments group by claim_id) p on p.claim_id = c.claim_id
  left join encounters e on e.encounter_id = c.encounter_id
)"""
DENIED = "sum(case when is_denied then 1 else 0 end)"
PAID = "sum(case when is_paid then 1 else 0 end)"


def fact(lake: Lake) -> DataFrame:
    return star.fact_claims(lake.claims, lake.claim_lines, lake.payments, lake.encounters)


@query("dim_patients", """select p.*, i.payer_id, i.plan_name from patients p left join (select patient_id, payer_id, plan_name, row_number() over (partition by patient_id order by effective_date, payer_id) as n
  from patient_insurance where upper(insurance_priority) = 'PRIMARY') i on i.patient_id = p.patient_id and i.n = 1""")
def dim_patients(lake: Lake) -> DataFrame:
    return star.dim_patients(lake.patients, lake.patient_insurance)


@query("dim_providers", "select p.*, c.clinic_name, c.clinic_type from providers p left join clinics c on c.clinic_id = p.clinic_id")
def dim_providers(lake: Lake) -> DataFrame:
    return star.dim_providers(lake.providers, lake.clinics)


@query("dim_clinics", "select * from clinics")
def dim_clinics(lake: Lake) -> DataFrame:
    return star.dim_plain(lake.clinics, "clinic_id")


@query("dim_payers", "select * from payers")
def dim_payers(lake: Lake) -> DataFrame:
    return star.dim_plain(lake.payers, "payer_id")


@query("fact_claims", f"""with {FACT} select claim_id, encounter_id, patient_id, provider_id, payer_id, cast(total_charge as double) as total_charge, submission_date, adjudication_date, claim_status, claim_type, cast(total_billed as double) as total_billed, cast(total_allowed as double) as total_allowed,
  line_count, cast(total_paid as double) as total_paid, cast(total_patient_resp as double) as total_patient_resp, cast(payment_received as double) as payment_received, encounter_date, place_of_service_code, encounter_type, last_payment_date, cast(days_to_adjudication as int) as days_to_adjudication, is_paid, is_denied, collection_rate from fact""")
def fact_claims(lake: Lake) -> DataFrame:
    money = ("total_charge", "total_billed", "total_allowed", "total_paid", "total_patient_resp", "payment_received")
    return fact(lake).withColumns({c: F.col(c).cast("double") for c in money})


@query("kpi_revenue_summary", f"""with {FACT} select cast(year(submission_date) as int) as year, cast(month(submission_date) as int) as month, count(*) as claim_count, {dsum('total_charge')} as total_charge, {dsum('total_allowed')} as total_allowed, {dsum('total_paid')} as total_paid, {dsum('total_patient_resp')} as total_patient_resp,
  {r2('avg(days_to_adjudication)')} as avg_days, {pct('sum(total_paid)', 'sum(total_charge)')} as collection_pct, cast({DENIED} as bigint) as denied, {pct(DENIED, 'count(*)')} as denial_pct from fact group by 1, 2""")
def kpi_revenue_summary(lake: Lake) -> DataFrame:
    return kpi.revenue_summary(fact(lake))


@query("kpi_denial_analysis", f"""select upper(denial_code) as denial_code, denial_category, denial_reason, count(*) as denial_count, {dsum('total_charge')} as denied_amount, count(appeal_status) as appeal_count,
  {pct("count(case when upper(appeal_status) = 'APPROVED' then 1 end)", 'count(appeal_status)')} as overturn_pct from denials d left join claims c on c.claim_id = d.claim_id group by 1, 2, 3""")
def kpi_denial_analysis(lake: Lake) -> DataFrame:
    return kpi.denial_analysis(lake.denials, lake.claims)


BUCKET = "case when days <= 30 then '0-30' when days <= 60 then '31-60' when days <= 90 then '61-90' when days <= 120 then '91-120' else '120+' end"


@query("kpi_ar_aging", f"""select {BUCKET} as aging_bucket, payer_id, count(*) as claim_count, {dsum('total_charge')} as outstanding, {r2('avg(days)')} as avg_days, cast(max(days) as int) as max_days
  from (select *, date '2001-08-31' - submission_date as days from claims where upper(claim_status) not in ('PAID', 'VOID', 'ADJUSTED')) group by 1, 2""")
def kpi_ar_aging(lake: Lake) -> DataFrame:
    return kpi.ar_aging(fact(lake), "2001-08-31")


@query("kpi_provider_scorecard", f"""with {FACT} select f.provider_id, provider_name, specialty, credential, count(*) as claim_count, {dsum('total_paid')} as revenue, {r2(dsum('total_charge') + ' / count(total_charge)')} as avg_charge, {r2(dsum('total_paid') + ' / nullif(count(total_paid), 0)')} as avg_paid, {pct(DENIED, 'count(*)')} as denial_pct,
  {r2('avg(days_to_adjudication)')} as avg_days, cast({PAID} as bigint) as paid_count, {pct(PAID, 'count(*)')} as paid_pct from fact f left join providers p on p.provider_id = f.provider_id group by 1, 2, 3, 4""")
def kpi_provider_scorecard(lake: Lake) -> DataFrame:
    return kpi.provider_scorecard(fact(lake), lake.providers)


@query("kpi_payer_mix", f"""with {FACT}, mix as (select f.payer_id, payer_name, payer_type, count(*) as claim_count, {dsum('total_charge')} as billed, {dsum('total_paid')} as paid, {pct(dsum('total_allowed') + ' / count(total_allowed)', dsum('total_charge') + ' / count(total_charge)')} as avg_allowed_pct,
  {r2('avg(days_to_adjudication)')} as avg_days, cast({DENIED} as bigint) as denials, {pct(DENIED, 'count(*)')} as denial_pct from fact f left join payers p on p.payer_id = f.payer_id group by 1, 2, 3)
  select *, {pct('paid', '(select sum(paid) from mix)')} as revenue_share_pct from mix""")
def kpi_payer_mix(lake: Lake) -> DataFrame:
    return kpi.payer_mix(fact(lake), lake.payers)


MEAN_BILLED, MEAN_PAID = dsum("billed_amount") + " / count(*)", dsum("paid_amount") + " / count(*)"


@query("kpi_procedure_revenue", f"""select l.cpt_code, description, count(*) as use_count, {dsum('billed_amount')} as billed, {dsum('paid_amount')} as paid, {r2(MEAN_BILLED)} as avg_billed, {r2(MEAN_PAID)} as avg_paid, {pct(MEAN_PAID, MEAN_BILLED)} as reimbursement_pct
  from claim_lines l left join procedures p on p.cpt_code = l.cpt_code group by 1, 2""")
def kpi_procedure_revenue(lake: Lake) -> DataFrame:
    return kpi.procedure_revenue(lake.claim_lines, lake.procedures)


@query("kpi_diagnosis_burden", f"""select icd10_code, diagnosis_description, chronic_flag, count(distinct patient_id) as patients, count(*) as encounters, count(case when upper(diagnosis_type) = 'PRIMARY' then 1 end) as primary_count,
  {r2('cast(count(*) as double) / count(distinct patient_id)')} as encounters_per_patient from diagnoses group by 1, 2, 3""")
def kpi_diagnosis_burden(lake: Lake) -> DataFrame:
    return kpi.diagnosis_burden(lake.diagnoses)


def had(status: str) -> str:
    return f"count(case when upper(appointment_status) = '{status}' then 1 end)"


@query("kpi_appointment_ops", f"""select cast(year(appointment_date) as int) as year, cast(month(appointment_date) as int) as month, appointment_type, count(*) as scheduled, {had('COMPLETED')} as completed, {had('CANCELLED')} as cancelled, {had('NO SHOW')} as no_show,
  {pct(had('COMPLETED'), 'count(*)')} as completion_pct, {pct(had('NO SHOW'), 'count(*)')} as no_show_pct, {r2('avg(duration_minutes)')} as avg_duration from appointments group by 1, 2, 3""")
def kpi_appointment_ops(lake: Lake) -> DataFrame:
    return kpi.appointment_ops(lake.appointments)


@query("kpi_patient_risk", """with r as (select p.patient_id, name, age, gender, bmi_category, smoking_status, count(case when chronic_flag then 1 end) as chronic_count, count(*) as total_diagnoses, count(distinct icd10_code) as distinct_codes from patients p left join diagnoses d on d.patient_id = p.patient_id group by 1, 2, 3, 4, 5, 6)
  select *, least(chronic_count * 2 + total_diagnoses, 100) as risk_score, case when least(chronic_count * 2 + total_diagnoses, 100) >= 20 then 'High' when least(chronic_count * 2 + total_diagnoses, 100) >= 10 then 'Medium' else 'Low' end as risk_tier from r""")
def kpi_patient_risk(lake: Lake) -> DataFrame:
    return kpi.patient_risk(lake.patients, lake.diagnoses)


@query("kpi_lab_abnormals", f"""with t as (select test_name, count(*) as all_tests, count(case when upper(abnormal_flag) <> 'NORMAL' then 1 end) as all_abnormal from labs group by 1)
  select l.test_name, loinc_code, abnormal_flag, count(*) as abnormal_count, {r2(dsum('result_value') + ' / count(*)')} as avg_value, cast(min(result_value) as double) as min_value, cast(max(result_value) as double) as max_value, all_tests,
  {pct('count(*)', 'all_abnormal')} as share_of_abnormal, {pct('count(*)', 'all_tests')} as abnormal_rate from labs l join t on t.test_name = l.test_name where upper(abnormal_flag) <> 'NORMAL' group by 1, 2, 3, all_tests, all_abnormal""")
def kpi_lab_abnormals(lake: Lake) -> DataFrame:
    return kpi.lab_abnormals(lake.labs)
