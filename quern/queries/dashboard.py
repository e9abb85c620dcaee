"""Dashboard analytics as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.adapters import Lake
from quern.functions.scalars import aging_bucket, bins, bucket, by_rules, mean, round2, safe_pct, total, year_month
from quern.operators import rows
from quern.operators.quantiles import exact_quantiles
from quern.queries.analytics import AGE_LABELS, AGES, ORDERED
from quern.queries.base import dsum, pct, query, r2
from quern.queries.gold import DENIED, FACT, fact, had

AS_OF = "2001-08-31"


def sums(*columns: str) -> list[Column]:
    return [total(F.col(c)).alias(c) for c in columns]


def sql_sums(*columns: str) -> str:
    return ", ".join(f"{dsum(c)} as {c}" for c in columns)


def when_n(condition: str) -> str:
    return f"count(case when {condition} then 1 end)"


@query("exec_headline", f"""with {FACT}, f as (select {dsum('total_paid')} as revenue, {dsum('total_charge')} as billed, {pct('sum(total_paid)', 'sum(total_charge)')} as collection_pct from fact), a as (select {pct(had('COMPLETED'), 'count(*)')} as completion_pct, {pct(had('NO SHOW'), 'count(*)')} as no_show_pct from appointments),
  u as (select {pct(when_n("status = 'APPROVED'"), 'count(*)')} as auth_pct from authorizations), p as (select count(*) as patients from patients) select p.*, f.*, u.*, a.* from f, a, u, p""")
def exec_headline(lake: Lake) -> DataFrame:
    f = fact(lake).agg(total(F.col("total_paid")).alias("revenue"), total(F.col("total_charge")).alias("billed"), safe_pct(F.sum("total_paid"), F.sum("total_charge")).alias("collection_pct"))
    status = lambda s: F.count_if(F.col("appointment_status") == s)
    a = lake.appointments.agg(safe_pct(status("COMPLETED"), F.count("*")).alias("completion_pct"), safe_pct(status("NO SHOW"), F.count("*")).alias("no_show_pct"))
    u = lake.authorizations.agg(safe_pct(F.count_if(F.col("status") == "APPROVED"), F.count("*")).alias("auth_pct"))
    one = lake.patients.agg(F.count("*").alias("patients")).withColumn("one", F.lit(1))
    for df in (f, u, a):  # one row each
        one = one.join(F.broadcast(df.withColumn("one", F.lit(1))), "one")
    return one.drop("one")


MONTH = "strftime(service_date, '%Y-%m')"


@query("exec_monthly_trend", f"select * from (select {MONTH} as period, {sql_sums('billed_amount', 'allowed_amount', 'paid_amount')} from claim_lines group by 1 order by 1 desc limit 36) order by period")
def exec_monthly_trend(lake: Lake) -> DataFrame:
    by = lake.claim_lines.groupBy(year_month(F.col("service_date")).alias("period")).agg(*sums("billed_amount", "allowed_amount", "paid_amount"))
    return by.orderBy(F.desc("period")).limit(36).orderBy("period")


@query("exec_top_procedures", f"select l.cpt_code, substr(description, 1, 20) as label, {sql_sums('paid_amount')} from claim_lines l join procedures p on p.cpt_code = l.cpt_code group by 1, 2 order by sum(paid_amount) desc, l.cpt_code limit 8")
def exec_top_procedures(lake: Lake) -> DataFrame:
    by = lake.claim_lines.groupBy("cpt_code").agg(*sums("paid_amount"))
    top = rows.top_k(by, "paid_amount", 8, "cpt_code")
    return lake.procedures.join(F.broadcast(top), "cpt_code").select("cpt_code", F.substring("description", 1, 20).alias("label"), "paid_amount")


@query("exec_outcomes", "select appointment_status as outcome, count(*) as n from appointments where appointment_status <> 'SCHEDULED' group by 1")
def exec_outcomes(lake: Lake) -> DataFrame:
    wide = lake.appointments.agg(*(F.count_if(F.col("appointment_status") == s).alias(s) for s in ("COMPLETED", "CANCELLED", "NO SHOW")))
    return wide.unpivot([], ["COMPLETED", "CANCELLED", "NO SHOW"], "outcome", "n")


@query("revenue_totals", f"select {sql_sums('billed_amount', 'allowed_amount', 'paid_amount', 'adjustment_amount')}, {dsum('allowed_amount - paid_amount')} as patient_amount, {pct('sum(paid_amount)', 'sum(billed_amount)')} as collection_pct, {pct('sum(adjustment_amount)', 'sum(billed_amount)')} as adjustment_pct from claim_lines")
def revenue_totals(lake: Lake) -> DataFrame:
    return lake.claim_lines.agg(*sums("billed_amount", "allowed_amount", "paid_amount", "adjustment_amount"), total(F.col("allowed_amount") - F.col("paid_amount")).alias("patient_amount"), safe_pct(F.sum("paid_amount"), F.sum("billed_amount")).alias("collection_pct"), safe_pct(F.sum("adjustment_amount"), F.sum("billed_amount")).alias("adjustment_pct"))


@query("revenue_waterfall", f"""with t as (select {dsum('billed_amount')} as gross, {dsum('adjustment_amount')} as adjusted, {dsum('allowed_amount - paid_amount')} as patient, {dsum('paid_amount')} as net from claim_lines)
  select 'gross' as step, gross as amount from t union all select 'contractual', -adjusted from t union all select 'write_off', -greatest(0, gross - adjusted - patient - net) from t union all select 'patient', -patient from t union all select 'net', net from t""")
def revenue_waterfall(lake: Lake) -> DataFrame:
    t = lake.claim_lines.agg(total(F.col("billed_amount")).alias("gross"), total(F.col("adjustment_amount")).alias("adjusted"), total(F.col("allowed_amount") - F.col("paid_amount")).alias("patient_"), total(F.col("paid_amount")).alias("net"))
    t = t.select("gross", (-F.col("adjusted")).alias("contractual"), (-F.greatest(F.lit(0.0), F.col("gross") - F.col("adjusted") - F.col("patient_") - F.col("net"))).alias("write_off"), (-F.col("patient_")).alias("patient"), "net")
    return t.unpivot([], t.columns, "step", "amount")


@query("revenue_monthly", f"select {MONTH} as period, {sql_sums('billed_amount', 'paid_amount', 'adjustment_amount')}, count(*) as line_count, {pct('sum(paid_amount)', 'sum(billed_amount)')} as collection_pct, {pct('sum(adjustment_amount)', 'sum(billed_amount)')} as adjustment_pct from claim_lines group by 1")
def revenue_monthly(lake: Lake) -> DataFrame:
    by = lake.claim_lines.groupBy(year_month(F.col("service_date")).alias("period"))
    return by.agg(*sums("billed_amount", "paid_amount", "adjustment_amount"), F.count("*").alias("line_count"), safe_pct(F.sum("paid_amount"), F.sum("billed_amount")).alias("collection_pct"), safe_pct(F.sum("adjustment_amount"), F.sum("billed_amount")).alias("adjustment_pct"))


@query("revenue_top_codes", f"select cpt_code, {sql_sums('paid_amount')}, {pct('sum(paid_amount)', 'sum(billed_amount)')} as reimbursement_pct from claim_lines group by 1 order by sum(paid_amount) desc, cpt_code limit 15")
def revenue_top_codes(lake: Lake) -> DataFrame:
    by = lake.claim_lines.groupBy("cpt_code").agg(*sums("paid_amount"), safe_pct(F.sum("paid_amount"), F.sum("billed_amount")).alias("reimbursement_pct"))
    return rows.top_k(by, "paid_amount", 15, "cpt_code")


@query("revenue_best_month", f"select arg_max(period, (paid, period)) as best_month, max(paid) as best_paid, {r2('avg(paid)')} as mean_paid from (select {MONTH} as period, {dsum('paid_amount')} as paid from claim_lines group by 1)")
def revenue_best_month(lake: Lake) -> DataFrame:
    by = lake.claim_lines.groupBy(year_month(F.col("service_date")).alias("period")).agg(total(F.col("paid_amount")).alias("paid"))
    return by.agg(F.max_by("period", F.struct("paid", "period")).alias("best_month"), F.max("paid").alias("best_paid"), round2(F.avg("paid")).alias("mean_paid"))


# The classes of a status; of several that a status names, the first here decides.
STATUSES = ("Paid", "Denied", "Pending", "Rejected", "Appealed", "Void", "Adjusted")
TRIMMED = "lower(trim(claim_status))"
STATUS = "case " + " ".join(f"when regexp_matches({TRIMMED}, '(^|[^a-z]){s.lower()}') then '{s}'" for s in STATUSES) + f" else upper({TRIMMED}[1]) || {TRIMMED}[2:] end"


def normal_status(c: Column) -> Column:
    """The class whose name a word of the status begins with; a status that names none stays, in title case."""
    t = F.lower(F.trim(c))
    return F.coalesce(*(F.when(t.rlike(f"(^|[^a-z]){s.lower()}"), s) for s in STATUSES), F.initcap(t))


@query("status_normalise", f"select claim_id, {STATUS} as status from claims")
def status_normalise(lake: Lake) -> DataFrame:
    return lake.claims.select("claim_id", normal_status(F.col("claim_status")).alias("status"))


@query("status_breakdown", f"with {FACT} select {STATUS} as status, count(*) as n, {sql_sums('total_charge', 'total_paid')}, {pct('sum(total_paid)', 'sum(total_charge)')} as collection_pct from fact group by 1")
def status_breakdown(lake: Lake) -> DataFrame:
    return fact(lake).groupBy(normal_status(F.col("claim_status")).alias("status")).agg(F.count("*").alias("n"), *sums("total_charge", "total_paid"), safe_pct(F.sum("total_paid"), F.sum("total_charge")).alias("collection_pct"))


GROUPS = " ".join(f"when age > {a} and age <= {b} then '{g}'" for a, b, g in zip(AGES, AGES[1:], AGE_LABELS, strict=False))


@query("demo_age_groups", f"select case {GROUPS} end as age_group, count(*) as n from patients group by 1")
def demo_age_groups(lake: Lake) -> DataFrame:
    return lake.patients.groupBy(bins(F.col("age"), AGES, AGE_LABELS).alias("age_group")).agg(F.count("*").alias("n"))


@query("demo_shares", f"select {pct(when_n('age >= 65'), 'count(*)')} as over_64, {pct(when_n("gender = 'F'"), 'count(*)')} as female from patients")
def demo_shares(lake: Lake) -> DataFrame:
    return lake.patients.agg(safe_pct(F.count_if(F.col("age") >= 65), F.count("*")).alias("over_64"), safe_pct(F.count_if(F.col("gender") == "F"), F.count("*")).alias("female"))


@query("demo_distributions", "select 'gender' as attribute, gender as value, count(*) as n from patients group by 2 union all select 'segment', segment, count(*) from patients group by 2")
def demo_distributions(lake: Lake) -> DataFrame:
    return lake.patients.unpivot(["patient_id"], ["gender", "segment"], "attribute", "value").groupBy("attribute", "value").agg(F.count("*").alias("n"))


@query("vitals_means", f"select {r2('avg(bmi)')} as bmi, {r2('avg(height_inches)')} as height_inches, {r2('avg(weight_lbs)')} as weight_lbs from vitals")
def vitals_means(lake: Lake) -> DataFrame:
    return lake.vitals.agg(*(round2(F.avg(c)).alias(c) for c in ("bmi", "height_inches", "weight_lbs")))


@query("vitals_histograms", "select 'bmi' as vital, cast(floor((bmi - 15) / 1.25::double) as bigint) as bin, count(*) as n from vitals group by 2 union all select 'weight_lbs', cast(floor((weight_lbs - 100) / 5.0::double) as bigint), count(*) from vitals group by 2")
def vitals_histograms(lake: Lake) -> DataFrame:
    both = lake.vitals.select(F.explode(F.array(F.struct(F.lit("bmi").alias("vital"), bucket(F.col("bmi"), 15, 1.25).alias("bin")), F.struct(F.lit("weight_lbs").alias("vital"), bucket(F.col("weight_lbs"), 100, 5.0).alias("bin")))).alias("x"))
    return both.groupBy("x.vital", "x.bin").agg(F.count("*").alias("n"))


BP = "case when systolic_bp >= 180 then 'Crisis' when systolic_bp >= 140 or diastolic_bp >= 90 then 'Stage 2' when systolic_bp >= 130 or diastolic_bp >= 80 then 'Stage 1' else 'Normal' end"


def bp(s: Column, d: Column) -> Column:
    return by_rules([((s >= 130) | (d >= 80), "Stage 1"), ((s >= 140) | (d >= 90), "Stage 2"), (s >= 180, "Crisis")], F.lit("Normal"))


@query("bp_category", f"select category, n, {pct('n', 'sum(n) over ()')} as share_pct from (select {BP} as category, count(*) as n from vitals group by 1)")
def bp_category(lake: Lake) -> DataFrame:
    return rows.share_of_total(lake.vitals.groupBy(bp(F.col("systolic_bp"), F.col("diastolic_bp")).alias("category")).agg(F.count("*").alias("n")), "n", "share_pct")


@query("procedures_by_volume", f"select cpt_code, count(*) as n, {dsum('billed_amount')} as charges, {r2(dsum('billed_amount') + ' / count(*)')} as mean_charge from claim_lines group by 1 order by n desc, cpt_code limit 15")
def procedures_by_volume(lake: Lake) -> DataFrame:
    by = lake.claim_lines.groupBy("cpt_code").agg(F.count("*").alias("n"), total(F.col("billed_amount")).alias("charges"), round2(mean(F.col("billed_amount"))).alias("mean_charge"))
    return rows.top_k(by, "n", 15, "cpt_code")


@query("procedure_totals", f"with r as (select cpt_code, {dsum('billed_amount')} as billed, {dsum('paid_amount')} as paid, count(*) as n from claim_lines group by 1) select {r2('sum(billed)')} as billed, {r2('sum(paid)')} as paid, {pct('sum(paid)', 'sum(billed)')} as reimbursement_pct, arg_max(cpt_code, (n, -cpt_code)) as top_code from r")
def procedure_totals(lake: Lake) -> DataFrame:
    by = lake.claim_lines.groupBy("cpt_code").agg(F.sum("billed_amount").alias("billed"), F.sum("paid_amount").alias("paid"), F.count("*").alias("n"))
    return by.agg(round2(total(F.col("billed"))).alias("billed"), round2(total(F.col("paid"))).alias("paid"), safe_pct(F.sum("paid"), F.sum("billed")).alias("reimbursement_pct"), F.max_by("cpt_code", F.struct("n", -F.col("cpt_code"))).alias("top_code"))


@query("procedure_rate_rank", f"select * from (select cpt_code, count(*) as n, {pct('sum(paid_amount)', 'sum(billed_amount)')} as reimbursement_pct from claim_lines group by 1 order by n desc, cpt_code limit 15) order by reimbursement_pct desc, cpt_code")
def procedure_rate_rank(lake: Lake) -> DataFrame:
    by = lake.claim_lines.groupBy("cpt_code").agg(F.count("*").alias("n"), safe_pct(F.sum("paid_amount"), F.sum("billed_amount")).alias("reimbursement_pct"))
    return rows.top_k(by, "n", 15, "cpt_code").orderBy(F.desc("reimbursement_pct"), "cpt_code")


ABNORMAL = when_n("abnormal_flag <> 'Normal'")


@query("lab_overall", f"select count(*) as n, {ABNORMAL} as abnormal, {pct(ABNORMAL, 'count(*)')} as abnormal_pct from labs")
def lab_overall(lake: Lake) -> DataFrame:
    odd = F.count_if(F.col("abnormal_flag") != "Normal")
    return lake.labs.agg(F.count("*").alias("n"), odd.alias("abnormal"), safe_pct(odd, F.count("*")).alias("abnormal_pct"))


@query("lab_by_test", f"select test_name, count(*) as n, {pct(ABNORMAL, 'count(*)')} as abnormal_pct from labs group by 1 order by n desc, test_name limit 10")
def lab_by_test(lake: Lake) -> DataFrame:
    by_flag = lake.labs.groupBy("test_name", "abnormal_flag").agg(F.count("*").alias("k"))
    by = by_flag.groupBy("test_name").agg(F.sum("k").alias("n"), safe_pct(F.sum(F.when(F.col("abnormal_flag") != "Normal", F.col("k"))), F.sum("k")).alias("abnormal_pct"))
    return rows.top_k(by, "n", 10, "test_name")


@query("lab_flag_mix", "select abnormal_flag, count(*) as n from labs group by 1")
def lab_flag_mix(lake: Lake) -> DataFrame:
    return lake.labs.groupBy("abnormal_flag").agg(F.count("*").alias("n"))


@query("lab_top_box", "with t as (select test_name from labs group by 1 order by count(*) desc, test_name limit 3) select test_name, quantile_cont(cast(result_value as double), 0.25) as q1, quantile_cont(cast(result_value as double), 0.5) as q2, quantile_cont(cast(result_value as double), 0.75) as q3 from labs where test_name in (select test_name from t) group by 1")
def lab_top_box(lake: Lake) -> DataFrame:
    top = rows.top_k(lake.labs.groupBy("test_name").agg(F.count("*").alias("n")), "n", 3, "test_name")
    return exact_quantiles(lake.labs.join(F.broadcast(top), "test_name", "left_semi"), ["test_name"], "result_value", [0.25, 0.5, 0.75])


@query("appt_totals", f"select count(*) as n, {pct(had('COMPLETED'), 'count(*)')} as completed_pct, {pct(had('CANCELLED'), 'count(*)')} as cancelled_pct, {pct(had('NO SHOW'), 'count(*)')} as no_show_pct from appointments")
def appt_totals(lake: Lake) -> DataFrame:
    share = lambda s: safe_pct(F.count_if(F.col("appointment_status") == s), F.count("*"))
    return lake.appointments.agg(F.count("*").alias("n"), share("COMPLETED").alias("completed_pct"), share("CANCELLED").alias("cancelled_pct"), share("NO SHOW").alias("no_show_pct"))


@query("appt_monthly", "select cast(year(appointment_date) as varchar) || '-' || lpad(cast(month(appointment_date) as varchar), 2, '0') as period, count(*) as n from appointments group by 1")
def appt_monthly(lake: Lake) -> DataFrame:
    key = F.concat(F.year("appointment_date").cast("string"), F.lit("-"), F.lpad(F.month("appointment_date").cast("string"), 2, "0"))
    return lake.appointments.groupBy(key.alias("period")).agg(F.count("*").alias("n"))


@query("appt_by_type", f"select appointment_type, count(*) as n, {pct(had('COMPLETED'), 'count(*)')} as completed_pct from appointments group by 1")
def appt_by_type(lake: Lake) -> DataFrame:
    return lake.appointments.groupBy("appointment_type").agg(F.count("*").alias("n"), safe_pct(F.count_if(F.col("appointment_status") == "COMPLETED"), F.count("*")).alias("completed_pct"))


@query("appt_pivot", "select appointment_type, " + ", ".join(f"count(case when month(appointment_date) = {m} then 1 end) as m{m}" for m in range(1, 13)) + " from appointments group by 1")
def appt_pivot(lake: Lake) -> DataFrame:
    wide = lake.appointments.withColumn("month", F.month("appointment_date")).groupBy("appointment_type").pivot("month", [*range(1, 13)]).count()
    return wide.na.fill(0).toDF("appointment_type", *(f"m{m}" for m in range(1, 13)))


@query("appt_duration", f"select appointment_type, {r2('avg(m)')} as mean_of_months, {r2('sum(m * n) / sum(n)')} as weighted from (select appointment_type, month(appointment_date) as month, avg(duration_minutes) as m, count(*) as n from appointments group by 1, 2) group by 1")
def appt_duration(lake: Lake) -> DataFrame:
    monthly = lake.appointments.groupBy("appointment_type", F.month("appointment_date").alias("month")).agg(F.avg("duration_minutes").alias("m"), F.count("*").alias("n"))
    return monthly.groupBy("appointment_type").agg(round2(F.avg("m")).alias("mean_of_months"), round2(F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("weighted"))


DAYS = "(decision_date - request_date)"


@query("auth_turnaround", f"select cast(floor({DAYS} / 5.0::double) as bigint) as bin, count(*) as n, {r2(f'avg({DAYS})')} as mean_days from authorizations where {DAYS} between 0 and 60 group by 1")
def auth_turnaround(lake: Lake) -> DataFrame:
    days = F.datediff("decision_date", "request_date")
    return lake.authorizations.where(days.between(0, 60)).groupBy(bucket(days, 0, 5.0).alias("bin")).agg(F.count("*").alias("n"), round2(F.avg(days)).alias("mean_days"))


APPROVED = when_n("status = 'APPROVED'")
def approved() -> Column:
    return F.count_if(F.col("status") == "APPROVED")



@query("auth_status", f"select status, count(*) as n from authorizations group by 1")
def auth_status(lake: Lake) -> DataFrame:
    return lake.authorizations.groupBy("status").agg(F.count("*").alias("n"))


@query("auth_by_service", f"select service_type, count(*) as n, {pct(APPROVED, 'count(*)')} as approval_pct from authorizations group by 1 order by n desc, service_type limit 10")
def auth_by_service(lake: Lake) -> DataFrame:
    return rows.top_k(lake.authorizations.groupBy("service_type").agg(F.count("*").alias("n"), safe_pct(approved(), F.count("*")).alias("approval_pct")), "n", 10, "service_type")


@query("auth_monthly", f"select strftime(request_date, '%Y-%m') as period, count(*) as n, {pct(APPROVED, 'count(*)')} as approval_pct from authorizations group by 1")
def auth_monthly(lake: Lake) -> DataFrame:
    return lake.authorizations.groupBy(year_month(F.col("request_date")).alias("period")).agg(F.count("*").alias("n"), safe_pct(approved(), F.count("*")).alias("approval_pct"))


@query("auth_by_payer", f"select payer_id, count(*) as n, {pct(APPROVED, 'count(*)')} as approval_pct from authorizations group by 1 having count(*) >= 50")
def auth_by_payer(lake: Lake) -> DataFrame:
    return lake.authorizations.groupBy("payer_id").agg(F.count("*").alias("n"), safe_pct(approved(), F.count("*")).alias("approval_pct")).where("n >= 50")


@query("payer_performance", f"""with r as (select payer_id, count(*) as n, {pct(APPROVED, 'count(*)')} as approval_pct, {pct(when_n("status = 'DENIED'"), 'count(*)')} as denial_pct, {r2(f'avg({DAYS})')} as mean_days from authorizations group by 1 having count(*) >= 200)
  select *, payer_id = (select arg_max(payer_id, (approval_pct, -payer_id)) from r) as best, payer_id = (select arg_min(payer_id, (approval_pct, payer_id)) from r) as worst from r""")
def payer_performance(lake: Lake) -> DataFrame:
    r = lake.authorizations.groupBy("payer_id").agg(F.count("*").alias("n"), safe_pct(approved(), F.count("*")).alias("approval_pct"), safe_pct(F.count_if(F.col("status") == "DENIED"), F.count("*")).alias("denial_pct"), round2(F.avg(F.datediff("decision_date", "request_date"))).alias("mean_days")).where("n >= 200")
    first = lambda *order: F.row_number().over(Window.orderBy(*order)) == 1
    return r.withColumns({"best": first(F.desc("approval_pct"), "payer_id"), "worst": first("approval_pct", "payer_id")})  # a row for each payer


@query("facility_summary", f"select count(*) as facilities, {pct(when_n("network_status = 'in'"), 'count(*)')} as in_network_pct, count(distinct payer_id) as regions, {r2('avg(bed_count)')} as avg_beds from clinics")
def facility_summary(lake: Lake) -> DataFrame:
    return lake.clinics.agg(F.count("*").alias("facilities"), safe_pct(F.count_if(F.col("network_status") == "in"), F.count("*")).alias("in_network_pct"), F.count_distinct("payer_id").alias("regions"), round2(F.avg("bed_count")).alias("avg_beds"))


@query("facility_mix", "select clinic_type, network_status, count(*) as n from clinics group by 1, 2")
def facility_mix(lake: Lake) -> DataFrame:
    return lake.clinics.groupBy("clinic_type", "network_status").agg(F.count("*").alias("n"))


@query("facility_top_beds", "select clinic_id, bed_count from clinics where clinic_type = 'hospital' order by bed_count desc, clinic_id limit 20")
def facility_top_beds(lake: Lake) -> DataFrame:
    return rows.top_k(lake.clinics.where("clinic_type = 'hospital'").select("clinic_id", "bed_count"), "bed_count", 20, "clinic_id")


OPEN = f"open_lines as (select c.claim_id, billed_amount - paid_amount as balance, date '{AS_OF}' - submission_date as days, submission_date from claims c join claim_lines l on l.claim_id = c.claim_id where claim_status = 'PENDING')"


def open_lines(lake: Lake) -> DataFrame:
    rows_ = lake.claims.where("claim_status = 'PENDING'").join(lake.claim_lines, "claim_id")
    return rows_.select("claim_id", (F.col("billed_amount") - F.col("paid_amount")).alias("balance"), F.datediff(F.lit(AS_OF).cast("date"), "submission_date").alias("days"), "submission_date")


@query("ar_headline", f"with {OPEN} select {dsum('balance')} as outstanding, count(*) as lines, count(distinct claim_id) as claims, {r2('avg(days)')} as avg_days from open_lines")
def ar_headline(lake: Lake) -> DataFrame:
    return open_lines(lake).agg(total(F.col("balance")).alias("outstanding"), F.count("*").alias("lines"), F.count_distinct("claim_id").alias("claims"), round2(F.avg("days")).alias("avg_days"))


AGING = "case when days <= 30 then '0-30' when days <= 60 then '31-60' when days <= 90 then '61-90' when days <= 120 then '91-120' else '120+' end"


@query("ar_aging_lines", f"with {OPEN}, o(place, bucket) as (values {', '.join(f'({i}, {b!r})' for i, b in enumerate(ORDERED))}), a as (select {AGING} as bucket, {dsum('balance')} as outstanding from open_lines group by 1) select place, o.bucket, coalesce(outstanding, 0) as outstanding, {pct('outstanding', '(select sum(outstanding) from a)')} as share_pct from o left join a on a.bucket = o.bucket")
def ar_aging_lines(lake: Lake) -> DataFrame:
    by = rows.share_of_total(open_lines(lake).groupBy(aging_bucket(F.col("days")).alias("bucket")).agg(total(F.col("balance")).alias("outstanding")), "outstanding", "share_pct")
    order = lake.spark.createDataFrame([*enumerate(ORDERED)], "place int, bucket string")
    return order.join(by, "bucket", "left").select("place", "bucket", F.coalesce("outstanding", F.lit(0.0)).alias("outstanding"), F.coalesce("share_pct", F.lit(0.0)).alias("share_pct"))


@query("ar_over90", f"with {OPEN} select {dsum('case when days > 90 then balance end')} as over_90, {pct('sum(case when days > 90 then balance end)', 'sum(balance)')} as over_90_pct from open_lines")
def ar_over90(lake: Lake) -> DataFrame:
    late = F.when(F.col("days") > 90, F.col("balance"))
    return open_lines(lake).agg(total(late).alias("over_90"), safe_pct(F.sum(late), F.sum("balance")).alias("over_90_pct"))


@query("ar_monthly", f"with {OPEN} select * from (select strftime(submission_date, '%Y-%m') as period, {dsum('balance')} as outstanding from open_lines group by 1 order by 1 desc limit 24) order by period")
def ar_monthly(lake: Lake) -> DataFrame:
    by = open_lines(lake).groupBy(year_month(F.col("submission_date")).alias("period")).agg(total(F.col("balance")).alias("outstanding"))
    return by.orderBy(F.desc("period")).limit(24).orderBy("period")


@query("denial_headline", f"select count(*) as denials, {dsum('total_charge')} as amount, {pct(when_n("appeal_status <> 'NOT APPEALED'"), 'count(*)')} as appeal_pct from denials d join claims c on c.claim_id = d.claim_id")
def denial_headline(lake: Lake) -> DataFrame:
    return lake.denials.join(lake.claims, "claim_id").agg(F.count("*").alias("denials"), total(F.col("total_charge")).alias("amount"), safe_pct(F.count_if(F.col("appeal_status") != "NOT APPEALED"), F.count("*")).alias("appeal_pct"))


@query("denial_by_code", f"select cpt_code, {when_n("remark = 'R'")} as denied, {pct(when_n("remark = 'R'"), 'count(*)')} as denial_pct from claim_lines group by 1 order by denied desc, cpt_code limit 15")
def denial_by_code(lake: Lake) -> DataFrame:
    denied = F.count_if(F.col("remark") == "R")
    return rows.top_k(lake.claim_lines.groupBy("cpt_code").agg(denied.alias("denied"), safe_pct(denied, F.count("*")).alias("denial_pct")), "denied", 15, "cpt_code")


@query("denial_monthly", f"with {FACT} select strftime(submission_date, '%Y-%m') as period, {pct(DENIED, 'count(*)')} as denial_pct from fact group by 1")
def denial_monthly(lake: Lake) -> DataFrame:
    return fact(lake).groupBy(year_month(F.col("submission_date")).alias("period")).agg(safe_pct(F.count_if("is_denied"), F.count("*")).alias("denial_pct"))


@query("denial_reasons", f"select denial_reason, n, {pct('n', 'sum(n) over ()')} as share_pct from (select denial_reason, count(*) as n from denials group by 1)")
def denial_reasons(lake: Lake) -> DataFrame:
    return rows.share_of_total(lake.denials.groupBy("denial_reason").agg(F.count("*").alias("n")), "n", "share_pct")


@query("denial_by_urgency", f"select urgency, count(*) as n, {pct(when_n("status = 'DENIED'"), 'count(*)')} as denial_pct from authorizations group by 1 having count(*) >= 100")
def denial_by_urgency(lake: Lake) -> DataFrame:
    return lake.authorizations.groupBy("urgency").agg(F.count("*").alias("n"), safe_pct(F.count_if(F.col("status") == "DENIED"), F.count("*")).alias("denial_pct")).where("n >= 100")


CODE = "case when remark = 'R' then 'CO-' when remark = 'A' then 'PR-' else 'OA-' end || cast(line_number as varchar)"
KIND = "case when starts_with(code, 'CO') then 'contractual' when starts_with(code, 'PR') then 'patient' else 'other' end"


def adjusted(lake: Lake) -> DataFrame:
    code = F.concat(F.when(F.col("remark") == "R", "CO-").when(F.col("remark") == "A", "PR-").otherwise("OA-"), F.col("line_number").cast("string"))
    out = lake.claim_lines.select(code.alias("code"), "adjustment_amount", "remark")
    return out.withColumn("category", F.when(F.col("code").startswith("CO"), "contractual").when(F.col("code").startswith("PR"), "patient").otherwise("other"))


@query("adjustment_codes", f"select code, {KIND} as category, count(*) as n, {dsum('adjustment_amount')} as amount from (select *, {CODE} as code from claim_lines) group by 1, 2 order by sum(adjustment_amount) desc, code limit 12")
def adjustment_codes(lake: Lake) -> DataFrame:
    return rows.top_k(adjusted(lake).groupBy("code", "category").agg(F.count("*").alias("n"), total(F.col("adjustment_amount")).alias("amount")), "amount", 12, "code")


@query("adjustment_categories", f"with a as (select {KIND} as category, {dsum('adjustment_amount')} as amount from (select *, {CODE} as code from claim_lines) group by 1) select *, {pct('amount', '(select sum(amount) from a)')} as share_pct from a")
def adjustment_categories(lake: Lake) -> DataFrame:
    return rows.share_of_total(adjusted(lake).groupBy("category").agg(total(F.col("adjustment_amount")).alias("amount")), "amount", "share_pct")


@query("remark_codes", "select remark, case remark when 'A' then 'Accepted' when 'R' then 'Returned' else 'Unknown code' end as meaning, count(*) as n from claim_lines group by 1, 2 order by n desc, remark limit 10")
def remark_codes(lake: Lake) -> DataFrame:
    meaning = lake.spark.createDataFrame([("A", "Accepted"), ("R", "Returned")], "remark string, meaning string")
    by = lake.claim_lines.groupBy("remark").agg(F.count("*").alias("n")).join(F.broadcast(meaning), "remark", "left")
    return rows.top_k(by.select("remark", F.coalesce("meaning", F.lit("Unknown code")).alias("meaning"), "n"), "n", 10, "remark")


RECOVERABLE = "case when is_denied then total_charge end"
OVER_90 = f"case when upper(claim_status) not in ('PAID', 'VOID', 'ADJUSTED') and date '{AS_OF}' - submission_date > 90 then total_charge end"
BALANCE = "case when upper(claim_status) in ('PENDING', 'REJECTED') then total_patient_resp end"


@query("opportunity_estimates", f"with {FACT} select {r2(dsum(RECOVERABLE) + ' * 0.35::double')} as recoverable_denied, {dsum(OVER_90)} as ar_over_90, {dsum(BALANCE)} as patient_balance from fact")
def opportunity_estimates(lake: Lake) -> DataFrame:
    status = F.upper("claim_status")
    late = ~status.isin("PAID", "VOID", "ADJUSTED") & (F.datediff(F.lit(AS_OF).cast("date"), "submission_date") > 90)
    return fact(lake).agg(round2(total(F.when(F.col("is_denied"), F.col("total_charge"))) * 0.35).alias("recoverable_denied"), total(F.when(late, F.col("total_charge"))).alias("ar_over_90"), total(F.when(status.isin("PENDING", "REJECTED"), F.col("total_patient_resp"))).alias("patient_balance"))


# Metric, whether above or below is bad, limit.
THRESHOLDS = [("no_show_pct", "above", 10.0), ("abnormal_pct", "above", 25.0), ("denial_pct", "above", 10.0), ("in_network_pct", "below", 80.0)]


@query("threshold_alerts", f"""with m as (select 'no_show_pct' as metric, {pct(had('NO SHOW'), 'count(*)')} as value from appointments union all select 'abnormal_pct', {pct(ABNORMAL, 'count(*)')} from labs
  union all select 'denial_pct', {pct(when_n("claim_status = 'DENIED'"), 'count(*)')} from claims union all select 'in_network_pct', {pct(when_n("network_status = 'in'"), 'count(*)')} from clinics),
  t(metric, bad, threshold) as (values {', '.join(f"('{a}', '{b}', {c}::double)" for a, b, c in THRESHOLDS)}) select m.metric, value, bad, threshold, case when bad = 'above' then value > threshold else value < threshold end as alert from m join t on t.metric = m.metric""")
def threshold_alerts(lake: Lake) -> DataFrame:
    metric = lambda df, name, column, value: df.agg(safe_pct(F.count_if(column), F.count("*")).alias("value")).select(F.lit(name).alias("metric"), "value")
    m = rows.safe_union([
        metric(lake.appointments, "no_show_pct", F.col("appointment_status") == "NO SHOW", None), metric(lake.labs, "abnormal_pct", F.col("abnormal_flag") != "Normal", None),
        metric(lake.claims, "denial_pct", F.col("claim_status") == "DENIED", None), metric(lake.clinics, "in_network_pct", F.col("network_status") == "in", None),
    ])
    t = lake.spark.createDataFrame(THRESHOLDS, "metric string, bad string, threshold double")
    return m.join(F.broadcast(t), "metric").withColumn("alert", F.when(F.col("bad") == "above", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold")))
