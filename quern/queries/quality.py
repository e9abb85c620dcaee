"""Standardisation, data-quality rules and reconciliations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.adapters import Lake, abnormal_flag
from quern.functions.scalars import money, normalize_nulls, to_bool, to_date, to_double, to_int, total
from quern.operators import clean, dq
from quern.queries.base import dsum, query
from quern.queries.rows import DIRTY, dirty_customers
from quern.schema import Rule, TableSpec, between, negative, swapped

SPEC = TableSpec("customers", "customer_id", casts={"nation": "int"}, upper=("segment",), rules=(Rule("invalid_name", "regex", "name", r"^Customer#\d{8}[0-8]$"), between("nation", 0, 20)))


@query("trim_strings", f"with d as ({DIRTY}) select customer_id, trim(nation) as nation, trim(name) as name, trim(segment) as segment from d")
def trim_strings(lake: Lake) -> DataFrame:
    return clean.trim_strings(dirty_customers(lake))


def cased(lake: Lake, **case: tuple[str, ...]) -> DataFrame:
    return clean.clean_table(dirty_customers(lake), TableSpec("customers", "customer_id", **case)).select("customer_id", "segment")


@query("case_upper", f"with d as ({DIRTY}) select customer_id, case when lower(segment) <> 'none' then upper(trim(segment)) end as segment from d")
def case_upper(lake: Lake) -> DataFrame:
    return cased(lake, upper=("segment",))


@query("case_lower", f"with d as ({DIRTY}) select customer_id, case when lower(segment) <> 'none' then lower(trim(segment)) end as segment from d")
def case_lower(lake: Lake) -> DataFrame:
    return cased(lake, lower=("segment",))


@query("case_initcap", f"with d as ({DIRTY}) select customer_id, case when lower(segment) <> 'none' then upper(substr(trim(segment), 1, 1)) || lower(substr(trim(segment), 2)) end as segment from d")
def case_initcap(lake: Lake) -> DataFrame:
    return cased(lake, initcap=("segment",))


@query("cast_int", f"with d as ({DIRTY}) select customer_id, cast(trunc(try_cast(nation as double)) as int) as nation from d")
def cast_int(lake: Lake) -> DataFrame:
    return dirty_customers(lake).select("customer_id", to_int(F.col("nation")).alias("nation"))


@query("cast_double", f"with d as ({DIRTY}) select customer_id, try_cast(nation as double) as nation from d")
def cast_double(lake: Lake) -> DataFrame:
    return dirty_customers(lake).select("customer_id", to_double(F.col("nation")).alias("nation"))


@query("cast_date", "select o_orderkey, case when o_orderkey % 9 <> 0 then cast(o_orderdate as date) end as day from orders")
def cast_date(lake: Lake) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 9 == 0, "2024-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return lake.orders.select("o_orderkey", to_date(raw).alias("day"))


@query("cast_bool", "select o_orderkey, case o_orderkey % 3 when 0 then true when 1 then false end as flag from orders")
def cast_bool(lake: Lake) -> DataFrame:
    k = F.col("o_orderkey") % 3
    return lake.orders.select("o_orderkey", to_bool(F.when(k == 0, "true").when(k == 1, "false").otherwise("perhaps")).alias("flag"))


SEQ = "select o_orderkey, cast(o_orderdate as date) as start_day, cast(o_orderdate as date) + (case when o_orderkey % 4 = 0 then -5 else 5 end) as end_day from orders"


def sequences(lake: Lake) -> DataFrame:
    day = F.to_date("o_orderdate")
    return lake.orders.select("o_orderkey", day.alias("start_day"), F.date_add(day, F.when(F.col("o_orderkey") % 4 == 0, -5).otherwise(5)).alias("end_day"))


@query("fix_date_seq", f"with s as ({SEQ}) select o_orderkey, cast(least(start_day, end_day) as date) as start_day, cast(greatest(start_day, end_day) as date) as end_day, end_day < start_day as _dq_flag, case when end_day < start_day then 'swapped_days' end as _dq_issues from s")
def fix_date_seq(lake: Lake) -> DataFrame:
    rules = [swapped("start_day", "end_day", "days")]
    return clean.repaired(clean.flagged(sequences(lake), rules), rules)


@query("null_negative", "select c_custkey, case when c_acctbal >= 0 then c_acctbal end as c_acctbal, c_acctbal < 0 as _dq_flag, case when c_acctbal < 0 then 'negative_c_acctbal' end as _dq_issues from customer")
def null_negative(lake: Lake) -> DataFrame:
    rules = [*negative("c_acctbal")]
    return clean.repaired(clean.flagged(lake.customer.select("c_custkey", "c_acctbal"), rules), rules)


@query("null_out_of_range", "select event_id, case when value between 5 and 80 then value end as value, value not between 5 and 80 as _dq_flag, case when value not between 5 and 80 then 'value_out_of_range' end as _dq_issues from events")
def null_out_of_range(lake: Lake) -> DataFrame:
    rules = [between("value", 5, 80, "null")]
    return clean.repaired(clean.flagged(lake.events.select("event_id", "value"), rules), rules)


CLEANED = f"""d as ({DIRTY}), t as (select customer_id, cast(trunc(try_cast(nation as double)) as int) as nation, trim(name) as name, case when lower(segment) <> 'none' then upper(trim(segment)) end as segment from d),
  f as (select *, case when not regexp_matches(name, '^Customer#\\d{{8}}[0-8]$') then 'invalid_name' end as a, case when nation not between 0 and 20 then 'nation_out_of_range' end as b from t)"""


@query("clean_table", f"with {CLEANED} select customer_id, nation, name, segment, nullif(concat_ws(', ', a, b), '') as _dq_issues, (a is not null or b is not null) as _dq_flag from f")
def clean_table(lake: Lake) -> DataFrame:
    return clean.clean_table(dirty_customers(lake), SPEC)


@query("dq_flag", f"with {CLEANED} select nullif(concat_ws(', ', a, b), '') as _dq_issues, count(*) as n from f group by 1")
def dq_flag(lake: Lake) -> DataFrame:
    return clean.clean_table(dirty_customers(lake), SPEC).groupBy("_dq_issues").agg(F.count("*").alias("n"))


@query("dq_count", f"with {CLEANED} select count(case when a is not null or b is not null then 1 end) as flagged, count(*) as n from f")
def dq_count(lake: Lake) -> DataFrame:
    return clean.clean_table(dirty_customers(lake), SPEC).agg(F.count_if("_dq_flag").alias("flagged"), F.count("*").alias("n"))


@query("dq_regex", "select c_custkey from customer where not regexp_matches(c_name, '^Customer#\\d{8}[0-4]$')")
def dq_regex(lake: Lake) -> DataFrame:
    return lake.customer.where(clean.failed(Rule("x", "regex", "c_name", r"^Customer#\d{8}[0-4]$"))).select("c_custkey")


@query("dq_range", "select event_id from events where value not between 1 and 150")
def dq_range(lake: Lake) -> DataFrame:
    return lake.events.where(clean.failed(between("value", 1, 150))).select("event_id")


@query("dq_compare", "select o_orderkey, case when o_totalprice < 1000 then 'small' when o_orderdate > timestamp '2001-06-30' then 'late' end as issue from orders where o_totalprice < 1000 or o_orderdate > timestamp '2001-06-30'")
def dq_compare(lake: Lake) -> DataFrame:
    found = dq.issues(lake.orders, ["o_orderkey"], {"small": F.col("o_totalprice") < 1000, "late": (F.col("o_totalprice") >= 1000) & (F.col("o_orderdate") > F.lit("2001-06-30").cast("timestamp_ntz"))})
    return found


@query("dq01_missing", f"with d as ({DIRTY}) select 'segment' as column_name, count(case when lower(segment) = 'none' then 1 end) as missing, count(*) as rows from d union all select 'name', 0, count(*) from d")
def dq01_missing(lake: Lake) -> DataFrame:
    return dq.missing_profile(dirty_customers(lake), ["segment", "name"])


@query("dq02_invalid_format", "select doc_id from documents where not regexp_matches(source, '^src\\d$')")
def dq02_invalid_format(lake: Lake) -> DataFrame:
    return lake.documents.where(~F.col("source").rlike(r"^src\d$")).select("doc_id")


@query("dq03_out_of_range", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity not between 2 and 49")
def dq03_out_of_range(lake: Lake) -> DataFrame:
    return lake.lineitem.where(clean.failed(between("l_quantity", 2, 49))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("dq04_future_date", "select o_orderkey from orders where cast(o_orderdate as date) > date '2001-01-01'")
def dq04_future_date(lake: Lake) -> DataFrame:
    return lake.orders.where(F.col("o_orderdate") >= F.lit("2001-01-02").cast("timestamp_ntz")).select("o_orderkey")


@query("dq05_past_date", "select o_orderkey from orders where cast(o_orderdate as date) < date '1995-06-01'")
def dq05_past_date(lake: Lake) -> DataFrame:
    return lake.orders.where(F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")).select("o_orderkey")


@query("dq06_impossible", "select event_id, unnest(list_filter([case when value > 300 then 'value' end, case when user_id < 0 then 'user_id' end], lambda x: x is not null)) as issue from events where value > 300 or user_id < 0")
def dq06_impossible(lake: Lake) -> DataFrame:
    return dq.issues(lake.events, ["event_id"], {"value": F.col("value") > 300, "user_id": F.col("user_id") < 0})


@query("dq07_wrong_type", f"with d as ({DIRTY}) select customer_id, nation from d where nation is not null and try_cast(nation as double) is null")
def dq07_wrong_type(lake: Lake) -> DataFrame:
    return dirty_customers(lake).where(dq.wrong_type(F.col("nation"), "double")).select("customer_id", "nation")


@query("dq08_special_chars", "select doc_id from documents where regexp_matches(text, '[#$%&*@^~|<>{}\\\\]')")
def dq08_special_chars(lake: Lake) -> DataFrame:
    return lake.documents.where(dq.special_characters(F.col("text"))).select("doc_id")


@query("dq09_near_duplicate", "select doc_id, original from (select doc_id, min(doc_id) over (partition by text) as original from documents) where doc_id <> original")
def dq09_near_duplicate(lake: Lake) -> DataFrame:
    """Texts that another row has with a smaller id, whatever else differs."""
    return dq.near_duplicates(lake.documents.select("doc_id", F.md5("text").alias("content")), "doc_id", ["content"]).select("doc_id", "original")


@query("dq10_inconsistent", "select claim_id from claims where (claim_status = 'PENDING' and adjudication_date is not null) or (claim_status <> 'PENDING' and adjudication_date = submission_date)")
def dq10_inconsistent(lake: Lake) -> DataFrame:
    c = F.col("claim_status")
    return lake.claims.where(((c == "PENDING") & F.col("adjudication_date").isNotNull()) | ((c != "PENDING") & (F.col("adjudication_date") == F.col("submission_date")))).select("claim_id")


@query("dq11_logical", "select o_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey where l_shipdate < o_orderdate")
def dq11_logical(lake: Lake) -> DataFrame:
    return lake.orders.join(lake.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate < o_orderdate").select("o_orderkey", "l_linenumber")


@query("dq12_negative", "select 'customer' as kind, c_custkey as id from customer where c_acctbal < 0 union all select 'supplier', s_suppkey from supplier where s_acctbal < 0")
def dq12_negative(lake: Lake) -> DataFrame:
    return lake.customer.where("c_acctbal < 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")).union(lake.supplier.where("s_acctbal < 0").select(F.lit("supplier"), "s_suppkey"))


@query("dq13_swapped", "select vital_id, greatest(systolic_bp, diastolic_bp) as systolic_bp, least(systolic_bp, diastolic_bp) as diastolic_bp from (select vital_id, case when vital_id % 6 = 0 then diastolic_bp else systolic_bp end as systolic_bp, case when vital_id % 6 = 0 then systolic_bp else diastolic_bp end as diastolic_bp from vitals) where systolic_bp < diastolic_bp")
def dq13_swapped(lake: Lake) -> DataFrame:
    sixth, s, d = F.col("vital_id") % 6 == 0, F.col("systolic_bp"), F.col("diastolic_bp")
    mixed = lake.vitals.select("vital_id", F.when(sixth, d).otherwise(s).alias("systolic_bp"), F.when(sixth, s).otherwise(d).alias("diastolic_bp"))
    return mixed.where("systolic_bp < diastolic_bp").select("vital_id", F.greatest("systolic_bp", "diastolic_bp").alias("systolic_bp"), F.least("systolic_bp", "diastolic_bp").alias("diastolic_bp"))


CUT = "select event_id, case when event_id % 500 = 0 then substr(event_type, 1, length(event_type) - 1) else event_type end as event_type from events"


@query("dq14_truncated", f"""with c as ({CUT}), n as (select event_type as value, count(*) as n from c group by 1)
  select c.event_id, c.event_type, min(f.value) as "full" from c join n s on s.value = c.event_type and s.n < 100 join n f on f.n >= 100 and starts_with(f.value, s.value) and length(f.value) > length(s.value) group by 1, 2""")
def dq14_truncated(lake: Lake) -> DataFrame:
    kind = F.col("event_type")
    cut = lake.events.select("event_id", F.when(F.col("event_id") % 500 == 0, F.substring(kind, F.lit(1), F.length(kind) - 1)).otherwise(kind).alias("event_type"))
    return dq.truncated(cut, "event_id", "event_type", least=3, often=100)


@query("dq15_case", "with f as (select lower(v) as folded, v as form, count(*) as n from (select case when c_custkey % 10 = 0 then lower(c_mktsegment) else c_mktsegment end as v from customer) group by 1, 2) select folded, count(*) as variants, arg_min(form, (-n, form)) as canonical from f group by 1 having count(*) > 1")
def dq15_case(lake: Lake) -> DataFrame:
    mixed = F.when(F.col("c_custkey") % 10 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return dq.case_variants(lake.customer.select(mixed.alias("v")), "v")


@query("dq16_whitespace", f"with d as ({DIRTY}) select customer_id, trim(regexp_replace(name, '\\s+', ' ', 'g')) as name from d where regexp_matches(name, '^\\s|\\s$|\\s{{2,}}')")
def dq16_whitespace(lake: Lake) -> DataFrame:
    return dirty_customers(lake).where(dq.untidy_space(F.col("name"))).select("customer_id", dq.tidy_space(F.col("name")).alias("name"))


@query("dq17_encoding", "select doc_id from documents where regexp_matches(text, '[^\\x00-\\x7F]')")
def dq17_encoding(lake: Lake) -> DataFrame:
    return lake.documents.where(dq.not_ascii(F.col("text"))).select("doc_id")


@query("dq18_orphan_fk", "select event_id, user_id from events where user_id not in (select c_custkey from customer where c_custkey % 9 <> 0)")
def dq18_orphan_fk(lake: Lake) -> DataFrame:
    return dq.orphans(lake.events, lake.customer.where("c_custkey % 9 <> 0"), "user_id", "c_custkey").select("event_id", "user_id")


@query("dq19_amount_mismatch", f"select o_orderkey, {dsum('cast(l_extendedprice as decimal(12,2))')} as line_total from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey, o_totalprice having abs(cast(o_totalprice as decimal(12,2)) - sum(cast(l_extendedprice as decimal(12,2)))) > 1")
def dq19_amount_mismatch(lake: Lake) -> DataFrame:
    heads = lake.orders.select("o_orderkey", money("o_totalprice").alias("amount"))
    lines = lake.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return dq.amount_mismatch(heads, lines, "o_orderkey", "amount", money("l_extendedprice"), 1).select("o_orderkey", F.col("line_total").cast("double").alias("line_total"))


@query("dq20_date_sequence", f"with s as ({SEQ}) select o_orderkey from s where end_day < start_day")
def dq20_date_sequence(lake: Lake) -> DataFrame:
    return sequences(lake).where("end_day < start_day").select("o_orderkey")


@query("dq21_referential_break", "select event_id, 'INVALID_' || cast(user_id as varchar) as user_ref from events where event_id % 50 = 0")
def dq21_referential_break(lake: Lake) -> DataFrame:
    broken = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("INVALID_"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    rows_ = lake.events.select("event_id", broken.alias("user_ref")).where(F.col("user_ref").startswith("INVALID_"))
    return dq.orphans(rows_, lake.customer.select(F.col("c_custkey").cast("string").alias("c_custkey")), "user_ref", "c_custkey").select("event_id", "user_ref")


@query("dq22_stale_status", "select claim_id from claims where claim_status = 'PENDING' and submission_date < date '2001-12-31' - interval 3 year")
def dq22_stale_status(lake: Lake) -> DataFrame:
    return lake.claims.where((F.col("claim_status") == "PENDING") & (F.col("submission_date") < F.add_months(F.lit("2001-12-31").cast("date"), -36))).select("claim_id")


@query("recompute_abnormal_flag", "select lab_id from labs where abnormal_flag <> case when result_value < 24 then 'Critical Low' when result_value < 30 then 'Low' when result_value <= 80 then 'Normal' when result_value <= 96 then 'High' else 'Critical High' end")
def recompute_abnormal_flag(lake: Lake) -> DataFrame:
    return lake.labs.where(F.col("abnormal_flag") != abnormal_flag(F.col("result_value"), F.lit(30), F.lit(80))).select("lab_id")


@query("recompute_bmi", "select vital_id from vitals where abs(bmi - 703 * weight_lbs / (height_inches * height_inches)) > 5")
def recompute_bmi(lake: Lake) -> DataFrame:
    h = F.col("height_inches")
    return lake.vitals.where(F.abs(F.col("bmi") - F.lit(703) * F.col("weight_lbs") / (h * h)) > 5).select("vital_id")


@query("reconcile_claim_total", f"select c.claim_id, cast(total_charge as double) as total_charge, {dsum('billed_amount')} as line_total from claims c join claim_lines l on l.claim_id = c.claim_id group by 1, c.total_charge having abs(total_charge - sum(billed_amount)) > 0.01")
def reconcile_claim_total(lake: Lake) -> DataFrame:
    out = dq.amount_mismatch(lake.claims.select("claim_id", "total_charge"), lake.claim_lines, "claim_id", "total_charge", F.col("billed_amount"), 0.01)
    return out.select("claim_id", F.col("total_charge").cast("double").alias("total_charge"), F.col("line_total").cast("double").alias("line_total"))


@query("reconcile_line_split", "select count(*) as n, count(case when adjustment_amount = billed_amount - allowed_amount then 1 end) as balanced, count(case when paid_amount = greatest(0, allowed_amount - (allowed_amount - paid_amount)) then 1 end) as paid_ok from claim_lines")
def reconcile_line_split(lake: Lake) -> DataFrame:
    a, b, p = (F.col(c) for c in ("allowed_amount", "billed_amount", "paid_amount"))
    return lake.claim_lines.agg(F.count("*").alias("n"), F.count_if(F.col("adjustment_amount") == b - a).alias("balanced"), F.count_if(p == F.greatest(F.lit(0), a - (a - p))).alias("paid_ok"))


@query("remittance_batches", f"select payer_id, adjudication_date, {dsum('total_charge')} as total_payment_amount, count(*) as claim_count from claims where claim_status = 'PAID' group by 1, 2")
def remittance_batches(lake: Lake) -> DataFrame:
    return lake.claims.where("claim_status = 'PAID'").groupBy("payer_id", "adjudication_date").agg(total(F.col("total_charge")).alias("total_payment_amount"), F.count("*").alias("claim_count"))


@query("normalize_nulls", f"with d as ({DIRTY}) select customer_id, case when lower(trim(segment)) not in ('', 'none') then segment end as segment from d")
def normalize(lake: Lake) -> DataFrame:
    return dirty_customers(lake).select("customer_id", normalize_nulls(F.col("segment")).alias("segment"))


@query("dq_rows_by_issue", "select c.issue, count(*) as n from (select case when c_acctbal < 0 then 'negative' end as issue from customer) c where issue is not null group by 1")
def dq_rows_by_issue(lake: Lake) -> DataFrame:
    return dq.issues(lake.customer, ["c_custkey"], {"negative": F.col("c_acctbal") < 0}).groupBy("issue").agg(F.count("*").alias("n"))


