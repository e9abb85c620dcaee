"""Scans, row metadata, filters, set operations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.adapters import Lake
from quern.functions.scalars import total
from quern.operators import dq, merge, rows
from quern.queries.base import dsum, pct, query
from quern.sources import files
from quern.sources.scratch import new_folder

DIRTY = """select cast(c_custkey as varchar) as customer_id, case when c_custkey % 7 = 0 then 'TEXT' else cast(c_nationkey as varchar) || '.7' end as nation, case when c_custkey % 5 = 0 then '  ' || c_name || ' ' else c_name end as name,
  case when c_custkey % 11 = 0 then 'None' else lower(c_mktsegment) end as segment from customer"""


def dirty_customers(lake: Lake) -> DataFrame:
    """An all-text table with faults made by rule."""
    k = F.col("c_custkey")
    return lake.customer.select(k.cast("string").alias("customer_id"), F.when(k % 7 == 0, "TEXT").otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit(".7"))).alias("nation"), F.when(k % 5 == 0, F.concat(F.lit("  "), "c_name", F.lit(" "))).otherwise(F.col("c_name")).alias("name"), F.when(k % 11 == 0, "None").otherwise(F.lower("c_mktsegment")).alias("segment"))


@query("scan_parquet_as_string", "select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus, o_orderpriority from orders")
def scan_parquet_as_string(lake: Lake) -> DataFrame:
    return files.scan_parquet_as_string(lake.spark, f"{lake.folder}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("scan_projected", "select o_orderkey, o_orderstatus from orders")
def scan_projected(lake: Lake) -> DataFrame:
    return lake.orders.select("o_orderkey", "o_orderstatus")


@query("safe_union", "select c_custkey as id, c_name as name, cast(null as varchar) as size from customer union all select p_partkey, p_name, cast(p_size as varchar) from part")
def safe_union(lake: Lake) -> DataFrame:
    return rows.safe_union([lake.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), lake.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("size"))])


@query("scan_multi_source", "select s_suppkey as key, s_name as name, 'clean' as _source from supplier union all select c_custkey, c_name, 'dirty' from customer")
def scan_multi_source(lake: Lake) -> DataFrame:
    """The whole of both tables from folders of CSV and of Parquet; a third folder is missing."""
    folder = new_folder(lake.spark, "multi")
    lake.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")).write.options(header=True, escape='"').csv(f"{folder}/clean")
    lake.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).write.parquet(f"{folder}/dirty")
    found = files.scan_multi_source(lake.spark, {source: f"{folder}/{source}" for source in ("clean", "none", "dirty")})
    return found.select(F.col("key").cast("long").alias("key"), "name", "_source")


@query("row_hash", "select c_custkey, md5(coalesce(c_name, '') || '|' || coalesce(c_mktsegment, '')) as compat, md5(cast(length(c_name) as varchar) || ':' || c_name || '|' || cast(length(c_mktsegment) as varchar) || ':' || c_mktsegment) as safe from customer")
def row_hash(lake: Lake) -> DataFrame:
    columns = ["c_name", "c_mktsegment"]
    return lake.customer.select("c_custkey", rows.row_hash(lake.customer, columns, "compat").alias("compat"), rows.row_hash(lake.customer, columns).alias("safe"))


@query("stamp_bronze", "select c_custkey, c_name, 'customer' as _bronze_table, date '2024-01-31' as _ingestion_date, md5(cast(c_custkey as varchar) || '|' || c_name) as _row_hash from customer")
def stamp_bronze(lake: Lake) -> DataFrame:
    return rows.stamp(lake.customer.select("c_custkey", "c_name"), "bronze", "customer", F.lit("2024-01-31 08:00:00").cast("timestamp_ntz")).drop("_ingested_at")


@query("stamp_silver", "select *, 'orders' as _silver_table, date '2024-01-31' as _silver_date from orders")
def stamp_silver(lake: Lake) -> DataFrame:
    return rows.stamp(lake.orders, "silver", "orders", F.lit("2024-01-31 08:00:00").cast("timestamp_ntz")).drop("_cleaned_at")


@query("stamp_gold", "select *, 'supplier' as _gold_table, date '2024-01-31' as _gold_date from supplier")
def stamp_gold(lake: Lake) -> DataFrame:
    return rows.stamp(lake.supplier, "gold", "supplier", F.lit("2024-01-31 08:00:00").cast("timestamp_ntz")).drop("_computed_at")


@query("drop_meta", "select * from part")
def drop_meta(lake: Lake) -> DataFrame:
    return rows.drop_meta(rows.stamp(lake.part, "gold", "part"))


@query("project_existing", "select o_orderkey, o_totalprice from orders")
def project_existing(lake: Lake) -> DataFrame:
    return rows.project_existing(lake.orders, ["o_orderkey", "not_there", "o_totalprice"])


@query("typed_null_column", "select c_custkey, c_name, cast(null as double) as rate, cast(null as date) as since from customer")
def typed_null_column(lake: Lake) -> DataFrame:
    return rows.with_typed_nulls(lake.customer.select("c_custkey", "c_name"), {"rate": "double", "since": "date", "c_name": "string"})


@query("filter_pk_not_null", f"with d as ({DIRTY}) select try_cast(segment as varchar) as segment, count(*) as n from d where nullif(segment, 'None') is not null group by 1")
def filter_pk_not_null(lake: Lake) -> DataFrame:
    return dirty_customers(lake).withColumn("segment", F.nullif("segment", F.lit("None"))).where("segment is not null").groupBy("segment").agg(F.count("*").alias("n"))


@query("watermark_filter", "select event_id, ts from events where ts > timestamp '2024-01-20 00:00:00'")
def watermark_filter(lake: Lake) -> DataFrame:
    return rows.watermark_filter(lake.events, "ts", "2024-01-20 00:00:00").select("event_id", "ts")


@query("filter_primary", "select patient_id, payer_id from patient_insurance where upper(insurance_priority) = 'PRIMARY'")
def filter_primary(lake: Lake) -> DataFrame:
    return lake.patient_insurance.where(F.upper("insurance_priority") == "PRIMARY").select("patient_id", "payer_id")


@query("filter_not_in_upper", "select claim_id from claims where upper(claim_status) not in ('PAID', 'DENIED')")
def filter_not_in_upper(lake: Lake) -> DataFrame:
    return lake.claims.where(~F.upper("claim_status").isin("PAID", "DENIED")).select("claim_id")


@query("filter_not_null_ne", "select lab_id, abnormal_flag from labs where abnormal_flag is not null and upper(abnormal_flag) <> 'NORMAL'")
def filter_not_null_ne(lake: Lake) -> DataFrame:
    return lake.labs.where(F.col("abnormal_flag").isNotNull() & (F.upper("abnormal_flag") != "NORMAL")).select("lab_id", "abnormal_flag")


@query("filter_year_range", "select o_orderkey from orders where year(o_orderdate) between 1996 and 1998")
def filter_year_range(lake: Lake) -> DataFrame:
    return lake.orders.where((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1999-01-01")).select("o_orderkey")


@query("dedup_by_pk", """select l_orderkey, l_linenumber, l_partkey, l_shipdate from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey, l_suppkey, l_extendedprice) as n from lineitem) where n = 1""")
def dedup_by_pk(lake: Lake) -> DataFrame:
    return rows.latest(lake.lineitem, ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@query("sample_seeded", "select c_custkey, c_name from customer order by md5(cast(c_custkey as varchar) || ':42'), c_custkey limit 5000")
def sample_seeded(lake: Lake) -> DataFrame:
    return rows.sample_seeded(lake.customer.select("c_custkey", "c_name"), "c_custkey", 5000)


@query("union_allow_missing", "select o_orderkey as k, o_orderstatus as s, null::double as v from orders where o_orderstatus = 'P' union all select l_orderkey, l_linestatus, l_quantity from lineitem where l_quantity > 45")
def union_allow_missing(lake: Lake) -> DataFrame:
    a = lake.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return a.unionByName(lake.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("s"), F.col("l_quantity").alias("v")), allowMissingColumns=True)


@query("distinct_keys", "select distinct l_partkey, l_suppkey from lineitem")
def distinct_keys(lake: Lake) -> DataFrame:
    return lake.lineitem.select("l_partkey", "l_suppkey").dropDuplicates()


@query("join_left_dim", "select p.patient_id, p.segment, i.plan_name from patients p left join patient_insurance i on i.patient_id = p.patient_id and i.insurance_priority = 'Primary'")
def join_left_dim(lake: Lake) -> DataFrame:
    primary = lake.patient_insurance.where("insurance_priority = 'Primary'").select("patient_id", "plan_name")
    return lake.patients.select("patient_id", "segment").join(primary, "patient_id", "left")


@query("join_left_lookup", "select s_suppkey, n_name, r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def join_left_lookup(lake: Lake) -> DataFrame:
    return lake.supplier.join(lake.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(lake.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("join_left_preagg", f"select c.claim_id, l.n, l.billed from claims c left join (select claim_id, count(*) as n, {dsum('billed_amount')} as billed from claim_lines group by 1) l on l.claim_id = c.claim_id")
def join_left_preagg(lake: Lake) -> DataFrame:
    sums = lake.claim_lines.groupBy("claim_id").agg(F.count("*").alias("n"), total(F.col("billed_amount")).alias("billed"))
    return lake.claims.select("claim_id").join(sums, "claim_id", "left")


@query("join_left_preagg_max", f"select c.claim_id, p.paid, p.last_payment from claims c left join (select claim_id, {dsum('paid_amount')} as paid, max(payment_date) as last_payment from payments group by 1) p on p.claim_id = c.claim_id")
def join_left_preagg_max(lake: Lake) -> DataFrame:
    sums = lake.payments.groupBy("claim_id").agg(total(F.col("paid_amount")).alias("paid"), F.max("payment_date").alias("last_payment"))
    return lake.claims.select("claim_id").join(sums, "claim_id", "left")


@query("join_left_fact_dim", "select o_orderkey, c_mktsegment from orders left join customer on o_custkey = c_custkey")
def join_left_fact_dim(lake: Lake) -> DataFrame:
    return lake.orders.join(lake.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment")


@query("join_denial_claim", "select d.claim_id, denial_code, cast(total_charge as double) as total_charge from denials d left join claims c on c.claim_id = d.claim_id")
def join_denial_claim(lake: Lake) -> DataFrame:
    return lake.denials.join(lake.claims, "claim_id", "left").select("claim_id", "denial_code", F.col("total_charge").cast("double").alias("total_charge"))


@query("join_fact_provider", "select claim_id, provider_name from claims c left join providers p on p.provider_id = c.provider_id")
def join_fact_provider(lake: Lake) -> DataFrame:
    return lake.claims.join(lake.providers, "provider_id", "left").select("claim_id", "provider_name")


@query("join_fact_payer", "select claim_id, payer_name from claims c left join payers p on p.payer_id = c.payer_id")
def join_fact_payer(lake: Lake) -> DataFrame:
    return lake.claims.join(lake.payers, "payer_id", "left").select("claim_id", "payer_name")


@query("join_line_procedure", "select l.claim_id, l.line_number, l.cpt_code, description from claim_lines l left join procedures p on p.cpt_code = l.cpt_code")
def join_line_procedure(lake: Lake) -> DataFrame:
    return lake.claim_lines.join(lake.procedures.select("cpt_code", "description").dropDuplicates(["cpt_code"]), "cpt_code", "left").select("claim_id", "line_number", "cpt_code", "description")


@query("join_diag_encounter", "select l_orderkey as encounter_id, l_linenumber, o_custkey as patient_id from lineitem left join orders on o_orderkey = l_orderkey")
def join_diag_encounter(lake: Lake) -> DataFrame:
    return lake.lineitem.join(lake.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("l_orderkey").alias("encounter_id"), "l_linenumber", F.col("o_custkey").alias("patient_id"))


@query("join_one_to_many", "select p.patient_id, count(d.icd10_code) as codes from patients p left join diagnoses d on d.patient_id = p.patient_id group by 1")
def join_one_to_many(lake: Lake) -> DataFrame:
    return lake.patients.select("patient_id").join(lake.diagnoses, "patient_id", "left").groupBy("patient_id").agg(F.count("icd10_code").alias("codes"))


@query("join_anti_new", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def join_anti_new(lake: Lake) -> DataFrame:
    return lake.orders.join(lake.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("join_anti_gone", "select distinct user_id from events where user_id not in (select c_custkey from customer where c_custkey % 2 = 0)")
def join_anti_gone(lake: Lake) -> DataFrame:
    return lake.events.select("user_id").distinct().join(lake.customer.where("c_custkey % 2 = 0"), F.col("user_id") == F.col("c_custkey"), "left_anti")


@query("join_inner_changed", "select a.c_custkey from customer a join customer b on a.c_custkey = b.c_custkey where md5(a.c_mktsegment) <> md5(case when b.c_custkey % 3 = 0 then 'NEW' else b.c_mktsegment end)")
def join_inner_changed(lake: Lake) -> DataFrame:
    new = lake.customer.select("c_custkey", F.md5(F.when(F.col("c_custkey") % 3 == 0, "NEW").otherwise(F.col("c_mktsegment"))).alias("new"))
    return lake.customer.select("c_custkey", F.md5("c_mktsegment").alias("old")).join(new, "c_custkey").where("old <> new").select("c_custkey")


TOP = "select l_partkey from lineitem group by 1 order by count(*) desc, l_partkey limit 10"


@query("join_semi_topk", f"select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey in ({TOP})")
def join_semi_topk(lake: Lake) -> DataFrame:
    top = rows.top_k(lake.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")), "n", 10, "l_partkey")
    return lake.lineitem.join(F.broadcast(top), "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("join_agg_agg", "select a.service_type, a.n, b.days from (select service_type, count(*) as n from authorizations group by 1) a left join (select service_type, cast(sum(decision_date - request_date) as bigint) as days from authorizations where decision_date is not null group by 1) b on a.service_type = b.service_type")
def join_agg_agg(lake: Lake) -> DataFrame:
    days = F.datediff("decision_date", "request_date")
    return lake.authorizations.groupBy("service_type").agg(F.count("*").alias("n"), F.sum(days).alias("days"))


RETURNED = "sum(case when l_returnflag = 'R' then 1 else 0 end)"


@query("join_ratio_lookup", f"select l_partkey, {pct(RETURNED, 'count(*)')} as returned_pct from lineitem group by 1")
def join_ratio_lookup(lake: Lake) -> DataFrame:
    from quern.functions.scalars import safe_pct

    return lake.lineitem.groupBy("l_partkey").agg(safe_pct(F.count_if(F.col("l_returnflag") == "R"), F.count("*")).alias("returned_pct"))


# Load modes, on slices of customer: the base, and a batch of changed and new rows.
BASE = "base as (select c_custkey, c_name, c_mktsegment, c_acctbal from customer where c_custkey % 10 < 8)"
BATCH = "batch as (select c_custkey, c_name, case when c_custkey % 10 between 5 and 7 then 'NEW' else c_mktsegment end as c_mktsegment, c_acctbal from customer where c_custkey % 10 >= 5)"


def base(lake: Lake) -> DataFrame:
    return lake.customer.where("c_custkey % 10 < 8").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


def batch(lake: Lake) -> DataFrame:
    rows_ = lake.customer.where("c_custkey % 10 >= 5")
    return rows_.withColumn("c_mktsegment", F.when((F.col("c_custkey") % 10).between(5, 7), "NEW").otherwise(F.col("c_mktsegment"))).select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


def hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("_row_hash", rows.row_hash(df))


@query("cdc_upsert", f"with {BASE}, {BATCH} select * from batch union all select * from base where c_custkey not in (select c_custkey from batch)")
def cdc_upsert(lake: Lake) -> DataFrame:
    return merge.upsert(base(lake), batch(lake), ["c_custkey"])


@query("merge_join", f"with {BASE}, {BATCH} select coalesce(b.c_custkey, t.c_custkey) as c_custkey, case when t.c_custkey is null then 'insert' when b.c_custkey is null then 'keep' else 'update' end as action from base t full join batch b on t.c_custkey = b.c_custkey")
def merge_join(lake: Lake) -> DataFrame:
    t, b = base(lake).select("c_custkey", F.lit(1).alias("t")), batch(lake).select("c_custkey", F.lit(1).alias("b"))
    return t.join(b, "c_custkey", "full_outer").select("c_custkey", F.when(F.col("t").isNull(), "insert").when(F.col("b").isNull(), "keep").otherwise("update").alias("action"))


@query("cdc_soft_delete", f"with {BASE} select *, c_custkey % 10 = 0 as _is_deleted from base")
def cdc_soft_delete(lake: Lake) -> DataFrame:
    return merge.soft_delete(base(lake), lake.customer.where("c_custkey % 10 = 0"), ["c_custkey"])


@query("window_replace", "select event_id, ts, value from events where ts <= timestamp '2024-01-20' union all select event_id, ts, value + 1000 from events where ts > timestamp '2024-01-20' and event_id % 2 = 0")
def window_replace(lake: Lake) -> DataFrame:
    e = lake.events.select("event_id", "ts", "value")
    return merge.window_replace(e, e.where("event_id % 2 = 0").withColumn("value", F.col("value") + 1000), "ts", F.lit("2024-01-20").cast("timestamp_ntz"))


SCD = f"with {BASE}, {BATCH}, t as (select *, date '2020-01-01' as _effective_from, date '9999-12-31' as _effective_to, true as _is_current from base)"
CHANGED = "select t.c_custkey from t join batch b on t.c_custkey = b.c_custkey where t.c_mktsegment is distinct from b.c_mktsegment"


@query("scd2_expire", f"{SCD} select t.* from t where c_custkey in ({CHANGED})")
def scd2_expire(lake: Lake) -> DataFrame:
    return merge.scd2_expired(merge.scd2_init(base(lake), "2020-01-01"), batch(lake), ["c_custkey"], ["c_mktsegment"])


@query("scd2_insert", f"{SCD} select c_custkey, c_mktsegment from batch where c_custkey not in (select c_custkey from t) or c_custkey in ({CHANGED})")
def scd2_insert(lake: Lake) -> DataFrame:
    merged = merge.scd2_merge(merge.scd2_init(base(lake), "2020-01-01"), batch(lake), ["c_custkey"], ["c_mktsegment"], "2021-06-30")
    return merged.where("_effective_from = date '2021-06-30'").select("c_custkey", "c_mktsegment")


@query("scd2_merge", f"""{SCD}, x as ({CHANGED}) select c_custkey, c_name, c_mktsegment, c_acctbal, _effective_from, case when c_custkey in (select c_custkey from x) then date '2021-06-30' else _effective_to end as _effective_to, c_custkey not in (select c_custkey from x) as _is_current from t
  union all select *, date '2021-06-30', date '9999-12-31', true from batch where c_custkey not in (select c_custkey from t) or c_custkey in (select c_custkey from x)""")
def scd2_merge(lake: Lake) -> DataFrame:
    return merge.scd2_merge(merge.scd2_init(base(lake), "2020-01-01"), batch(lake), ["c_custkey"], ["c_mktsegment"], "2021-06-30")


CLASS = f"with {BASE}, {BATCH} select coalesce(t.c_custkey, b.c_custkey) as c_custkey, case when t.c_custkey is null then 'I' when b.c_custkey is null then 'D' when t.c_mktsegment <> b.c_mktsegment then 'U' else 'N' end as change from base t full join batch b on t.c_custkey = b.c_custkey"


def classes(lake: Lake) -> DataFrame:
    return merge.fdc_classes(hashed(base(lake)), hashed(batch(lake)), ["c_custkey"])


@query("fdc_new", f"select c_custkey from ({CLASS}) where change = 'I'")
def fdc_new(lake: Lake) -> DataFrame:
    return classes(lake).where("change = 'I'").select("c_custkey")


@query("fdc_changed", f"select c_custkey from ({CLASS}) where change = 'U'")
def fdc_changed(lake: Lake) -> DataFrame:
    return classes(lake).where("change = 'U'").select("c_custkey")


@query("fdc_deleted", f"select c_custkey from ({CLASS}) where change = 'D'")
def fdc_deleted(lake: Lake) -> DataFrame:
    return classes(lake).where("change = 'D'").select("c_custkey")


@query("fdc_merge", f"with {BASE}, {BATCH} select coalesce(b.c_custkey, t.c_custkey) as c_custkey, coalesce(b.c_mktsegment, t.c_mktsegment) as c_mktsegment, b.c_custkey is null as _is_deleted from base t full join batch b on t.c_custkey = b.c_custkey")
def fdc_merge(lake: Lake) -> DataFrame:
    return merge.fdc_merge(hashed(base(lake)), hashed(batch(lake)), ["c_custkey"]).select("c_custkey", "c_mktsegment", "_is_deleted")


@query("dq_diff_report", """select 'c_mktsegment' as column_name, 0::bigint as nulls_before, count(case when c_custkey % 13 = 0 then 1 end) as nulls_after, count(case when c_custkey % 13 = 0 or (c_custkey % 3 = 0 and c_mktsegment <> 'NEW') then 1 end) as changed from customer
  union all select 'c_acctbal', 0, 0, count(case when c_custkey % 4 = 0 then 1 end) from customer""")
def dq_diff_report(lake: Lake) -> DataFrame:
    k = F.col("c_custkey")
    after = lake.customer.withColumns({"c_mktsegment": F.when(k % 13 == 0, None).when(k % 3 == 0, "NEW").otherwise(F.col("c_mktsegment")), "c_acctbal": F.when(k % 4 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))})
    return dq.diff_report(lake.customer, after, "c_custkey", ["c_mktsegment", "c_acctbal"])



