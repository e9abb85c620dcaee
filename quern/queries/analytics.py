"""Aggregations, windows, ordering and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.adapters import Lake
from quern.functions.scalars import aging_bucket, bins, bucket, by_rules, mean, money, round2, safe_pct, total, year_month
from quern.operators import rows, sketches
from quern.operators.quantiles import exact_quantiles
from quern.queries.base import dsum, pct, query, r2

PRICE = "cast(l_extendedprice as decimal(12,2))"


@query("agg_basic", f"select l_returnflag, {dsum(PRICE)} as total, {r2(dsum(PRICE) + ' / count(*)')} as average, min(l_extendedprice) as low, max(l_extendedprice) as high, count(*) as n from lineitem group by 1")
def agg_basic(lake: Lake) -> DataFrame:
    p = money("l_extendedprice")
    return lake.lineitem.groupBy("l_returnflag").agg(total(p).alias("total"), round2(mean(p)).alias("average"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.count("*").alias("n"))


@query("agg_conditional_count", "select l_linestatus, count(case when l_returnflag = 'R' then 1 end) as returned, count(case when l_quantity > 25 then 1 end) as large from lineitem group by 1")
def agg_conditional_count(lake: Lake) -> DataFrame:
    return lake.lineitem.groupBy("l_linestatus").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_quantity") > 25).alias("large"))


@query("agg_count_distinct", "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by 1")
def agg_count_distinct(lake: Lake) -> DataFrame:
    return lake.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


FILLED = "count(case when o_orderstatus = 'F' then 1 end)"


@query("agg_safe_pct", f"select o_orderpriority, {pct(FILLED, 'count(*)')} as filled_pct, {pct('count(*)', '0')} as of_nothing from orders group by 1")
def agg_safe_pct(lake: Lake) -> DataFrame:
    return lake.orders.groupBy("o_orderpriority").agg(safe_pct(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("filled_pct"), safe_pct(F.count("*"), F.lit(0)).alias("of_nothing"))


@query("agg_ratio_of_avgs", f"select cpt_code, {pct(dsum('paid_amount') + ' / count(*)', dsum('billed_amount') + ' / count(*)')} as rate from claim_lines group by 1")
def agg_ratio_of_avgs(lake: Lake) -> DataFrame:
    return lake.claim_lines.groupBy("cpt_code").agg(safe_pct(mean(F.col("paid_amount")), mean(F.col("billed_amount"))).alias("rate"))


@query("agg_by_date_part", "select cast(year(o_orderdate) as int) as year, cast(month(o_orderdate) as int) as month, count(*) as n from orders group by 1, 2")
def agg_by_date_part(lake: Lake) -> DataFrame:
    return lake.orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))


@query("agg_by_expr", "select upper(denial_code) as code, count(*) as n from denials group by 1")
def agg_by_expr(lake: Lake) -> DataFrame:
    return lake.denials.groupBy(F.upper("denial_code").alias("code")).agg(F.count("*").alias("n"))


@query("agg_first", "select test_name, max(loinc_code) as loinc_code, count(*) as n from labs group by 1")
def agg_first(lake: Lake) -> DataFrame:
    return lake.labs.groupBy("test_name").agg(F.max("loinc_code").alias("loinc_code"), F.count("*").alias("n"))


@query("agg_global", f"select count(*) as n, {dsum(PRICE)} as total, count(distinct l_orderkey) as orders from lineitem")
def agg_global(lake: Lake) -> DataFrame:
    return lake.lineitem.agg(F.count("*").alias("n"), total(money("l_extendedprice")).alias("total"), F.count_distinct("l_orderkey").alias("orders"))


@query("agg_value_counts", "select upper(substr(event_type, 1, 1)) || substr(event_type, 2) as kind, count(*) as n from events group by 1 order by n desc, kind limit 3")
def agg_value_counts(lake: Lake) -> DataFrame:
    return rows.top_k(lake.events.groupBy(F.initcap("event_type").alias("kind")).agg(F.count("*").alias("n")), "n", 3, "kind")


@query("agg_having", "select l_suppkey, count(*) as n from lineitem group by 1 having count(*) >= 600 order by n desc, l_suppkey limit 15")
def agg_having(lake: Lake) -> DataFrame:
    return rows.top_k(lake.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n")).where("n >= 600"), "n", 15, "l_suppkey")


@query("agg_rollup_reagg", "select year, sum(n) as n, max(n) as best_month from (select cast(year(o_orderdate) as int) as year, month(o_orderdate) as month, count(*) as n from orders group by 1, 2) group by 1")
def agg_rollup_reagg(lake: Lake) -> DataFrame:
    monthly = lake.orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    return monthly.groupBy("year").agg(F.sum("n").alias("n"), F.max("n").alias("best_month"))


@query("agg_pivot", "select o_orderpriority, " + ", ".join(f"count(case when month(o_orderdate) = {m} then 1 end) as m{m}" for m in range(1, 13)) + " from orders group by 1")
def agg_pivot(lake: Lake) -> DataFrame:
    monthly = lake.orders.withColumn("month", F.month("o_orderdate")).groupBy("o_orderpriority").pivot("month", [*range(1, 13)])
    return monthly.count().na.fill(0).toDF("o_orderpriority", *(f"m{m}" for m in range(1, 13)))


@query("agg_crosstab", "select clinic_type, network_status, count(*) as n from clinics group by 1, 2")
def agg_crosstab(lake: Lake) -> DataFrame:
    return lake.clinics.groupBy("clinic_type", "network_status").agg(F.count("*").alias("n"))


@query("agg_histogram", "select cast(floor(value / 10.0::double) as bigint) as bin, count(*) as n from events group by 1")
def agg_histogram(lake: Lake) -> DataFrame:
    return lake.events.groupBy(bucket(F.col("value"), 0.0, 10.0).alias("bin")).agg(F.count("*").alias("n"))


@query("agg_quartiles", "select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as q2, quantile_cont(value, 0.75) as q3 from events group by 1")
def agg_quartiles(lake: Lake) -> DataFrame:
    return exact_quantiles(lake.events, ["event_type"], "value", [0.25, 0.5, 0.75])


@query("agg_distinct_sketch", "select event_type, count(distinct user_id) as users, true as within from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01' group by 1")
def agg_distinct_sketch(lake: Lake) -> DataFrame:
    """Distinct users of a month from sketches by month, beside the exact count, and whether they agree within the stated error."""
    kept = sketches.monthly(lake.events, ["event_type"], "ts", "user_id")
    found = sketches.distinct_in(kept, ["event_type"], "2024-01", "2024-01")
    month = lake.events.where("ts >= timestamp_ntz '2024-01-01' and ts < timestamp_ntz '2024-02-01'")
    exact = month.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    return exact.join(found, "event_type").select("event_type", "users", (F.abs(F.col("distinct") - F.col("users")) <= sketches.error() * F.col("users")).alias("within"))


@query("agg_bool_mean", "select avg(case when gender = 'F' then 1.0::double else 0 end) as female, avg(case when age >= 65 then 1.0::double else 0 end) as old from patients")
def agg_bool_mean(lake: Lake) -> DataFrame:
    return lake.patients.agg(F.avg((F.col("gender") == "F").cast("double")).alias("female"), F.avg((F.col("age") >= 65).cast("double")).alias("old"))


@query("agg_arg_max", "select arg_max(l_partkey, (n, -l_partkey)) as most_used, max(n) as n from (select l_partkey, count(*) as n from lineitem group by 1)")
def agg_arg_max(lake: Lake) -> DataFrame:
    counts = lake.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("l_partkey", F.struct("n", -F.col("l_partkey"))).alias("most_used"), F.max("n").alias("n"))


@query("win_share_of_total", f"with r as (select r_name, {dsum('cast(c_acctbal as decimal(12,2))')} as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1) select *, {pct('balance', '(select sum(balance) from r)')} as share_pct from r")
def win_share_of_total(lake: Lake) -> DataFrame:
    by = lake.customer.join(lake.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(lake.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(total(money("c_acctbal")).alias("balance"))
    return rows.share_of_total(by, "balance", "share_pct")


@query("win_partition_count", "select lab_id, count(*) over (partition by test_name) as in_test from labs where abnormal_flag <> 'Normal'")
def win_partition_count(lake: Lake) -> DataFrame:
    rows_ = lake.labs.where("abnormal_flag <> 'Normal'").select("lab_id", "test_name")
    return rows_.join(rows_.groupBy("test_name").agg(F.count("*").alias("in_test")), "test_name").select("lab_id", "in_test")


@query("win_share_in_group", f"with r as (select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2) select *, {pct('n', 'sum(n) over (partition by o_orderstatus)')} as share_pct from r")
def win_share_in_group(lake: Lake) -> DataFrame:
    return rows.share_of_total(lake.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")), "n", "share_pct", ["o_orderstatus"])


@query("sort_asc", "select c_name, c_custkey from customer order by c_name, c_custkey")
def sort_asc(lake: Lake) -> DataFrame:
    return lake.customer.select("c_name", "c_custkey").orderBy("c_name", "c_custkey")


@query("sort_desc", "select s_suppkey, s_acctbal from supplier order by s_acctbal desc, s_suppkey")
def sort_desc(lake: Lake) -> DataFrame:
    return lake.supplier.select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey")


@query("topk", "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 15")
def topk(lake: Lake) -> DataFrame:
    return rows.top_k(lake.part.select("p_partkey", "p_retailprice"), "p_retailprice", 15, "p_partkey")


@query("topk_resort", f"select * from (select l_partkey, count(*) as n, {dsum(PRICE)} as billed from lineitem group by 1 order by n desc, l_partkey limit 15) order by billed desc")
def topk_resort(lake: Lake) -> DataFrame:
    by = lake.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), total(money("l_extendedprice")).alias("billed"))
    return rows.top_k(by, "n", 15, "l_partkey").orderBy(F.desc("billed"))


@query("last_n_periods", "select * from (select strftime(o_orderdate, '%Y-%m') as period, count(*) as n from orders group by 1 order by 1 desc limit 36) order by period")
def last_n_periods(lake: Lake) -> DataFrame:
    return lake.orders.groupBy(year_month(F.col("o_orderdate")).alias("period")).agg(F.count("*").alias("n")).orderBy(F.desc("period")).limit(36).orderBy("period")


ORDERED = ["0-30", "31-60", "61-90", "91-120", "120+"]


@query("sort_custom_order", f"with o(place, aging_bucket) as (values {', '.join(f'({i}, {b!r})' for i, b in enumerate(ORDERED))}), a as (select case when days <= 30 then '0-30' when days <= 60 then '31-60' when days <= 90 then '61-90' when days <= 120 then '91-120' else '120+' end as aging_bucket, count(*) as n from (select date '2001-08-31' - submission_date as days from claims) group by 1) select o.place, o.aging_bucket, coalesce(n, 0) as n from o left join a on a.aging_bucket = o.aging_bucket order by place")
def sort_custom_order(lake: Lake) -> DataFrame:
    order = lake.spark.createDataFrame([*enumerate(ORDERED)], "place int, aging_bucket string")
    counts = lake.claims.groupBy(aging_bucket(F.datediff(F.lit("2001-08-31").cast("date"), "submission_date")).alias("aging_bucket")).agg(F.count("*").alias("n"))
    return order.join(counts, "aging_bucket", "left").select("place", "aging_bucket", F.coalesce("n", F.lit(0)).alias("n")).orderBy("place")


@query("fn_string", "select p_partkey, trim(p_name) as t, upper(p_brand) as u, lower(p_type) as l, p_name || '/' || p_brand as c, substr(p_name, 1, 4) as s, contains(p_name, 'ring') as has, starts_with(p_name, 'red') as red, lpad(cast(p_size as varchar), 4, '0') as padded, replace(p_brand, 'Brand#', '') as brand from part")
def fn_string(lake: Lake) -> DataFrame:
    return lake.part.select("p_partkey", F.trim("p_name").alias("t"), F.upper("p_brand").alias("u"), F.lower("p_type").alias("l"), F.concat_ws("/", "p_name", "p_brand").alias("c"), F.substring("p_name", 1, 4).alias("s"), F.col("p_name").contains("ring").alias("has"), F.col("p_name").startswith("red").alias("red"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("brand"))


@query("fn_date", "select o_orderkey, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m, cast(quarter(o_orderdate) as int) as q, strftime(o_orderdate, '%Y-%m') as ym, cast(date '2002-01-01' - cast(o_orderdate as date) as int) as age from orders")
def fn_date(lake: Lake) -> DataFrame:
    d = F.col("o_orderdate")
    return lake.orders.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.quarter(d).alias("q"), year_month(d).alias("ym"), F.datediff(F.lit("2002-01-01").cast("date"), d).alias("age"))


@query("fn_math", f"select l_orderkey, l_linenumber, {r2('l_extendedprice / l_quantity')} as unit, least(l_quantity, 10) as least10, greatest(0, l_quantity - 20) as above20 from lineitem")
def fn_math(lake: Lake) -> DataFrame:
    q = F.col("l_quantity")
    return lake.lineitem.select("l_orderkey", "l_linenumber", round2(F.try_divide(F.col("l_extendedprice"), q)).alias("unit"), F.least(q, F.lit(10.0)).alias("least10"), F.greatest(F.lit(0.0), q - 20).alias("above20"))


@query("fn_conditional", "select vital_id, case when systolic_bp >= 180 then 'Crisis' when systolic_bp >= 140 then 'High' else 'Normal' end as grade from vitals")
def fn_conditional(lake: Lake) -> DataFrame:
    s = F.col("systolic_bp")
    return lake.vitals.select("vital_id", by_rules([(s >= 140, "High"), (s >= 180, "Crisis")], F.lit("Normal")).alias("grade"))


LOOKUP = {"A": "Accepted", "R": "Returned"}


@query("fn_lookup", "select l_orderkey, l_linenumber, case l_returnflag when 'A' then 'Accepted' when 'R' then 'Returned' else 'Other' end as meaning from lineitem")
def fn_lookup(lake: Lake) -> DataFrame:
    codes = F.create_map(*(F.lit(x) for pair in LOOKUP.items() for x in pair))
    return lake.lineitem.select("l_orderkey", "l_linenumber", F.coalesce(F.try_element_at(codes, F.col("l_returnflag")), F.lit("Other")).alias("meaning"))


AGES, AGE_LABELS = [0, 17, 34, 49, 64, 79, 120], ["0-17", "18-34", "35-49", "50-64", "65-79", "80+"]


@query("fn_bucketing", "select patient_id, case when age > 0 and age <= 17 then '0-17' when age > 17 and age <= 34 then '18-34' when age > 34 and age <= 49 then '35-49' when age > 49 and age <= 64 then '50-64' when age > 64 and age <= 79 then '65-79' when age > 79 and age <= 120 then '80+' end as age_group from patients")
def fn_bucketing(lake: Lake) -> DataFrame:
    return lake.patients.select("patient_id", bins(F.col("age"), AGES, AGE_LABELS).alias("age_group"))
