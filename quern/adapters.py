"""Stand-ins: the billing tables that the plans expect, as projections of an order, line item and event schema."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scalars import money
from quern.sources.files import PART_BYTES, input_bytes

AS_OF = "2001-12-31"
NO_BROADCAST = 64 << 20
"""Bytes of a table's files from which a join with it is taken to shuffle both sides."""


class Lake:
    """Base tables by name, and the stand-ins made of them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return VIEWS[name](self) if name in VIEWS else self.spark.read.parquet(f"{self.folder}/{name}.parquet")


VIEWS: dict[str, Callable[[Lake], DataFrame]] = {}
SQL_VIEWS: dict[str, str] = {}
"""The same in DuckDB SQL, as common table expressions."""


def view(name: str, sql: str):
    def add(make: Callable[[Lake], DataFrame]):
        VIEWS[name], SQL_VIEWS[name] = make, sql
        return make

    return add


def dec(c: str, scale: int = 2):
    return F.col(c).cast(f"decimal({10 + scale},{scale})")


@view("claims", """select o_orderkey as claim_id, o_custkey as patient_id, o_orderkey % 10 as provider_id, o_custkey % 5 as payer_id, o_orderkey as encounter_id,
  cast(o_totalprice as decimal(12,2)) as total_charge, cast(o_orderdate as date) as submission_date,
  case when o_orderstatus <> 'P' then cast(cast(o_orderdate as date) + cast(o_orderkey % 60 as int) as date) end as adjudication_date,
  case o_orderstatus when 'F' then 'PAID' when 'O' then 'DENIED' else 'PENDING' end as claim_status, o_orderpriority as claim_type from orders""")
def claims(lake: Lake) -> DataFrame:
    day = F.to_date("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "F", "PAID").when(F.col("o_orderstatus") == "O", "DENIED").otherwise("PENDING")
    return lake.orders.select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("patient_id"), (F.col("o_orderkey") % 10).alias("provider_id"), (F.col("o_custkey") % 5).alias("payer_id"), F.col("o_orderkey").alias("encounter_id"),
        money("o_totalprice").alias("total_charge"), day.alias("submission_date"), F.when(F.col("o_orderstatus") != "P", F.date_add(day, (F.col("o_orderkey") % 60).cast("int"))).alias("adjudication_date"), status.alias("claim_status"), F.col("o_orderpriority").alias("claim_type"),
    )


@view("claim_lines", """select l_orderkey as claim_id, l_linenumber as line_number, l_partkey as cpt_code, l_quantity as units, l_suppkey as facility_id, l_returnflag as remark, l_linestatus as line_status,
  cast(l_extendedprice as decimal(12,2)) as billed_amount, cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as allowed_amount,
  cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) * (1 - cast(l_tax as decimal(4,2))) as paid_amount,
  cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2)) as adjustment_amount,
  cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) - cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) * (1 - cast(l_tax as decimal(4,2))) as patient_responsibility, cast(l_shipdate as date) as service_date from lineitem""")
def claim_lines(lake: Lake) -> DataFrame:
    billed, kept_, after = money("l_extendedprice"), 1 - F.col("l_discount").cast("decimal(4,2)"), 1 - F.col("l_tax").cast("decimal(4,2)")
    return lake.lineitem.select(
        F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("cpt_code"), F.col("l_quantity").alias("units"), F.col("l_suppkey").alias("facility_id"), F.col("l_returnflag").alias("remark"), F.col("l_linestatus").alias("line_status"),
        billed.alias("billed_amount"), (billed * kept_).alias("allowed_amount"), (billed * kept_ * after).alias("paid_amount"), (billed * F.col("l_discount").cast("decimal(4,2)")).alias("adjustment_amount"), (billed * kept_ - billed * kept_ * after).alias("patient_responsibility"), F.to_date("l_shipdate").alias("service_date"),
    )


@view("payments", "select claim_id, paid_amount, service_date as payment_date from claim_lines where line_status = 'F'")
def payments(lake: Lake) -> DataFrame:
    return lake.claim_lines.where("line_status = 'F'").select("claim_id", "paid_amount", F.col("service_date").alias("payment_date"))


@view("encounters", "select o_orderkey as encounter_id, cast(o_orderdate as date) as encounter_date, cast(o_orderkey % 9 as varchar) as place_of_service_code, o_orderpriority as encounter_type from orders")
def encounters(lake: Lake) -> DataFrame:
    return lake.orders.select(F.col("o_orderkey").alias("encounter_id"), F.to_date("o_orderdate").alias("encounter_date"), (F.col("o_orderkey") % 9).cast("string").alias("place_of_service_code"), F.col("o_orderpriority").alias("encounter_type"))


@view("denials", """select claim_id, 'co-' || cast(line_number as varchar) as denial_code, line_status as denial_category, case when line_number % 2 = 0 then 'coding' else 'coverage' end as denial_reason,
  service_date as denial_date, case cast(units as int) % 3 when 0 then 'APPROVED' when 1 then 'NOT APPEALED' else 'IN REVIEW' end as appeal_status from claim_lines where remark = 'R'""")
def denials(lake: Lake) -> DataFrame:
    third = F.col("units").cast("int") % 3
    return lake.claim_lines.where("remark = 'R'").select(
        "claim_id", F.concat(F.lit("co-"), F.col("line_number").cast("string")).alias("denial_code"), F.col("line_status").alias("denial_category"), F.when(F.col("line_number") % 2 == 0, "coding").otherwise("coverage").alias("denial_reason"),
        F.col("service_date").alias("denial_date"), F.when(third == 0, "APPROVED").when(third == 1, "NOT APPEALED").otherwise("IN REVIEW").alias("appeal_status"),
    )


@view("patients", """select c_custkey as patient_id, c_name as name, c_nationkey as clinic_id, c_acctbal as balance, c_mktsegment as segment, cast(c_custkey % 97 as int) as age, case when c_custkey % 2 = 0 then 'F' else 'M' end as gender,
  case c_custkey % 3 when 0 then 'normal' when 1 then 'overweight' else 'obese' end as bmi_category, case when c_custkey % 5 = 0 then 'current' else 'never' end as smoking_status from customer""")
def patients(lake: Lake) -> DataFrame:
    k = F.col("c_custkey")
    return lake.customer.select(k.alias("patient_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("clinic_id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), (k % 97).cast("int").alias("age"), F.when(k % 2 == 0, "F").otherwise("M").alias("gender"),
        F.when(k % 3 == 0, "normal").when(k % 3 == 1, "overweight").otherwise("obese").alias("bmi_category"), F.when(k % 5 == 0, "current").otherwise("never").alias("smoking_status"))


@view("patient_insurance", """select c_custkey as patient_id, cast(c_custkey % 5 as int) as payer_id, c_mktsegment as plan_name, p.priority as insurance_priority, date '2000-01-01' + cast(c_custkey % 30 as int) as effective_date
  from customer cross join (values ('Primary'), ('Secondary')) p(priority) where c_custkey % 7 <> 0""")
def patient_insurance(lake: Lake) -> DataFrame:
    k = F.col("c_custkey")
    rows = lake.customer.where(k % 7 != 0).withColumn("insurance_priority", F.explode(F.array(F.lit("Primary"), F.lit("Secondary"))))
    return rows.select(k.alias("patient_id"), (k % 5).cast("int").alias("payer_id"), F.col("c_mktsegment").alias("plan_name"), "insurance_priority", F.date_add(F.lit("2000-01-01").cast("date"), (k % 30).cast("int")).alias("effective_date"))


@view("providers", "select s_suppkey as provider_id, s_name as provider_name, s_nationkey as clinic_id, s_acctbal as balance, 'specialty ' || cast(s_nationkey % 7 as varchar) as specialty, case when s_suppkey % 2 = 0 then 'MD' else 'NP' end as credential from supplier")
def providers(lake: Lake) -> DataFrame:
    return lake.supplier.select(F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("provider_name"), F.col("s_nationkey").alias("clinic_id"), F.col("s_acctbal").alias("balance"), F.concat(F.lit("specialty "), (F.col("s_nationkey") % 7).cast("string")).alias("specialty"), F.when(F.col("s_suppkey") % 2 == 0, "MD").otherwise("NP").alias("credential"))


@view("clinics", "select s_suppkey as clinic_id, s_name as clinic_name, s_nationkey % 5 as payer_id, case when s_suppkey % 3 = 0 then 'hospital' else 'office' end as clinic_type, case when s_suppkey % 4 = 0 then 'out' else 'in' end as network_status, s_suppkey % 90 * 10 as bed_count from supplier")
def clinics(lake: Lake) -> DataFrame:
    k = F.col("s_suppkey")
    return lake.supplier.select(k.alias("clinic_id"), F.col("s_name").alias("clinic_name"), (F.col("s_nationkey") % 5).alias("payer_id"), F.when(k % 3 == 0, "hospital").otherwise("office").alias("clinic_type"), F.when(k % 4 == 0, "out").otherwise("in").alias("network_status"), (k % 90 * 10).alias("bed_count"))


@view("payers", "select distinct c_nationkey as payer_id, 'payer ' || cast(c_nationkey as varchar) as payer_name, case when c_nationkey % 2 = 0 then 'commercial' else 'public' end as payer_type from customer")
def payers(lake: Lake) -> DataFrame:
    k = F.col("payer_id")
    return lake.customer.select(F.col("c_nationkey").alias("payer_id")).distinct().select(k, F.concat(F.lit("payer "), k.cast("string")).alias("payer_name"), F.when(k % 2 == 0, "commercial").otherwise("public").alias("payer_type"))


@view("procedures", "select p_partkey as cpt_code, p_name as description, p_type as category, cast(p_retailprice as decimal(12,2)) as charge from part")
def procedures(lake: Lake) -> DataFrame:
    return lake.part.select(F.col("p_partkey").alias("cpt_code"), F.col("p_name").alias("description"), F.col("p_type").alias("category"), money("p_retailprice").alias("charge"))


@view("diagnoses", """select o_custkey as patient_id, l_orderkey as encounter_id, p_brand as icd10_code, p_name as diagnosis_description, p_type = 'PROMO' as chronic_flag, case when l_linenumber = 1 then 'PRIMARY' else 'SECONDARY' end as diagnosis_type
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""")
def diagnoses(lake: Lake) -> DataFrame:
    lines, heads = lake.lineitem, lake.orders
    if input_bytes(heads) > NO_BROADCAST:  # both are sorted then, in parts whose number grows with the input
        parts = math.ceil(input_bytes(lines) / PART_BYTES)
        lines, heads = lines.repartition(parts, "l_orderkey"), heads.repartition(parts, "o_orderkey")
    rows = lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey")).join(lake.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("o_custkey").alias("patient_id"), F.col("l_orderkey").alias("encounter_id"), F.col("p_brand").alias("icd10_code"), F.col("p_name").alias("diagnosis_description"), (F.col("p_type") == "PROMO").alias("chronic_flag"), F.when(F.col("l_linenumber") == 1, "PRIMARY").otherwise("SECONDARY").alias("diagnosis_type"))


@view("appointments", """select event_id as appointment_id, user_id as patient_id, event_type as appointment_type, cast(ts as date) as appointment_date, cast(trunc(value) as int) as duration_minutes,
  case event_id % 5 when 0 then 'CANCELLED' when 1 then 'NO SHOW' when 2 then 'SCHEDULED' else 'COMPLETED' end as appointment_status from events""")
def appointments(lake: Lake) -> DataFrame:
    k = F.col("event_id") % 5
    status = F.when(k == 0, "CANCELLED").when(k == 1, "NO SHOW").when(k == 2, "SCHEDULED").otherwise("COMPLETED")
    return lake.events.select(F.col("event_id").alias("appointment_id"), F.col("user_id").alias("patient_id"), F.col("event_type").alias("appointment_type"), F.to_date("ts").alias("appointment_date"), F.col("value").cast("int").alias("duration_minutes"), status.alias("appointment_status"))


@view("labs", """select event_id as lab_id, user_id as patient_id, event_type as test_name, upper(substr(event_type, 1, 3)) as loinc_code, cast(value as decimal(12,2)) as result_value, cast(ts as date) as result_date,
  case when value < 16 then 'Critical Low' when value < 20 then 'Low' when value <= 80 then 'Normal' when value <= 96 then 'High' else 'Critical High' end as abnormal_flag from events""")
def labs(lake: Lake) -> DataFrame:
    v = F.col("value")
    return lake.events.select(F.col("event_id").alias("lab_id"), F.col("user_id").alias("patient_id"), F.col("event_type").alias("test_name"), F.upper(F.substring("event_type", 1, 3)).alias("loinc_code"), money("value").alias("result_value"), F.to_date("ts").alias("result_date"), abnormal_flag(v, F.lit(20), F.lit(80)).alias("abnormal_flag"))


def abnormal_flag(value, low, high):
    """Critical below 0.8 of the low or above 1.2 of the high limit."""
    return F.when(value < low * 0.8, "Critical Low").when(value < low, "Low").when(value <= high, "Normal").when(value <= high * 1.2, "High").otherwise("Critical High")


@view("authorizations", """select o_orderkey as auth_id, o_custkey % 50 as payer_id, o_orderpriority as service_type, cast(o_orderdate as date) as request_date,
  case when o_orderstatus <> 'P' then cast(cast(o_orderdate as date) + cast(o_orderkey % 75 as int) as date) end as decision_date, case o_orderstatus when 'F' then 'APPROVED' when 'O' then 'DENIED' else 'PENDING' end as status,
  case when o_orderkey % 3 = 0 then 'urgent' else 'routine' end as urgency from orders""")
def authorizations(lake: Lake) -> DataFrame:
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "O", "DENIED").otherwise("PENDING")
    return lake.orders.select(k.alias("auth_id"), (F.col("o_custkey") % 50).alias("payer_id"), F.col("o_orderpriority").alias("service_type"), day.alias("request_date"), F.when(F.col("o_orderstatus") != "P", F.date_add(day, (k % 75).cast("int"))).alias("decision_date"), status.alias("status"), F.when(k % 3 == 0, "urgent").otherwise("routine").alias("urgency"))


@view("vitals", """select event_id as vital_id, cast(60 + value as double) as systolic_bp, cast(40 + value / 2 as double) as diastolic_bp, value as heart_rate, cast(event_id % 50 + 15 as double) as bmi,
  cast(event_id % 30 + 50 as double) as height_inches, cast(event_id % 200 + 100 as double) as weight_lbs from events""")
def vitals(lake: Lake) -> DataFrame:
    k, v = F.col("event_id"), F.col("value")
    return lake.events.select(k.alias("vital_id"), (v + 60).alias("systolic_bp"), (v / 2 + 40).alias("diastolic_bp"), v.alias("heart_rate"), (k % 50 + 15).cast("double").alias("bmi"), (k % 30 + 50).cast("double").alias("height_inches"), (k % 200 + 100).cast("double").alias("weight_lbs"))
