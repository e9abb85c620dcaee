"""Store, jobs, monitoring and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.adapters import Lake, view
from quern.operators import monitor
from quern.plans.jobs import KPIS, Pipeline, register_kpi
from quern.plans.upkeep import Groups
from quern.queries.base import pct, query
from quern.schema import TableSpec, between
from quern.sources.scratch import new_folder
from quern.sources.store import SnapshotStore, dispatch_write
from quern.streaming import jobs


@view("audit", """select case when user_id % 2 = 0 then 'bronze' else 'silver' end as layer, 'table_' || cast(user_id % 20 as varchar) as table_name, 'FULL' as mode, case event_type when 'error' then 'ERROR' when 'view' then 'SKIP' else 'OK' end as status,
  cast(floor(value) as bigint) * 10 as input_rows, cast(floor(value) as bigint) * case event_id % 4 when 0 then 5 when 1 then 0 else 10 end as output_rows, cast(floor(value) as bigint) * cast(event_id % 3 as int) as dq_flagged,
  case when event_id % 7 <> 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') else 'unknown' end as last_watermark, ts as logged_at from events""")
def audit(lake: Lake) -> DataFrame:
    """An audit table made of events: a run for each."""
    k, n = F.col("event_id"), F.floor("value")
    return lake.events.select(
        F.when(F.col("user_id") % 2 == 0, "bronze").otherwise("silver").alias("layer"), F.concat(F.lit("table_"), (F.col("user_id") % 20).cast("string")).alias("table_name"), F.lit("FULL").alias("mode"), F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "SKIP").otherwise("OK").alias("status"),
        (n * 10).alias("input_rows"), (n * F.when(k % 4 == 0, 5).when(k % 4 == 1, 0).otherwise(10)).alias("output_rows"), (n * (k % 3)).alias("dq_flagged"),
        F.when(k % 7 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("unknown").alias("last_watermark"), F.col("ts").alias("logged_at"),
    )


LATEST = "latest as (select * from (select *, row_number() over (partition by layer, table_name order by logged_at desc, output_rows desc) as n from audit) where n = 1)"
DQ, DROP = pct("dq_flagged", "input_rows"), pct("input_rows - output_rows", "input_rows")
AGE = "floor(date_diff('second', try_cast(last_watermark as timestamp), timestamp '2024-02-01') / 60.0::double) / 60.0::double"


def alert(name: str, value: str, when: str) -> str:
    return f"select layer, table_name, '{name}' as check_name, cast({value} as double) as value from latest where {when}"


ALERTS = {"dq_rate": alert("dq_rate", DQ, f"{DQ} > 10"), "row_drop": alert("row_drop", DROP, f"{DROP} > 10"), "stale_watermark": alert("stale_watermark", AGE, f"{AGE} > 26"), "zero_rows": alert("zero_rows", "output_rows", "output_rows = 0")}


@query("scan_audit", f"with {LATEST} select layer, table_name, status, input_rows, output_rows, logged_at from latest")
def scan_audit(lake: Lake) -> DataFrame:
    return monitor.latest_runs(lake.audit).select("layer", "table_name", "status", "input_rows", "output_rows", "logged_at")


@query("write_audit", "select layer, table_name, output_rows, logged_at from (select *, row_number() over (partition by layer, table_name order by logged_at desc, output_rows desc) as n from audit) where n <= 50")
def write_audit(lake: Lake) -> DataFrame:
    store = SnapshotStore(lake.spark, new_folder(lake.spark, "audit"))
    store.append("audit", lake.audit.where("status <> 'OK'"))
    store.append("audit", lake.audit.where("status = 'OK'"))
    return monitor.last_runs(store.read("audit"), 50).select("layer", "table_name", "output_rows", "logged_at")


@query("write_watermark", "select layer, table_name, arg_max(last_watermark, (logged_at, last_watermark)) as last_watermark from audit where last_watermark is not null group by 1, 2")
def write_watermark(lake: Lake) -> DataFrame:
    return monitor.watermarks(lake.audit)


@query("read_watermark", "select table_name, max(logged_at) as logged_at from audit where status = 'OK' and last_watermark is not null group by 1")
def read_watermark(lake: Lake) -> DataFrame:
    store = SnapshotStore(lake.spark, new_folder(lake.spark, "audit"))
    store.append("audit", lake.audit.where("status = 'OK'"))
    return store.read("audit").where("last_watermark is not null").groupBy("table_name").agg(F.max("logged_at").alias("logged_at"))


@query("check_dq_rate", f"with {LATEST} {ALERTS['dq_rate']}")
def check_dq_rate(lake: Lake) -> DataFrame:
    return monitor.check_dq_rate(lake.audit)


@query("check_row_drop", f"with {LATEST} {ALERTS['row_drop']}")
def check_row_drop(lake: Lake) -> DataFrame:
    return monitor.check_row_drop(lake.audit)


@query("check_stale_watermark", f"with {LATEST} {ALERTS['stale_watermark']}")
def check_stale_watermark(lake: Lake) -> DataFrame:
    return monitor.check_stale_watermark(lake.audit, "2024-02-01 00:00:00")


@query("check_zero_rows", f"with {LATEST} {ALERTS['zero_rows']}")
def check_zero_rows(lake: Lake) -> DataFrame:
    return monitor.check_zero_rows(lake.audit)


@query("check_null_pk", "with k as (select case when adjudication_date is not null then claim_id end as claim_id from claims) select 'silver' as layer, 'claims' as table_name, 'null_keys' as check_name, cast(count(*) as double) as value from k where claim_id is null having count(*) > 0")
def check_null_pk(lake: Lake) -> DataFrame:
    """The key of claims that are not decided yet is missing."""
    keys = lake.claims.select(F.when(F.col("adjudication_date").isNotNull(), F.col("claim_id")).alias("claim_id"))
    return monitor.check_null_keys(keys, "claim_id", "silver", "claims")


@query("dq_report", f"with {LATEST} {' union all '.join(ALERTS.values())}")
def dq_report(lake: Lake) -> DataFrame:
    return monitor.dq_report(lake.audit, "2024-02-01 00:00:00")


@query("run_summary", f"with {LATEST} select layer, status, count(*) as tables, cast(sum(input_rows) as bigint) as rows_in, cast(sum(output_rows) as bigint) as rows_out, cast(sum(dq_flagged) as bigint) as flagged from latest group by 1, 2")
def run_summary(lake: Lake) -> DataFrame:
    return monitor.run_summary(lake.audit)


@query("run_stats", "select layer, table_name, count(*) as runs, cast(sum(input_rows - output_rows) as bigint) as dropped from audit group by 1, 2")
def run_stats(lake: Lake) -> DataFrame:
    return lake.audit.groupBy("layer", "table_name").agg(F.count("*").alias("runs"), F.sum(F.col("input_rows") - F.col("output_rows")).alias("dropped"))


def store_of(lake: Lake) -> SnapshotStore:
    return SnapshotStore(lake.spark, new_folder(lake.spark, "store"))


@query("write_full", "select * from part")
def write_full(lake: Lake) -> DataFrame:
    store = store_of(lake)
    store.write("part", lake.part.limit(0))
    store.write("part", lake.part)
    return store.read("part")


@query("write_append", "select c_custkey, c_name from customer")
def write_append(lake: Lake) -> DataFrame:
    store, rows = store_of(lake), lake.customer.select("c_custkey", "c_name")
    store.append("customer", rows.where("c_custkey % 2 = 0"))
    store.append("customer", rows.where("c_custkey % 2 = 1"))
    return store.read("customer")


@query("partitioned_write", "select o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m') as year_month from orders")
def partitioned_write(lake: Lake) -> DataFrame:
    store = store_of(lake)
    rows = lake.orders.select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM").alias("year_month"))
    store.write("orders", rows.repartition("year_month"), ("year_month",))
    return store.read("orders").withColumn("year_month", F.col("year_month").cast("string"))


@query("scan_layer_table", "select * from supplier")
def scan_layer_table(lake: Lake) -> DataFrame:
    store = store_of(lake)
    assert store.read("supplier") is None
    store.write("supplier", lake.supplier)
    return store.read("supplier")


CUSTOMERS = TableSpec("customer", "c_custkey", mode="CDC", tracked=("c_mktsegment",))


@query("dispatch_write", "select c_custkey, case when c_custkey % 3 = 0 then 'NEW' else c_mktsegment end as c_mktsegment from customer")
def dispatch(lake: Lake) -> DataFrame:
    store, rows = store_of(lake), lake.customer.select("c_custkey", "c_mktsegment")
    dispatch_write(store, CUSTOMERS, rows.where("c_custkey % 2 = 0"), "FULL", as_of="2024-01-31")
    dispatch_write(store, CUSTOMERS, rows.where("c_custkey % 2 = 1"), "INCREMENTAL", as_of="2024-01-31")
    dispatch_write(store, CUSTOMERS, rows.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("NEW")), "CDC", as_of="2024-01-31")
    return store.read("customer")


@query("append_evolved", "select c_custkey::double as c_custkey, c_name, case when c_custkey % 2 = 1 then c_mktsegment end as c_mktsegment, case when c_custkey % 2 = 0 then c_acctbal end as c_acctbal from customer")
def append_evolved(lake: Lake) -> DataFrame:
    """Two appends with different columns and a wider type of the key."""
    store = store_of(lake)
    store.append("customer", lake.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_acctbal"))
    store.append("customer", lake.customer.where("c_custkey % 2 = 1").select(F.col("c_custkey").cast("double").alias("c_custkey"), "c_name", "c_mktsegment"))
    return store.read("customer", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])


@query("upsert_bucketed", "select o_orderkey, case when o_orderkey % 50 = 1 then 'X' else o_orderstatus end as o_orderstatus, o_orderkey % 50 = 2 as _is_deleted from orders")
def upsert_bucketed(lake: Lake) -> DataFrame:
    """A table in buckets of its key: a batch of changed and one of deleted keys."""
    store, spec, rows = store_of(lake), TableSpec("orders", "o_orderkey", mode="CDC", buckets=16), lake.orders.select("o_orderkey", "o_orderstatus")
    dispatch_write(store, spec, rows, "FULL", as_of="2024-01-31")
    dispatch_write(store, spec, rows.where("o_orderkey % 50 = 1").withColumn("o_orderstatus", F.lit("X")), "CDC", as_of="2024-01-31", gone=rows.where("o_orderkey % 50 = 2"))
    return store.read("orders", ["o_orderkey", "o_orderstatus", "_is_deleted"])


@query("window_by_month", "select o_orderkey, o_orderdate, case when cast(o_orderdate as date) > date '2001-07-02' then 'new' else 'old' end as load from orders where cast(o_orderdate as date) <= date '2001-07-02' or o_orderkey % 2 = 0")
def window_by_month(lake: Lake) -> DataFrame:
    """The last 60 days replaced in a table by month: earlier months are neither read nor written."""
    store, spec, rows = store_of(lake), TableSpec("orders", "o_orderkey", "o_orderdate", "WINDOW", 60, by_month=True), lake.orders.select("o_orderkey", "o_orderdate")
    dispatch_write(store, spec, rows.withColumn("load", F.lit("old")), "FULL", as_of="2001-08-31")
    before = store.snapshot("orders").parts
    dispatch_write(store, spec, rows.where("o_orderkey % 2 = 0").withColumn("load", F.lit("new")), "WINDOW", as_of="2001-08-31")
    assert all(v == before[k] for k, v in store.snapshot("orders").parts.items() if k < "_month=2001-07")
    return store.read("orders", ["o_orderkey", "o_orderdate", "load"])


@query("merge_counts", "select 'CDC' as mode, count(*) filter (c_custkey % 3 = 0 and c_custkey % 2 = 1) as inserted, count(*) filter (c_custkey % 6 = 0) as updated, count(*) filter (c_custkey % 10 = 2 and c_custkey % 3 <> 0) as deleted from customer")
def merge_counts(lake: Lake) -> DataFrame:
    """How many rows a merge inserts, updates and deletes, counted while it is written."""
    store, rows = store_of(lake), lake.customer.select("c_custkey", "c_mktsegment")
    dispatch_write(store, CUSTOMERS, rows.where("c_custkey % 2 = 0"), "FULL", as_of="2024-01-31")
    done = dispatch_write(store, CUSTOMERS, rows.where("c_custkey % 3 = 0"), "CDC", as_of="2024-01-31", gone=rows.where("c_custkey % 10 = 2 and c_custkey % 3 <> 0"))
    return lake.spark.createDataFrame([("CDC", done.inserted, done.updated, done.deleted)], "mode string, inserted long, updated long, deleted long")


@query("scan_csv_all_string", "select cast(c_custkey as varchar) as c_custkey, c_name || chr(10) || '\"x\"' as c_name from customer")
def scan_csv_all_string(lake: Lake) -> DataFrame:
    from quern.sources.files import scan_csv_all_string as scan

    path = new_folder(lake.spark, "csv")
    lake.customer.select("c_custkey", F.concat("c_name", F.lit('\n"x"')).alias("c_name")).write.options(header=True, escape='"').csv(path)
    return scan(lake.spark, path)


@query("scan_mixed_folder", "select cast(c_custkey as varchar) as key, c_name as name, 'raw' as _source from customer union all select cast(s_suppkey as varchar), s_name, 'raw' from supplier")
def scan_mixed_folder(lake: Lake) -> DataFrame:
    from quern.sources.files import scan_mixed_folder as scan

    path = new_folder(lake.spark, "mixed")
    lake.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).write.parquet(path)
    lake.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")).write.mode("append").option("header", True).csv(path)
    return scan(lake.spark, path, "raw")


EVENTS = TableSpec("events", "event_id", "ts", casts={"value": "double"}, rules=(between("value", 0, 100),))


def events_by_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if("_dq_flag").alias("flagged"))


if "events_by_day" not in KPIS:
    register_kpi("events_by_day", events_by_day, ("events",), groups=Groups(("day",), {"events": ("to_date(ts)",)}))


def pipeline(lake: Lake) -> Pipeline:
    return Pipeline(lake.spark, new_folder(lake.spark, "layers"), "2024-01-31")


def source(lake: Lake) -> DataFrame:
    return lake.events.select("event_id", "ts", "event_type", "value")


@query("ingest_table", "select cast(event_id as varchar) as event_id, event_type, 'events' as _bronze_table from events where ts <= timestamp '2024-01-15' union all select cast(event_id as varchar), event_type, 'events' from events where ts > timestamp '2024-01-15'")
def ingest_table(lake: Lake) -> DataFrame:
    p = pipeline(lake)
    p.ingest_table(EVENTS, source(lake).where("ts <= timestamp_ntz '2024-01-15'"))
    p.ingest_table(EVENTS, source(lake), "INCREMENTAL")
    return p.stores["bronze"].read("events", ["event_id", "event_type", "_bronze_table"])


@query("process_table", "select cast(event_id as varchar) as event_id, event_type, value, value not between 0 and 100 as _dq_flag, case when value not between 0 and 100 then 'value_out_of_range' end as _dq_issues from events")
def process_table(lake: Lake) -> DataFrame:
    p = pipeline(lake)
    p.ingest_table(EVENTS, source(lake))
    p.process_table(EVENTS, "FULL")
    return p.stores["silver"].read("events", ["event_id", "event_type", "value", "_dq_flag", "_dq_issues"])


BY_DAY = "select cast(ts as date) as day, count(*) as n, count(case when value > 100 then 1 end) as flagged from events group by 1"


@query("process_gold_table", BY_DAY)
def process_gold_table(lake: Lake) -> DataFrame:
    p = pipeline(lake)
    p.run_layers({EVENTS: source(lake)}, ["events_by_day"])
    return p.stores["gold"].read("events_by_day", ["day", "n", "flagged"])


@query("gold_incremental", BY_DAY)
def gold_incremental(lake: Lake) -> DataFrame:
    """A batch of late and new events goes through all layers; gold computes the days that it touches."""
    p = pipeline(lake)
    p.run_layers({EVENTS: source(lake).where("event_id % 5 <> 0 and ts <= timestamp_ntz '2024-01-20'")}, ["events_by_day"])
    done = p.run_layers({EVENTS: source(lake)}, ["events_by_day"], "CDC", {"bronze": "FULL"})
    assert done[-1]["mode"] == "CDC"
    return p.stores["gold"].read("events_by_day", ["day", "n", "flagged"])


@query("run_layers", "select 'bronze' as layer, 'OK' as status, count(*) as rows_out from events union all select 'silver', 'OK', count(*) from events union all select 'gold', 'OK', count(distinct cast(ts as date)) from events")
def run_layers(lake: Lake) -> DataFrame:
    p = pipeline(lake)
    p.run_layers({EVENTS: source(lake)}, ["events_by_day"])
    return monitor.run_summary(p.audit()).select("layer", "status", "rows_out")


@query("backfill_window", BY_DAY)
def backfill_window(lake: Lake) -> DataFrame:
    p = pipeline(lake)
    p.run_layers({EVENTS: source(lake).where("event_id % 2 = 0 or ts <= timestamp_ntz '2024-01-01'")}, ["events_by_day"])
    p.backfill_window({EVENTS: source(lake)}, ["events_by_day"])
    return p.stores["gold"].read("events_by_day", ["day", "n", "flagged"])


def stream(lake: Lake, event_time: str | None = None) -> DataFrame:
    return jobs.read_stream(lake.spark, f"{lake.folder}/events.parquet", event_time)


@query("stream_bronze_incremental", "select event_id, event_type, value, 'events' as _bronze_table from events")
def stream_bronze_incremental(lake: Lake) -> DataFrame:
    target = new_folder(lake.spark, "stream")
    jobs.append_bronze(stream(lake), "events", f"{target}/rows", f"{target}/state")
    jobs.append_bronze(stream(lake), "events", f"{target}/rows", f"{target}/state")  # nothing new, so nothing is added
    return lake.spark.read.parquet(f"{target}/rows").select("event_id", "event_type", "value", "_bronze_table")


@query("stream_dedup", "select event_id, event_type from events")
def stream_dedup(lake: Lake) -> DataFrame:
    target = new_folder(lake.spark, "stream")
    twice = stream(lake, "ts").union(stream(lake, "ts"))
    out = jobs.deduplicated(twice, ["event_id"]).select("event_id", "event_type")
    out.writeStream.format("parquet").option("checkpointLocation", f"{target}/state").option("path", f"{target}/rows").trigger(availableNow=True).start().awaitTermination()
    return lake.spark.read.parquet(f"{target}/rows")


@query("stream_upsert", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, value desc, event_id desc) as n from events) where n = 1")
def stream_upsert(lake: Lake) -> DataFrame:
    root = new_folder(lake.spark, "stream")
    store = SnapshotStore(lake.spark, root)
    jobs.upsert_stream(stream(lake).select("user_id", "ts", "value", "event_id"), store, TableSpec("users", "user_id", "ts", buckets=8), f"{root}/state")
    return store.read("users", ["user_id", "event_id", "value"])


@query("stream_kpi_window", "select date_trunc('day', ts)::date as day, event_type, count(*) as n, cast(sum(cast(value as decimal(12,2))) as double) as total from events group by 1, 2")
def stream_kpi_window(lake: Lake) -> DataFrame:
    root = new_folder(lake.spark, "stream")
    store = SnapshotStore(lake.spark, root)
    counts = jobs.windowed_counts(stream(lake, "ts"), "ts", "1 day", ["event_type"], "value").withColumn("key", F.concat_ws("|", F.col("window_start").cast("string"), "event_type"))
    jobs.upsert_stream(counts, store, TableSpec("daily", "key", buckets=8), f"{root}/state", "update")
    return store.read("daily").select(F.to_date("window_start").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("late_data_report", "select count(case when ts <= timestamp '2024-01-10' then 1 end) as late, 0::bigint as unreadable, count(*) as rows from events")
def late_data_report(lake: Lake) -> DataFrame:
    return jobs.late_rows(lake.events, "ts", "2024-01-10 00:00:00")

