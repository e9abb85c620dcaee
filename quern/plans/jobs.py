"""Layer jobs over one session: ingest, clean, build, and a run of all layers with an audit row for each table."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime
from threading import RLock

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from quern.operators.clean import clean_table, repeated_keys
from quern.operators.monitor import AUDIT, watermarks
from quern.operators.rows import drop_meta, row_hash, stamp, watermark_filter
from quern.plans.upkeep import Groups, kept_up
from quern.schema import MODES, TableSpec
from quern.sources.files import as_strings
from quern.sources.scratch import new_folder, shared_folder, shuffles_deleted
from quern.sources.store import SnapshotStore, dispatch_write

LAYERS = ("bronze", "silver", "gold")
AT_ONCE = 4
"""Tables that are made at the same time."""
UNKNOWN = "max(cast(null as string))"
FEW_KEYS = 500_000
"""So many hashes of 8 bytes are broadcast at most."""


@dataclass(frozen=True)
class Kpi:
    """A gold builder, the silver or gold tables it takes, whether it takes the day to count to, inputs it can do without, and
    how it is kept up by group (None: it is built in full each time)."""

    build: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    dated: bool = False
    optional: tuple[str, ...] = ()
    groups: Groups | None = None


KPIS: dict[str, Kpi] = {}


def register_kpi(name: str, build: Callable[..., DataFrame], inputs: tuple[str, ...], dated: bool = False, optional: tuple[str, ...] = (), groups: Groups | None = None) -> None:
    if name in KPIS:
        raise ValueError(f"{name} is registered already")
    KPIS[name] = Kpi(build, inputs, dated, optional, groups)


def _levels(kpis: list[str]) -> dict[str, int]:
    """What can be built at the same time: a table comes after those before it in the list that it reads or that read it."""
    levels: dict[str, int] = {}
    for x in kpis:
        levels[x] = max((n + 1 for y, n in levels.items() if y in KPIS[x].inputs or x in KPIS[y].inputs), default=0)
    return levels


class Pipeline:
    """Stores of the three layers below a root, and the audit table beside them."""

    def __init__(self, spark, root: str, as_of: str) -> None:
        self.spark, self.as_of = spark, as_of
        self.stores = {layer: SnapshotStore(spark, f"{root}/{layer}") for layer in LAYERS}
        self.audits = SnapshotStore(spark, root)
        self._rows: list[tuple] = []
        self._running = False
        self._lock = RLock()  # one writer of the audit

    def audit(self) -> DataFrame:
        self._write_audit()
        found = self.audits.read("audit")
        return self.spark.createDataFrame([], AUDIT) if found is None else found

    def _log(self, layer: str, table: str, mode: str, rows_in: int, rows_out: int, flagged: int = 0, watermark: str | None = None, status: str = "OK") -> dict:
        row = (layer, table, mode, status, int(rows_in), int(rows_out), flagged, watermark)
        with self._lock:
            self._rows.append((*row, datetime.now(UTC).replace(tzinfo=None)))
            if not self._running:
                self._write_audit()
        return dict(zip(("layer", "table", "mode", "status", "input_rows", "output_rows"), row, strict=False))

    def _write_audit(self) -> None:
        """The rows that wait, in one append: a run of layers writes its audit once."""
        with self._lock:
            if self._rows:
                rows, self._rows = self._rows, []
                self.audits.append("audit", self.spark.createDataFrame(rows, AUDIT).coalesce(1))

    def watermark(self, layer: str, table: str) -> str | None:
        found = watermarks(self.audit()).where((F.col("layer") == layer) & (F.col("table_name") == table)).first()
        return found.last_watermark if found else None

    def _since(self, layer: str, spec: TableSpec, df: DataFrame, mode: str) -> DataFrame:
        """INCREMENTAL: later than the last watermark (always an event time); WINDOW: the last window_days."""
        if mode == "INCREMENTAL":
            return watermark_filter(df, spec.watermark, self.watermark(layer, spec.name))
        if mode == "WINDOW":
            return df.where(F.col(spec.watermark).try_cast("timestamp_ntz") > F.date_sub(F.lit(self.as_of).cast("date"), spec.window_days).cast("timestamp_ntz"))
        return df

    def ingest_table(self, spec: TableSpec, source: DataFrame, mode: str = "FULL") -> dict:
        """Bronze: everything as text, filtered by mode, stamped, written."""
        store, text = self.stores["bronze"], as_strings(source)
        mode = "FULL" if store.version(spec.name) is None else mode
        batch, seen = self._since("bronze", spec, text, mode), Observation()
        high = F.max(F.col(spec.watermark).try_cast("timestamp_ntz")).cast("string") if spec.watermark in batch.columns else F.expr(UNKNOWN)
        rows = dispatch_write(store, spec, stamp(batch.observe(seen, high.alias("high")), "bronze", spec.name), mode, as_of=self.as_of)
        return self._log("bronze", spec.name, mode, rows, rows, watermark=seen.get["high"])

    def process_table(self, spec: TableSpec, mode: str | None = None) -> dict:
        """Silver: bronze cleaned, stamped and hashed."""
        mode, store = mode or spec.mode, self.stores["silver"]
        bronze = self.stores["bronze"].read(spec.name)
        if bronze is None:
            return self._log("silver", spec.name, mode, 0, 0, status="SKIP")
        mode = "FULL" if store.version(spec.name) is None and mode not in ("SCD2", "FDC") else mode
        raw, made = self._since("silver", spec, bronze.drop("_bronze_table", "_ingested_at", "_ingestion_date", "_row_hash"), mode), Observation()
        read, clean = self._cleaned(raw, spec)
        high = F.max(F.col(spec.watermark)).cast("string") if spec.watermark in clean.columns else F.expr(UNKNOWN)
        clean = clean.observe(made, high.alias("high"), F.count_if("_dq_flag").alias("flagged"))
        clean = stamp(clean.withColumn("_row_hash", row_hash(clean)), "silver", spec.name)
        rows = dispatch_write(store, spec, clean, mode, as_of=self.as_of)
        return self._log("silver", spec.name, mode, read, rows, made.get["flagged"], made.get["high"])

    def _cleaned(self, raw: DataFrame, spec: TableSpec) -> tuple[int, DataFrame]:
        """How many rows there are, and the cleaned ones. Keys are counted first, from their column alone, so that rows are
        shuffled and sorted only where a key repeats; with very many such keys, all are."""
        read, found, path = Observation(), Observation(), new_folder(self.spark, "repeated")
        counted = repeated_keys(raw.observe(read, F.count(F.lit(1)).alias("rows")), spec)
        counted.observe(found, F.count(F.lit(1)).alias("keys")).write.parquet(path)
        few = found.get["keys"] <= FEW_KEYS
        return read.get["rows"], clean_table(raw, spec, self.as_of, repeated=self.spark.read.schema(counted.schema).parquet(path) if few else None)

    def _gold_mode(self, name: str, mode: str) -> tuple[str, dict[str, str]]:
        """FULL if the table has to be built anew, else the mode; and the snapshots that the last build read."""
        kpi, store = KPIS[name], self.stores["gold"]
        note = json.loads(store.note(name, "INPUTS") or "{}")
        fits = kpi.groups and store.version(name) is not None and note.get("inputs") == [*self._pointers(name)] and (not kpi.dated or note.get("as_of") == self.as_of)
        return (mode, note["pointers"]) if mode != "FULL" and fits else ("FULL", {})

    def _input(self, name: str) -> SnapshotStore:
        return self.stores["gold" if name in KPIS else "silver"]

    def _pointers(self, name: str) -> dict[str, str]:
        """The snapshots that a gold table would read now."""
        return {i: p for i in KPIS[name].inputs if (p := self._input(i).pointer(i)) is not None}

    def process_gold_table(self, name: str, mode: str = "FULL") -> dict:
        """FULL builds a table from all rows. In every other mode, only the groups of rows that changed since the last build
        are computed again; the result is that of a full build. A missing input that is optional is passed as None."""
        kpi, store, now = KPIS[name], self.stores["gold"], self._pointers(name)
        if [i for i in kpi.inputs if i not in now and i not in kpi.optional]:
            return self._log("gold", name, mode, 0, 0, status="SKIP")
        mode, since = self._gold_mode(name, mode)
        inputs = {i: self._input(i).read(i) for i in now}
        build = lambda frames: kpi.build(*(frames.get(i) for i in kpi.inputs), *([self.as_of] if kpi.dated else []))
        if mode == "FULL":
            made = build(inputs)
        else:
            changes = {i: self._input(i).changed(i, since[i]) for i in now if since[i] != now[i]}
            before = drop_meta(store.read(name))
            if not changes:
                return self._log("gold", name, mode, 0, before.count(), status="OK")
            made = kept_up(name, build, kpi.groups, inputs, changes, before, self._kept)
        rows = store.write(name, stamp(made, "gold", name))
        store.note(name, "INPUTS", json.dumps({"inputs": [*now], "pointers": now, "as_of": self.as_of}))
        return self._log("gold", name, mode, rows, rows)

    def _kept(self, df: DataFrame) -> DataFrame:
        path = new_folder(self.spark, "groups")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def run_layers(self, sources: dict[TableSpec, DataFrame], kpis: list[str], mode: str = "FULL", layer_modes: dict[str, str] | None = None, layers: tuple[str, ...] = LAYERS, dry_run: bool = False, keep: tuple[str, ...] = LAYERS) -> list[dict]:
        """A table is made once those that it reads are there, a few at the same time, so that small ones fill the cores that the
        last tasks of large ones leave. layer_modes overrides the mode of a layer; dry_run only says what would run.

        keep: the layers whose tables stay. A table that this run makes in another one is deleted as soon as every table that
        reads it is made; sources are taken in the order in which gold needs them, so few of them are on disk together."""
        modes = {layer: (layer_modes or {}).get(layer, mode) for layer in layers}
        if bad := {*modes.values()} - {*MODES}:
            raise ValueError(f"unknown modes {sorted(bad)}")
        steps = [(layer, x) for layer in LAYERS if layer in layers for x in (kpis if layer == "gold" else sources)]
        if dry_run:
            return [{"layer": layer, "table": x if layer == "gold" else x.name, "mode": self._gold_mode(x, modes[layer])[0] if layer == "gold" else modes[layer]} for layer, x in steps]
        gone = {layer for layer in ("bronze", "silver") if layer in layers and LAYERS[LAYERS.index(layer) + 1] in layers and layer not in keep}
        if gone and {*modes.values()} != {"FULL"}:
            raise ValueError("only a run that builds all in full can do without older tables")
        specs, gold = {spec.name: spec for spec in sources}, [*dict.fromkeys(kpis if "gold" in layers else [])]
        levels, unread = _levels(gold), {name: {x for x in gold if name in KPIS[x].inputs} for name in specs}
        done: dict[tuple, dict] = {}
        silver: dict[str, Future] = {}
        built: dict[str, Future] = {}

        def from_source(name: str) -> None:
            spec = specs[name]
            if "bronze" in layers:
                done["bronze", spec] = self.ingest_table(spec, sources[spec], modes["bronze"])
            if "silver" in layers:
                done["silver", spec] = self.process_table(spec, modes["silver"])
            if "bronze" in gone:
                self.stores["bronze"].drop(name)
            was_read(name)

        def to_gold(name: str) -> None:
            for x in [*(silver[i] for i in KPIS[name].inputs if i in silver), *(built[x] for x in gold if levels[x] < levels[name])]:
                x.result()
            done["gold", name] = self.process_gold_table(name, modes["gold"])
            for i in KPIS[name].inputs:
                if i in silver:
                    was_read(i, name)

        def was_read(name: str, by: str | None = None) -> None:
            with self._lock:
                unread[name].discard(by)
                last = not unread[name]
            if last and "silver" in gone:
                self.stores["silver"].drop(name)

        self._running = True
        shared_folder(self.spark)  # before threads ask for it
        try:
            with shuffles_deleted(self.spark), ThreadPoolExecutor(AT_ONCE) as pool:
                start = lambda run, name: pool.submit(inheritable_thread_target(self.spark)(run), name)
                try:
                    for name in sorted(gold, key=levels.get):  # what a table waits for is started before it, so not all threads wait
                        for i in KPIS[name].inputs:
                            if i in specs and i not in silver:
                                silver[i] = start(from_source, i)
                        built[name] = start(to_gold, name)
                    silver |= {i: start(from_source, i) for i in specs if i not in silver}
                    for x in [*silver.values(), *built.values()]:
                        x.result()
                except BaseException:
                    pool.shutdown(wait=False, cancel_futures=True)
                    raise
            return [done[step] for step in steps]
        finally:
            self._running = False
            self._write_audit()

    def backfill_window(self, sources: dict[TableSpec, DataFrame], kpis: list[str]) -> list[dict]:
        """The last window_days again in bronze and silver, and gold in full."""
        return self.run_layers(sources, kpis, "WINDOW", {"gold": "FULL"})
