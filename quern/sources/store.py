"""Snapshot tables on plain Parquet: <root>/<table>/_v=<n>/ and a pointer written last. For one writer at a time.

A table can be cut into parts by a column (a bucket of its key, a month): then the pointer names the folders of each part,
and a batch writes and replaces the parts that it touches, and no other. Each folder's schema is kept beside it; a read
reconciles the schemas of the folders that it reads (operators/evolution.py).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators import merge
from quern.operators.evolution import evolved_union
from quern.operators.rows import latest
from quern.schema import TableSpec

BUCKET, MONTH = "_bucket", "_month"
CODEC = "zstd"
"""Half the bytes of snappy where rows carry a hash in hexadecimal digits."""


class Written(int):
    """Rows written, with how many were inserted, updated and deleted."""

    inserted: int
    updated: int
    deleted: int

    def __new__(cls, rows: int, inserted: int = 0, updated: int = 0, deleted: int = 0) -> Written:
        self = super().__new__(cls, rows)
        self.inserted, self.updated, self.deleted = inserted, updated, deleted
        return self


@dataclass
class Snapshot:
    """What a pointer names. parts: folder versions by part ("" for a table that is in one part); column: "" or that of the parts."""

    column: str
    parts: dict[str, list[int]]
    last: int

    @classmethod
    def of(cls, text: str) -> Snapshot:
        if not text.lstrip().startswith("{"):
            versions = [*map(int, text.split())]
            return cls("", {"": versions}, max(versions))
        return cls(**json.loads(text))

    def text(self) -> str:
        return json.dumps(vars(self)) if self.column else " ".join(map(str, self.parts.get("", [])))

    def folders(self) -> set[tuple[str, int]]:
        return {(part, v) for part, versions in self.parts.items() for v in versions}


class SnapshotStore:
    """A table is the folders that its pointer names; a folder that is named is never changed, so a reader sees whole batches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _path(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _text(self, path: str) -> str | None:
        """A small file, read by the driver without a job."""
        found, fs = self._path(path)
        if not fs.exists(found):
            return None
        stream = fs.open(found)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        found, fs = self._path(path)
        out = fs.create(found, True)
        out.write(bytearray(text.encode()))
        out.close()

    def pointer(self, table: str) -> str | None:
        """The current snapshot, for read(at=) and changed()."""
        return self._text(f"{self.root}/{table}/CURRENT")

    def note(self, table: str, name: str, text: str | None = None) -> str | None:
        """A small text kept beside a table: written if given, else read."""
        if text is None:
            return self._text(f"{self.root}/{table}/NOTE-{name}")
        return self._put(f"{self.root}/{table}/NOTE-{name}", text)

    def snapshot(self, table: str, at: str | None = None) -> Snapshot | None:
        text = self.pointer(table) if at is None else at
        return None if text is None else Snapshot.of(text)

    def versions(self, table: str) -> list[int]:
        """The current snapshot's folders: that of the last write and those of the appends after it."""
        now = self.snapshot(table)
        return sorted({v for _, v in now.folders()}) if now else []

    def version(self, table: str) -> int | None:
        now = self.snapshot(table)
        return now.last if now else None

    def path(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/_v={version}"

    def _rows(self, table: str, column: str, folders: set[tuple[str, int]], else_of: int) -> DataFrame:
        """The rows of some folders, those with one schema in one scan."""
        by_schema: dict[str | None, list[str]] = {}
        known: dict[int, str | None] = {}
        for part, v in sorted(folders):
            known[v] = known[v] if v in known else self._text(f"{self.root}/{table}/SCHEMA/{v}")
            by_schema.setdefault(known[v], []).append(self.path(table, v) + (f"/{part}" if part else ""))
        frames = []
        for schema, paths in by_schema.items():
            reader = self.spark.read.option("basePath", f"{self.root}/{table}")
            frames.append((reader.schema(StructType.fromJson(json.loads(schema))) if schema else reader).parquet(*paths).drop("_v"))
        if not frames:
            frames = [self.spark.createDataFrame([], StructType.fromJson(json.loads(self._text(f"{self.root}/{table}/SCHEMA/{else_of}"))))]
        return (evolved_union(frames) if len(frames) > 1 else frames[0]).drop(column)

    def read(self, table: str, columns: list[str] | None = None, *, at: str | None = None, parts: set[str] | None = None) -> DataFrame | None:
        """A snapshot (the current one), or None; only some parts of it if given. Columns are pruned in the scan."""
        now = self.snapshot(table, at)
        if now is None:
            return None
        df = self._rows(table, now.column, {x for x in now.folders() if parts is None or x[0] in parts}, now.last)
        return df.select(*columns) if columns else df

    def changed(self, table: str, since: str) -> tuple[DataFrame, DataFrame]:
        """The rows of the folders that a snapshot named and the current one does not, and the other way round."""
        old, new = self.snapshot(table, since), self.snapshot(table)
        return self._rows(table, old.column, old.folders() - new.folders(), old.last), self._rows(table, new.column, new.folders() - old.folders(), new.last)

    def write(self, table: str, df: DataFrame, partitions: tuple[str, ...] = ()) -> Written:
        """A new snapshot; its rows are counted while they are written."""
        return self._add(table, df, partitions, "", {})

    def drop(self, table: str) -> None:
        """Deletes a table with all its snapshots, the pointer first."""
        for path in (f"{self.root}/{table}/CURRENT", f"{self.root}/{table}"):
            found, fs = self._path(path)
            fs.delete(found, True)

    def append(self, table: str, df: DataFrame, partitions: tuple[str, ...] = (), part: tuple[str, Column] | None = None) -> Written:
        """A new snapshot that adds one folder to those of the current one."""
        now = self.snapshot(table)
        return self._add(table, df, partitions, part[0] if part else "", now.parts if now else {}, part[1] if part else None)

    def replace(self, table: str, df: DataFrame, part: tuple[str, Column], gone: set[str] | None = None, partitions: tuple[str, ...] = ()) -> Written:
        """A new snapshot with other parts of a table: those named in gone (all, if None) give way to those of df."""
        now = self.snapshot(table)
        keep = {k: v for k, v in now.parts.items() if k not in gone} if now and gone is not None else {}
        return self._add(table, df, partitions, part[0], keep, part[1])

    def _add(self, table: str, df: DataFrame, partitions: tuple[str, ...], column: str, keep: dict[str, list[int]], part: Column | None = None) -> Written:
        version, seen = (self.version(table) or 0) + 1, Observation()
        tagged = merge.CHANGE in df.columns
        kinds = [F.count_if(F.col(merge.CHANGE) == k).alias(k) for k in "IUD"] if tagged else []
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *kinds).drop(merge.CHANGE)
        if column:
            df = df.withColumn(column, part)
        by = [*([column] if column else []), *partitions]
        out = df.write.mode("overwrite").option("compression", CODEC)
        (out.partitionBy(*by) if by else out).parquet(self.path(table, version))
        self._put(f"{self.root}/{table}/SCHEMA/{version}", df.schema.json())
        parts = {k: [*v] for k, v in keep.items()}
        for name in self._names(table, version, column):
            parts.setdefault(name, []).append(version)
        self._put(f"{self.root}/{table}/CURRENT", Snapshot(column, parts, version).text())
        found = seen.get
        return Written(found["rows"], *(found[k] for k in "IUD")) if tagged else Written(found["rows"], found["rows"])

    def _names(self, table: str, version: int, column: str) -> list[str]:
        """The parts that a folder has, as its subfolders are named."""
        if not column:
            return [""]
        path, fs = self._path(self.path(table, version))
        return sorted(x.getPath().getName() for x in fs.listStatus(path) if x.getPath().getName().startswith(f"{column}="))


def bucket_of(spec: TableSpec) -> tuple[str, Column]:
    return BUCKET, F.pmod(F.xxhash64(F.col(spec.key).cast("string")), F.lit(spec.buckets)).cast("int")


def month_of(spec: TableSpec) -> tuple[str, Column]:
    return MONTH, F.date_format(F.col(spec.watermark).try_cast("timestamp_ntz"), "yyyy-MM")


def part_of(spec: TableSpec) -> tuple[str, Column] | None:
    return bucket_of(spec) if spec.buckets else month_of(spec) if spec.by_month else None


def touched(df: DataFrame, part: tuple[str, Column]) -> set[str]:
    """The parts that rows are in: at most as many names as the table has parts come to the driver."""
    return {f"{part[0]}={r[0]}" for r in df.select(part[1].alias("p")).distinct().collect()}


def dispatch_write(store: SnapshotStore, spec: TableSpec, df: DataFrame, mode: str, *, as_of: str, gone: DataFrame | None = None) -> Written:
    """Writes a batch in one of the six modes, under the specification's key; returns the rows written, and counts by kind.

    A batch with several rows for a key is reduced to the latest first, in the modes that merge. A table with buckets is
    merged in the buckets that the batch (or gone) has keys of; one by month is replaced from the month of the cutoff on,
    and only that month is merged row by row. Other parts are neither read nor written. Batches may have new columns, lack
    old ones, or have wider types.
    """
    now, key, part = store.snapshot(spec.name), [spec.key], part_of(spec)
    target = None if now is None else store.read(spec.name)
    if mode in ("CDC", "SCD2", "FDC"):
        order = [F.desc_nulls_last(spec.watermark)] if spec.watermark in df.columns else []
        df = latest(df, key, [*order, *(F.col(c) for c in df.columns if c not in key)])
    put = lambda rows, parts=None: store.replace(spec.name, rows, part, parts, spec.partitions) if part else store.write(spec.name, rows, spec.partitions)
    if mode == "FULL":
        return put(df)
    if mode == "INCREMENTAL":
        return store.append(spec.name, df, spec.partitions, part)
    if mode == "WINDOW":
        cutoff = F.date_sub(F.lit(as_of).cast("date"), spec.window_days)
        if target is None:
            return put(df)
        if spec.by_month and now.column == MONTH:
            month = store.spark.range(1).select(F.date_format(cutoff, "yyyy-MM")).first()[0]
            late = {x for x in now.parts if f"{MONTH}={month}" <= x < f"{MONTH}=_"}  # a part without a month comes after
            old = store.read(spec.name, parts=late & {f"{MONTH}={month}"})
            lost = store.read(spec.name, parts=late).where(merge.after(spec.watermark, cutoff)).count()
            done = put(merge.window_replace(old, df, spec.watermark, cutoff, tag=True), late)
        else:
            lost = target.where(merge.after(spec.watermark, cutoff)).count()
            done = put(merge.window_replace(target, df, spec.watermark, cutoff, tag=True))
        return Written(done, done.inserted, 0, lost)
    if mode == "CDC":
        parts = None
        if spec.buckets and now is not None and now.column == BUCKET:
            parts = touched(df, part) | (touched(gone, part) if gone is not None else set())
            target = store.read(spec.name, parts=parts)
        new = merge.inserted(df) if target is None else merge.upsert(target, df, key, tag=True)
        return put(new if gone is None else merge.soft_delete(new, gone, key), parts)
    if mode == "SCD2":
        return put(merge.scd2_init(df, as_of) if target is None else merge.scd2_merge(target, df, key, [*spec.tracked], as_of, tag=True))
    if mode == "FDC":
        return put(df.withColumn("_is_deleted", F.lit(False)) if target is None else merge.fdc_merge(target, df, key, tag=True))
    raise ValueError(f"unknown mode {mode!r}")
