"""CSV files with line breaks inside quotes, read by many tasks.

Spark's text reader cuts files into ranges at line ends, whatever is quoted there. Each range is first read under both
assumptions, that it begins outside or inside of quotes: the parity of its quotes, and whether a record ends in it. One
row for each range comes to the driver; going through a file's ranges in order tells which assumption holds, and which
range the record that a range begins inside of started in. Then ranges are read again, lines join into records, and only
records that cross the end of a range are gathered from their pieces. Records are parsed by Spark's CSV parser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CSV = {"escape": '"', "encoding": "UTF-8"}
_WELL = r'(?s)^(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)(?:,(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+))*+$'
"""A record whose quotes enclose a field or are doubled inside of one. If all are, their parity says what is quoted."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), quotes.cast("int").alias("quotes"), "value")


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """file, start and rows lo to hi for each range in a batch; the lines of a range stand in order."""
    starts = batch.column("start").to_numpy()
    files = batch.column("file").dictionary_encode()
    number = files.indices.to_numpy()
    cuts = np.flatnonzero(np.append(True, (starts[1:] != starts[:-1]) | (number[1:] != number[:-1])))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
        yield files.dictionary[int(number[lo])].as_py(), int(starts[lo]), lo, hi


def ranges_of(lines: DataFrame) -> dict[str, list[tuple[int, int, bool, bool]]]:
    """By file, its ranges in order: start, parity of quotes, and whether a line ends outside of quotes if the range begins outside, or inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list] = {}
        for batch in batches:
            for file, start, lo, hi in _stretches(batch):
                own = seen.setdefault((file, start), [0, False, False])
                state = (own[0] + np.cumsum(batch.column("quotes").to_numpy()[lo:hi])) % 2
                own[1] |= bool((state == 0).any())
                own[2] |= bool((state == 1).any())
                own[0] = int(state[-1])
        yield pa.RecordBatch.from_pylist([{"file": f, "start": s, "parity": p, "outside": a, "inside": b} for (f, s), (p, a, b) in seen.items()], pa.schema([("file", pa.string()), ("start", pa.int64()), ("parity", pa.int32()), ("outside", pa.bool_()), ("inside", pa.bool_())]))

    found: dict[str, list] = {}
    for file, *own in lines.select("file", "start", "quotes").mapInArrow(run, "file string, start long, parity int, outside boolean, inside boolean").collect():
        found.setdefault(file, []).append(tuple(own))
    return {file: sorted(own) for file, own in found.items()}


def begun_inside(ranges: dict[str, list[tuple[int, int, bool, bool]]]) -> dict[tuple[str, int], int]:
    """For each range that begins inside of quotes, the start of the range that its first record began in."""
    found = {}
    for file, own in ranges.items():
        inside, owner = False, 0
        for start, parity, outside, closes in own:
            if inside:
                found[file, start] = owner
            if not inside or closes:  # a record begins here, after the last line that ends outside
                owner = start
            inside = inside != bool(parity)
    return found


def split_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The rows of the files, as text by schema; None if a record has quotes that do not enclose a field."""
    lines = _lines(spark, path)
    ranges = ranges_of(lines)
    if any(len(own) > 1 and not own[0][2] for own in ranges.values()):
        return None  # a header that is longer than a range
    owners = begun_inside(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records of a range (owner null), and pieces of those that cross its ends (owner: the range they began in)."""
        waiting, of, inside, first, header = [], None, False, False, False
        names = ["file", "owner", "start", "value"]
        row = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)

        def rest() -> list[tuple]:
            """What is open when a range ends."""
            if not waiting:
                return []
            return [(of[0], owners[of] if first else of[1] if inside else None, of[1], "\n".join(waiting))]

        for batch in batches:
            out: list[tuple] = []
            for file, start, lo, hi in _stretches(batch):
                if (file, start) != of:
                    out += rest()
                    waiting, of = [], (file, start)
                    inside = first = of in owners
                    header = start == 0  # a file's first record
                values = batch.column("value").slice(lo, hi - lo)
                state = (int(inside) + np.cumsum(batch.column("quotes").to_numpy()[lo:hi])) % 2
                ends = np.flatnonzero(state == 0)
                if not first and not waiting and len(ends) == hi - lo:  # each line is a record
                    out += [(file, None, start, x) for x in values.to_pylist()[int(header) :]]
                    header = False
                    continue
                texts, at = values.to_pylist(), 0
                for end in ends.tolist():
                    if not header:
                        out.append((file, owners[of] if first else None, start, "\n".join([*waiting, *texts[at : end + 1]])))
                    waiting, at, first, header = [], end + 1, False, False
                waiting += texts[at:]
                inside = bool(state[-1])
            yield row(out)
        yield row(rest())

    rows = lines.select("file", "start", "quotes", "value").mapInArrow(run, "file string, owner long, start long, value string")
    whole = rows.where("owner is null").select("file", "start", "value")
    if any(parity for own in ranges.values() for _, parity, _, _ in own):  # a range ends inside of quotes
        pieces = rows.where("owner is not null").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
        whole = whole.union(pieces.select("file", F.col("owner").alias("start"), F.array_join("parts.value", "\n")))
    value = F.when(F.col("value").endswith("\r"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    text = whole.select(value.alias("value")).where("value <> ''")
    if not text.where(F.col("value").contains('"') & ~F.col("value").rlike(_WELL)).isEmpty():
        return None
    return text.select(F.from_csv("value", ", ".join(f"`{f.name}` string" for f in schema), CSV).alias("r")).select("r.*")
