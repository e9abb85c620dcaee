"""Operator 9: packing of token ids into windows by deficit round robin over one queue for each source."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.pieces import encoder
from quern.llm.shared import kept, kept_in_place
from quern.llm.spans import lean, text_bytes

PIECES = "key {key}, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
PART, FINE = 64 << 20, 1 << 20
"""Bytes of text in a partition, at most about; and at least, where there would be fewer partitions than two for each core."""
SMALL = 200_000
"""Rows (partition, source) up to which the carried deficits are broadcast (under 10 MB)."""


def encoded(docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str, source: str) -> DataFrame:
    """key, source, ids (packed little-endian, 2 or 4 bytes each), n, at: the ids of each text and end_id, and where to deal it.

    at is a hash of the key and the row's place in docs, so that rows of one key, and equal rows, are spread.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            data, offs = text_bytes(batch.column(2))
            ids, ends = own.encode(data, offs)
            rows = np.append(np.insert(ids, ends[1:], own.dtype(end_id)), own.dtype(0))[: len(ids) + len(batch)]
            ends = ends + np.arange(len(ends))
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(ends * rows.itemsize), pa.py_buffer(rows)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed.cast(pa.binary()), pa.array(np.diff(ends)), batch.column(3)], ["key", "source", "ids", "n", "at"])

    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"), F.xxhash64(key, F.monotonically_increasing_id()).alias("at"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, source string, ids binary, n long, at long")


class Queue:
    """What is left of one source's documents in a partition, in order."""

    def __init__(self, share: float, deficit: float) -> None:
        self.share, self.deficit, self.left, self.docs = share, deficit, 0, deque()

    def add(self, key: object, source: str | None, ids: np.ndarray) -> None:
        self.docs.append([key, source, ids, 0])
        self.left += len(ids)

    def take(self, n: int) -> Iterator[tuple[object, str | None, int, np.ndarray, int]]:
        """The next n ids as pieces: key, source, start, ids, the document's ids."""
        self.left -= n
        self.deficit -= n
        while n:
            key, source, ids, start = self.docs[0]
            k = min(n, len(ids) - start)
            yield key, source, start, ids[start : start + k], len(ids)
            n -= k
            if start + k == len(ids):
                self.docs.popleft()
            else:
                self.docs[0][3] += k


def fill(queues: list[Queue], room: int, least: int) -> Iterator[tuple]:
    """One sequence of exactly room ids. Each source gets its share, and what it lacks or has in excess stays with it.

    A source whose credit is under least waits for a later sequence, unless that ends what it has.
    """
    owed = sorted(queues, key=lambda q: -q.deficit)  # what is owed from before comes first
    for q in queues:
        q.deficit += q.share * room
    for q in owed:
        n = min(room, q.left, int(q.deficit))
        if n > 0 and (n >= least or n == q.left or n == room):
            yield from q.take(n)
            room -= n
    while room:  # others lend; they are paid back as their deficit is now below zero
        q = max((q for q in queues if q.left), key=lambda q: q.deficit)
        n = min(room, q.left)
        yield from q.take(n)
        room -= n


def sizes(total: int, window: int) -> Iterator[int]:
    """Full windows, then the rest in powers of two, so no sequence needs padding."""
    yield from [window] * (total // window)
    yield from (1 << k for k in range(window.bit_length(), -1, -1) if total % window >> k & 1)


def pack(
    docs: DataFrame, tokenizer: str, *, window: int = 4096, end_id: int = 2, weights: dict[str | None, float] | None = None, least: int = 256, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """Pieces of all documents in sequences of at most window ids.

    Columns: key, source, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset,
    sequence_tokens. A document's ids are the tokenizer's, without special tokens, and end_id. Each id is in exactly one
    piece; a sequence is full, or its length is a power of two, so there is no padding at all.

    Documents are dealt to partitions by a hash of the key and their place, so that each partition has about the mix of
    the whole, whatever the keys; the partition packs its own documents. Target proportions are weights, or else each source's share of all ids. What a
    source is owed or owes goes from window to window, and, from counts by partition and source, into the next
    partition. least: the shortest piece that a share alone may cause. A partition's ids are held in memory by its task
    (two bytes each); the number of partitions follows from the bytes of all texts (PART), so these are few, but for a
    very long text, which is whole in one.

    Null text: only end_id. Null source: a source of its own. Null keys are kept. Repeated rows: packed each. Empty
    table: no rows. Other columns of docs are not read.
    """
    name = key
    kind = docs.schema[key].dataType.simpleString()
    ids = encoded(docs, tokenizer, end_id, key, text, source)
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    number = max(1, -(-size // PART), min(2 * docs.sparkSession.sparkContext.defaultParallelism, size // FINE))
    dealt = kept_in_place(ids.repartition(number, "at").sortWithinPartitions("at", "key", "source", "ids").drop("at")).withColumn("at", F.monotonically_increasing_id())
    counts = kept(dealt.groupBy(F.shiftright("at", 33).alias("part"), "source").agg(F.sum("n").alias("n")))
    parts = counts.groupBy("part").agg(F.sum("n").alias("part_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part_n").over(before), F.lit(0)))  # a row for each partition
    if weights is None:
        shares = counts.groupBy("source").agg(F.sum("n").alias("w"))
    else:
        given = [(k, float(v)) for k, v in weights.items()]
        shares = counts.select("source").distinct().join(docs.sparkSession.createDataFrame(given, "given string, w double"), F.col("source").eqNullSafe(F.col("given")), "left")
        shares = shares.select("source", F.coalesce("w", F.lit(0.0)).alias("w"))
    whole = float(shares.agg(F.sum("w")).first()[0] or 1)
    shares = shares.select(F.col("source").alias("of"), (F.col("w") / whole).alias("share"))
    own = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        counts.withColumn("own", F.coalesce(F.sum("n").over(own), F.lit(0)))
        .join(parts, "part")
        .join(shares, F.col("source").eqNullSafe(F.col("of")))
        .groupBy(F.shiftleft("part", 33).alias("at"))
        .agg(F.collect_list(F.struct("source", "share", (F.col("share") * F.col("before") - F.col("own")).alias("deficit"))).alias("carried"))
    )
    carried = kept(carried)
    if counts.count() <= SMALL:
        rows = dealt.join(F.broadcast(carried), "at", "left")
    else:
        rows = dealt.join(carried, "at", "left").withColumn("part", F.shiftright("at", 33)).repartition("part").sortWithinPartitions("at")
    schema = PIECES.format(key=kind)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(tokenizer).dtype
        fields = ["key", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]

        def rows_of() -> Iterator[tuple[int, dict]]:
            for batch in batches:
                at = batch.column("at").to_numpy()
                states = batch.column("carried")
                first = {i: states[i].as_py() for i in np.flatnonzero(states.is_valid().to_numpy(zero_copy_only=False))}
                for i, row in enumerate(zip(batch.column("key").to_pylist(), batch.column("source").to_pylist(), batch.column("ids"), strict=True)):
                    yield int(at[i]) >> 33, (*row, first.get(i))

        def flush(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            arrow = [pa.array(columns[0], key_type), pa.array(columns[1], pa.string())] + [pa.array(c, pa.binary() if f == "ids" else pa.int64()) for f, c in zip(fields[2:], columns[2:], strict=True)]
            return pa.RecordBatch.from_arrays(arrow, fields)

        key_type = None
        for part, rows in groupby(rows_of(), key=lambda x: x[0]):
            queues: dict[str | None, Queue] = {}
            for _, (key, source, raw, state) in rows:
                for s in state or []:
                    queues[s["source"]] = Queue(s["share"], s["deficit"])
                queues[source].add(key, source, np.frombuffer(raw.as_buffer(), packed))
            order, found, bulk = [queues[k] for k in sorted(queues, key=lambda k: (k is None, k or ""))], [], 0
            for i, size in enumerate(sizes(sum(q.left for q in order), window)):
                offset = 0
                for key, source, start, ids, n in fill(order, size, least):
                    found.append((key, source, start, len(ids), ids.astype("<u4").tobytes(), n, part << 32 | i, offset, size))
                    offset += len(ids)
                bulk += offset
                if bulk > 1 << 20:
                    yield flush(found)
                    found, bulk = [], 0
            if found:
                yield flush(found)

    return rows.select("at", "key", "source", "ids", "carried").mapInArrow(run, schema).withColumnRenamed("key", name)
