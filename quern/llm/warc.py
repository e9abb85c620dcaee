"""Operator 11: pages as WARC archives, and archives as one nested row for each capture.

write() puts a transaction of three records in for each page: the request, the response (or, where an equal payload has
a response already, a revisit without it) and metadata; request and metadata name the response's record in
WARC-Concurrent-To. Spark's text writer makes the files; a record is a row of it, so an archive is as large as a task.

read() cuts archives at each line that begins a record, with Spark's text reader, which splits large plain files and
inflates .gz ones. A payload can hold such a line too: files in which a piece has another length than its header says
are put in order, and their pieces join until the length is reached. captures() joins the records of a transaction.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import kept
from quern.llm.spans import lean

HEAVY = 1000
"""Keys with the most rows, which are broadcast; any other key has a thousandth of all rows at most."""
MANY = 1000
"""Requests or metadata records in one nested row, about; a capture that has more gets several rows."""
CUT = "\nWARC/1."
"""Begins every record but a file's first. No end of it is a beginning of it, so the reader can't miss one."""
RECORD = "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, http_status int, payload_bytes long, payload_digest string, digest_ok boolean, fields map<string,string>, complete boolean"


def looked_up(rows: DataFrame, key: str, table: DataFrame, size: str) -> DataFrame:
    """rows left joined to a table with one row for each key. size: its column with the number of rows of a key.

    The HEAVY largest keys are broadcast, so their rows stay where they are; the others meet in a shuffle.
    """
    names = [c for c in table.columns if c not in (key, size)]
    heavy = table.orderBy(F.col(size).desc(), key).limit(HEAVY).select(F.col(key).alias("heavy_key"), *(F.col(c).alias(f"heavy_{c}") for c in names))
    rows = rows.join(F.broadcast(heavy), F.col(key) == F.col("heavy_key"), "left")
    # what is found, and what has no key, is dealt anywhere
    spread = F.concat(F.lit("-"), F.xxhash64(*(F.col(c) for c in rows.columns if not c.startswith("heavy_") and c != "body")).cast("string"))
    rows = rows.withColumn("cold_key", F.when(F.col("heavy_key").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(spread))
    cold = table.select(F.col(key).alias("cold_key"), *(F.col(c).alias(f"cold_{c}") for c in names))
    rows = rows.join(cold.hint("shuffle_hash"), "cold_key", "left")
    found = [F.when(F.col("heavy_key").isNotNull(), F.col(f"heavy_{c}")).otherwise(F.col(f"cold_{c}")).alias(c) for c in names]
    return rows.select(*(c for c in rows.columns if not c.startswith(("heavy_", "cold_"))), *found)


def record_id(kind: str, page: Column, row: Column) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("")), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def planned(pages: DataFrame, key: str, url: str, body: str, least_bytes: int) -> DataFrame:
    """page, row, url, body (null for revisits), bytes, sha1, original: the response's page and row, null for responses."""
    rows = pages.select(F.col(key).alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(body).cast("string"), F.lit("")).alias("body"))
    if rows.groupBy("page").count().where("count > 1").isEmpty():
        rows = rows.withColumn("row", F.lit(0).cast("long"))
    else:  # rows of one id are told apart by their place in a table
        rows = kept(rows.withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumns({"bytes": F.octet_length("body").cast("long"), "sha1": F.sha1(F.encode("body", "UTF-8")), "payload": F.sha2(F.col("body"), 256)})
    rows = rows.withColumn("payload", F.when(F.col("bytes") >= least_bytes, F.col("payload")))
    first = F.min(F.struct(F.col("page").isNull().alias("last"), "page", "row")).alias("first")
    equal = rows.where("payload is not null").groupBy("payload").agg(first, F.count("*").alias("n")).where("n > 1")
    found = looked_up(rows, "payload", kept(equal), "n")
    found = found.withColumn("original", F.when(F.col("first").isNotNull() & ~F.col("first.page").eqNullSafe(F.col("page")), F.col("first")))
    return found.select("page", "row", "url", F.when(F.col("original").isNull(), F.col("body")).alias("body"), "bytes", "sha1", "original")


def _record(kind: str, id: str, date: str, uri: str | None, block: bytes, media: str, *more: str) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {id}", f"WARC-Date: {date}", *([f"WARC-Target-URI: {uri}"] if uri else []), *more, f"Content-Type: {media}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def _address(url: str | None) -> tuple[str | None, str, str]:
    """The URL without control characters and spaces, its host, and its path."""
    if not url:
        return None, "", "/"
    url = re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: quote(m[0]), url)
    try:
        parts = urlsplit(url)
    except ValueError:
        return url, "", "/"
    return url, parts.netloc.rpartition("@")[2], (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def write(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", body: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> str:
    """Writes request, response or revisit, and metadata for each page into a new folder, and returns its path.

    Of pages with equal payloads (by SHA-256) of at least least_bytes, that with the smallest key is a response and the
    others revisit it. Nulls: a null body is an empty payload, a null URL leaves the header out, null keys come after all
    others (and rows that repeat the smallest key are all responses, as is every row of a payload whose keys are all
    null). Control characters and spaces in a URL are percent-encoded. Very long bodies are one record; an empty table
    gives a folder without records. Other columns are not read. compression="none" makes files that readers can split.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for page, url_, body_, n, sha1, own, ask, about, original in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                uri, host, target = _address(url_)
                digest = f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
                out.append(_record("request", ask, date, uri, f"GET {target} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), "application/http; msgtype=request", f"WARC-Concurrent-To: {own}"))
                if original is None:
                    out.append(_record("response", own, date, uri, head + body_.encode(), "application/http; msgtype=response", digest))
                else:
                    out.append(_record("revisit", own, date, uri, head, "application/http; msgtype=response", digest, f"WARC-Refers-To: {original}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
                fields = b"" if page is None else f"{key}: {page}\r\n".encode()
                out.append(_record("metadata", about, date, uri, fields, "application/warc-fields", f"WARC-Concurrent-To: {own}"))
                size += len(out[-2])
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.large_binary()).cast(pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = planned(pages, key, url, body, least_bytes)
    ids = [record_id(kind, F.col("page"), F.col("row")).alias(kind) for kind in ("response", "request", "metadata")]
    original = F.when(F.col("original").isNotNull(), record_id("response", F.col("original.page"), F.col("original.row"))).alias("original")
    records = rows.select(F.col("page").cast("string").alias("page"), "url", "body", "bytes", "sha1", *ids, original).mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path, compression=None if compression == "none" else compression)
    return path


def _parsed(raw: bytes, whole: bool) -> tuple:
    """Values of RECORD and the payload of one record, from its version line on."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named: dict[str, list[str]] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        named.setdefault(name.strip().lower(), []).append(value.strip(" \t"))
    one = lambda name: named.get(name, [None])[0]
    block = rest[: int(one("content-length") or 0)]
    kind, media = one("warc-type"), (one("content-type") or "").lower()
    status, size, payload, fields = None, None, block, None
    if media.startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        status = int(m[1]) if (m := re.match(rb"HTTP/\S+ (\d{3})\b", http)) else None
        if kind == "revisit":
            size = int(m[1]) if (m := re.search(rb"(?i)\ncontent-length:[ \t]*(\d{1,18})[ \t]*(\r|$)", http)) else None
            payload = None
    elif media.startswith("application/warc-fields"):
        lines = [x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if ":" in x]
        fields = [(name.strip(), value.strip(" \t")) for name, value in {name: value for name, _, value in lines}.items()]
    said = one("warc-payload-digest")
    digest = said.rpartition(":")[2].upper() if said else None
    if payload is not None:
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        same = own == digest if digest else None
        digest, size = own, len(payload)
    else:
        same = None
    return one("warc-record-id"), kind, one("warc-target-uri"), one("warc-date"), named.get("warc-concurrent-to", []), one("warc-refers-to"), status, size, digest, same, fields, whole, payload


def read(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """One row for each record of the archives in a folder or file (RECORD, and payload: binary).

    http_status and the payload are those of HTTP messages, else the payload is the block; for a revisit, which has none,
    payload_bytes and payload_digest are what its headers say. digest_ok: the payload has the digest that its header
    says (null without one). fields: of application/warc-fields. A record that ends before its length, or after it, has
    complete = false and what is there; text that is no record gives a row without a type. An empty folder: no rows.
    """
    schema = RECORD + (", payload binary" if payload else "")
    kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in re.split(r", (?=\w+ )", RECORD)] + ["payload"]
    width = len(names) - (not payload)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:width], kinds[:width], strict=True)], names[:width])

    @lean
    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of([_parsed(x.as_py(), True) for x in batch.column(0)])

    @lean
    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, of, need = bytearray(), None, 0
        for batch in batches:
            out = []
            for piece, file in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                piece = piece.as_py()
                if waiting and file != of:
                    out.append(_parsed(bytes(waiting), False))
                    waiting = bytearray()
                of, begins = file, not waiting
                waiting += piece if begins else CUT.encode() + piece
                if begins:
                    at, found = piece.find(b"\r\n\r\n"), re.search(rb"(?i)\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", piece)
                    need = at + 4 + int(found[1]) if at >= 0 and found and found.start() < at else 0
                if len(waiting) >= need:  # without a length it is no record, and is told as such
                    out.append(_parsed(bytes(waiting), need > 0 and len(waiting) - need in (3, 4)))
                    waiting = bytearray()
            yield batch_of(out)
        if waiting:
            yield batch_of([_parsed(bytes(waiting), False)])

    pieces = spark.read.option("lineSep", CUT).text(path)
    pieces = pieces.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    head = F.substring_index("value", "\r\n\r\n", 1)
    size = F.regexp_extract(head, r"(?i)\ncontent-length:[ \t]*(\d{1,18})[ \t]*(\r|$)", 1).try_cast("long")
    over = F.octet_length("value") - F.octet_length(head) - 4 - size
    alone = F.coalesce((over == 3) | (over == 4) & F.col("value").endswith("\n"), F.lit(False))
    odd = kept(pieces.where(~alone).select("file").distinct())
    value = F.col("value").cast("binary").alias("value")
    if odd.isEmpty():
        return pieces.select(value).mapInArrow(apart, schema)
    plain = pieces.join(odd, "file", "left_anti").select(value).mapInArrow(apart, schema)
    ordered = pieces.join(odd, "file", "left_semi").repartition("file").sortWithinPartitions("file", "start", "place")
    return plain.union(ordered.select(value, "file").mapInArrow(in_order, schema))


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each response, revisit or resource: its columns, requests and metadata (arrays of structs).

    A request or metadata record belongs to the capture that it names in WARC-Concurrent-To, or that names it. If that is
    in none of the records, they make a row without a type. A capture with more than MANY of them has several rows
    (part). Records are read three times; give a kept table.
    """
    side = [c for c in ("record_id", "date", "target_uri", "fields", "payload_bytes", "payload_digest", "payload") if c in records.columns]
    main = records.where("type in ('response', 'revisit', 'resource')")
    others = records.where("type in ('request', 'metadata')")
    named = others.select(F.explode("concurrent_to").alias("capture"), F.col("record_id").alias("other"))
    naming = main.where(F.size("concurrent_to") > 0).select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("other"))
    links = named.union(naming).distinct()
    crowded = kept(links.groupBy("capture").agg(F.count("*").alias("n")).where(F.col("n") > MANY))
    part = F.lit(0)
    if not crowded.isEmpty():
        links = links.join(crowded, "capture", "left")
        part = F.coalesce(F.pmod(F.xxhash64("other"), F.ceil(F.col("n") / MANY)), F.lit(0)).cast("int")
    links = links.select("capture", "other", part.alias("part"))
    found = links.join(others.select(F.col("record_id").alias("other"), "type", F.struct(*side).alias("record")), "other")
    lists = [F.collect_list(F.when(F.col("type") == kind, F.col("record"))).alias(name) for kind, name in (("request", "requests"), ("metadata", "metadata"))]
    grouped = found.groupBy("capture", "part").agg(*lists)
    return main.join(grouped, main["record_id"] == grouped["capture"], "full").drop("capture").withColumn("part", F.coalesce("part", F.lit(0)))


def pages_of(nested: DataFrame, key: str = "page_id", kind: str = "long") -> DataFrame:
    """key, payload_bytes, payload_digest, record_type and refers_to (key of the response) for each capture."""
    own = nested.where("type is not null and part = 0").select(
        "record_id", F.get("metadata", F.lit(0))["fields"][key].cast(kind).alias(key), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").alias("target")
    )
    own = kept(own)
    wanted = own.where("target is not null").groupBy("target").agg(F.count("*").alias("n"))
    table = kept(wanted.join(own.select(F.col("record_id").alias("target"), F.col(key).alias("refers_to")), "target"))
    return looked_up(own, "target", table, "n").select(key, "payload_bytes", "payload_digest", "record_type", "refers_to")
