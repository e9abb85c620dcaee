"""Operator 11: archives written, read back and joined, against plain Python."""

import base64
import gzip
import hashlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quern.llm import warc
from quern.sources.scratch import new_folder

PAGES = "page_id long, url string, html string, n int, body string"


def brute(rows):
    """page_id, bytes, digest, type and target of each row."""
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        first = min((p for p, _, h in rows if (h or "") == (html or "")), key=lambda p: (p is None, p or 0))
        revisit = page != first
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def back(spark, rows, **more):
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], PAGES)
    path = warc.write(pages, new_folder(spark, "warc"), **more)
    found = warc.pages_of(warc.captures(warc.read(spark, path)))
    return sorted((tuple(r) for r in found.collect()), key=repr)


INSIDE = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\nWARC/1.0\r\n\r\n"
ROWS = [
    (3, "http://a.example/x y?q=1", "<p>one</p>"),
    (1, "http://a.example/", "<p>one</p>"),
    (2, None, None),
    (5, "", ""),
    (4, "http://[bad", "é\r\n\r\n"),
    (6, "http://b.example/\r\nWARC-Type: x", INSIDE),
    (7, "http://b.example/2", "\nWARC/1."),
    (8, "http://b.example/3", "\r\n\nWARC/1.1\r\n" * 50),
    (9, "http://c.example/", "é" * 300_000),
    (10, "http://c.example/", INSIDE),
]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, compression):
    assert back(spark, ROWS, compression=compression) == brute(ROWS)


def test_repeated_and_null_keys(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (None, "u", "a"), (None, "u", "b"), (None, "u", "b")]
    assert back(spark, rows) == brute(rows)


def test_least_bytes_and_empty_table(spark):
    assert [r[3] for r in back(spark, [(1, "u", "ab"), (2, "u", "ab")], least_bytes=3)] == ["response"] * 2
    assert back(spark, []) == []


def test_large_file_is_read_in_splits(spark):
    """Records whose payload holds whole records, over many splits of one file, come back whole."""
    rows = [(k, f"http://h.example/{k}", (INSIDE if k % 3 else "-") * (k % 40) + str(k)) for k in range(3000)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], PAGES).coalesce(1)
    path = warc.write(pages, new_folder(spark, "warc"), compression="none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = warc.read(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        found = {r[0]: bytes(r[1]) for r in records.where("type in ('response')").select(F.col("target_uri"), "payload").collect()}
        assert records.where("not complete or type is null").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == {u: h.encode() for _, u, h in rows}


def test_foreign_archive(spark):
    """Members of a gzip file, links in either direction, several metadata records, a capture that is missing, a cut end."""
    record = lambda kind, id, block, *more: "\r\n".join(["WARC/1.0", f"warc-type: {kind}", f"WARC-Record-ID: {id}", *more, f"Content-length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    http = b"HTTP/1.0 404 Gone\r\nA: b\r\n\r\nbody"
    records = [
        record("warcinfo", "<i>", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("response", "<r>", http, "WARC-Concurrent-To: <q>", "Content-Type: application/http;msgtype=response", "WARC-Payload-Digest: sha1:WRONG"),
        record("request", "<q>", b"GET / HTTP/1.0\r\n\r\n", "Content-Type: application/http"),
        record("metadata", "<m1>", b"a: 1\r\n", "WARC-Concurrent-To: <r>", "Content-Type: application/warc-fields"),
        record("metadata", "<m2>", b"a: 2\r\n", "WARC-Concurrent-To: <r>", "Content-Type: application/warc-fields"),
        record("request", "<lost>", b"GET /", "WARC-Concurrent-To: <none>", "Content-Type: application/http"),
        record("resource", "<s>", b"0123456789")[:-9],
    ]
    folder = tempfile.mkdtemp(prefix="warc-", dir="/tmp")
    with open(os.path.join(folder, "x.warc.gz"), "wb") as f:
        f.writelines(map(gzip.compress, records))
    found = warc.read(spark, folder)
    rows = {r["record_id"]: r for r in found.collect()}
    assert len(rows) == 7 and [k for k, r in rows.items() if not r["complete"]] == ["<s>"]
    assert rows["<r>"]["http_status"] == 404 and bytes(rows["<r>"]["payload"]) == b"body" and rows["<r>"]["digest_ok"] is False
    assert rows["<i>"]["fields"] == {"software": "x"} and bytes(rows["<s>"]["payload"]) == b"01234"
    nested = {r["record_id"]: r for r in warc.captures(found).collect()}
    assert {*nested} == {"<r>", "<s>", None}
    assert [x["record_id"] for x in nested["<r>"]["requests"]] == ["<q>"] and sorted(x["fields"]["a"] for x in nested["<r>"]["metadata"]) == ["1", "2"]
    assert nested["<s>"]["metadata"] is None and [x["record_id"] for x in nested[None]["requests"]] == ["<lost>"]


def test_crowded_capture(spark):
    records = [("<r>", "response", [])] + [(f"<m{k}>", "metadata", ["<r>"]) for k in range(2500)]
    found = spark.createDataFrame(records, "record_id string, type string, concurrent_to array<string>")
    rows = warc.captures(found).collect()
    assert sum(len(r["metadata"]) for r in rows) == 2500 and len(rows) == 3 and max(len(r["metadata"]) for r in rows) < 1200


def test_hot_and_null_keys_are_looked_up(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"))
    table = spark.createDataFrame([("hot", 1, 1667), ("k1", 2, 1), ("k4", 3, 1)], "key string, v int, n int")
    found = {r["id"]: r["v"] for r in warc.looked_up(rows, "key", table, "n").collect()}
    assert len(found) == 5000 and all(v == (1 if k % 3 == 0 else {1: 2, 4: 3}.get(k)) for k, v in found.items())
