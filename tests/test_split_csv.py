"""CSV read by ranges: the rows of the plain read, whatever is quoted where a range ends."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from quern.sources import files, split_csv


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def write(path, rows, end="\r\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_plain_read(spark, small_ranges, tmp_path, end):
    """Quoted line breaks, commas, doubled quotes, empty fields, records longer than several ranges, two files."""
    rng = random.Random(end)
    parts = ["a", "é", ",", '"', '""', "\n", "\n\n", "word ", " x", "1,2\n3", ""]
    for name in ("one.csv", "two.csv"):
        rows = [["id", "note", "more"]]
        for k in range(1500):
            n = 3000 if k in (400, 401, 900) else rng.randint(0, 6)
            rows.append([str(k), "".join(rng.choice(parts) for _ in range(n)).strip(), rng.choice(["", "z", "q,r", 'say "hi"', "two\nlines"])])
        write(tmp_path / name, rows, end)
    plain = files.scan_csv_all_string(spark, f"{tmp_path}/*.csv", split=False)
    split = split_csv.split_records(spark, f"{tmp_path}/*.csv", plain.schema)
    assert split is not None and split.columns == plain.columns
    assert rows_of(split) == rows_of(plain) and plain.count() == 3000
    assert spark.read.text(f"{tmp_path}/*.csv").rdd.getNumPartitions() > 20 and len(split_csv.begun_inside(split_csv.ranges_of(split_csv._lines(spark, f"{tmp_path}/*.csv")))) > 3


def test_one_large_file_is_read_by_many_tasks(spark, small_ranges, tmp_path):
    write(tmp_path / "x.csv", [["k", "v"], *([str(k), f"line\n{k}"] for k in range(3000))])
    df = files.scan_csv_all_string(spark, f"{tmp_path}/x.csv")
    assert df.count() == 3000 and df.where(F.col("v") != F.concat(F.lit("line\n"), "k")).count() == 0
    assert df.rdd.getNumPartitions() > 10 and files.scan_csv_all_string(spark, f"{tmp_path}/x.csv", split=False).rdd.getNumPartitions() == 1


def test_odd_quotes_are_left_to_the_plain_read(spark, tmp_path):
    (tmp_path / "x.csv").write_text('k,v\n1,5" pipe\n2,"quoted"\n3,a"b"c\n')
    plain = files.scan_csv_all_string(spark, f"{tmp_path}/x.csv", split=False)
    assert split_csv.split_records(spark, f"{tmp_path}/x.csv", plain.schema) is None
    assert rows_of(files.scan_csv_all_string(spark, f"{tmp_path}/x.csv")) == rows_of(plain)


@pytest.mark.parametrize("text", ["k,v\n", "k,v\n1,2", "k,v\n\n1,2\n\n", 'k,v\n"",\n', 'k,"v\nw"\n1,2\n', "k\n1\n"])
def test_small_files(spark, tmp_path, text):
    (tmp_path / "x.csv").write_text(text)
    plain = files.scan_csv_all_string(spark, f"{tmp_path}/x.csv", split=False)
    found = files.scan_csv_all_string(spark, f"{tmp_path}/x.csv")
    assert found.columns == plain.columns and rows_of(found) == rows_of(plain)


def test_ranges_in_order():
    ranges = {"f": [(0, 1, True, True), (10, 0, False, False), (20, 1, True, True), (30, 0, True, False)]}
    assert split_csv.begun_inside(ranges) == {("f", 10): 0, ("f", 20): 0}
