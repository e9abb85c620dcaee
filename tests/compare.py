"""Rows of a query and of its SQL, in a form that can be compared."""

import datetime
import decimal
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def duck(folder: str):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in sorted(os.listdir(folder)):
        path = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
        con.execute(f"create view {name.split('.')[0]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, con, sql):
    found = con.execute(sql)
    want = by_name([d[0] for d in found.description], found.fetchall())
    assert by_name(df.columns, [tuple(r) for r in df.collect()]) == want
