"""Registration of queries with their DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.adapters import SQL_VIEWS, Lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def with_views(sql: str) -> str:
    """The statement with the stand-ins it uses as leading common table expressions."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in SQL_VIEWS:
            if name not in used and re.search(rf"\b(from|join)\s+{name}\b", text, re.I):
                need(SQL_VIEWS[name])
                used.append(name)

    need(sql)
    views = ",\n".join(f"{n} as ({SQL_VIEWS[n]})" for n in used)
    if not views:
        return sql
    return re.sub(r"^\s*with\s+", f"with {views},\n", sql, count=1, flags=re.I) if re.match(r"\s*with\s", sql, re.I) else f"with {views}\n{sql}"


def query(name: str, sql: str | None = None):
    """Registers make(lake) as a query; sql gives the same rows."""

    def add(make: Callable[[Lake], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = lambda spark, folder: make(Lake(spark, folder))
        if sql is not None:
            SQL[name] = with_views(sql)
        return make

    return add


def r2(x: str) -> str:
    return f"round(({x}) + 1e-9::double, 2)"


def dsum(x: str) -> str:
    return f"cast(sum({x}) as double)"


def pct(part: str, whole: str) -> str:
    return r2(f"coalesce(cast({part} as double), 0) * 100 / nullif(cast({whole} as double), 0)")
