"""All queries of the reference's operators, by key."""

from quern.queries import analytics, dashboard, gold, layers, operations, quality, rows  # noqa: F401
from quern.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
