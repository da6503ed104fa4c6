"""Names of queries, how they run, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.derived import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, tables: str | None = None, body: str | None = None):
    """Register a function of (spark, sf_dir); ``tables`` are the derived ones that the SQL reads."""

    def wrap(f):
        QUERIES[name] = f
        if body is not None:
            ORACLE_SQL[name] = sql(tables or "", body)
        return f

    return wrap
