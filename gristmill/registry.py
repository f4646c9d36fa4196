"""Named queries and their SQL. Modules of `plans` fill the two dictionaries as they are imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under a name, with the SQL of its rows if there is one."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def load() -> None:
    from gristmill.plans import bookkeeping, calls, curate, evaluate, files, report, runs, sources, streams  # noqa: F401
