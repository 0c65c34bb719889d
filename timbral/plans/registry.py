"""Where queries and their SQL counterparts are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Registers a query under its function's name; sql: the same rows in ANSI SQL, None where SQL can't."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def u(purpose: str, *keys: str) -> str:
    """The SQL of functions.draws.draw."""
    return f"(('0x' || substr(md5(concat_ws('|', '42', {', '.join(f'{k}::varchar' for k in keys)}, '{purpose}')), 1, 8))::bigint / 4294967296.0::double)"
