"""Registry of named queries: a Spark builder and, where SQL can state the
same result, the DuckDB oracle text.

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame over the
whole input tables.  Every computed column carries the same alias in the
builder and in the SQL; doubles are rounded to 6 decimals in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}


def register(name: str, operators: tuple[str, ...] | str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        OPERATORS[name] = (operators,) if isinstance(operators, str) else tuple(operators)
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco
