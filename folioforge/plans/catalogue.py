"""Registry of the catalogue queries: one per operator, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "j2_fuzzy_topk"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL if it has one."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)


def load() -> None:
    """Import the modules that register queries."""
    from . import entity_queries, more_queries, scoring_queries, source_queries, table_queries, text_queries  # noqa: F401
