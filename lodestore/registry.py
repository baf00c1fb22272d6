"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows if there is one."""

    def put(run: Query) -> Query:
        _queries[name] = run
        if sql is not None:
            _sql[name] = sql
        return run

    return put


def _load() -> None:
    from .plans import aggregates, checks, evaluation, extraction, filters, graphs, ingest, knowledge, lifecycle, ranking, retrieval, scalars, sources, streams, upkeep  # noqa: F401


def queries() -> dict[str, Query]:
    """Queries by name."""
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    _load()
    return dict(_sql)
