"""All queries over the driver's tables: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that must give the same rows."""

    def add(function: Query) -> Query:
        _QUERIES[name] = (function, sql)
        return function

    return add


def _load() -> None:
    from veritrail.plans import catalog, catalog_cases, catalog_decisions, catalog_located, catalog_more, catalog_pages, catalog_words  # noqa: F401  register on import


def queries() -> dict[str, Query]:
    _load()
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _QUERIES.items() if s is not None}
