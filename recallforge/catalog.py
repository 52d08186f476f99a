"""All queries of the retrieval engine with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``, with the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    import recallforge.plans  # noqa: F401  (registers)

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    import recallforge.plans  # noqa: F401

    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["hybrid_search"](spark, sf_dir)
