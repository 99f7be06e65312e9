"""The queries that the driver runs, and the SQL that it checks them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the DuckDB SQL of the same rows where there is one."""

    def add(function: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered already")
        _queries[name] = function
        if sql is not None:
            _oracles[name] = sql
        return function

    return add


def _load() -> None:
    from . import domain, functions, identity, mesh, product, relational, streams, teams, views  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of entities by their recent appearances."""
    _load()
    return _queries["entity_scores_v1"](spark, sf_dir)
