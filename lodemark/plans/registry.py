"""All registered queries, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.governance import Governance, oracle

_QUERIES: dict[str, Callable[[Governance], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function from the governance tables to a DataFrame."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is there already")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = oracle(sql)
        return f

    return add


def sql(name: str) -> str:
    """The SQL of a query that is registered already, to build on."""
    return _SQL[name]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import business, chains, code, evaluation, evidence, governance, lifecycle, modules, scanning, scores, sources, streams, trends  # noqa: F401

    return {k: (lambda spark, sf_dir, f=f: f(Governance(spark, sf_dir))) for k, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
