"""Registration of named queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vouchsafe.plans.oracle_views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_CHECKS: dict[str, tuple[str, tuple[str, ...]]] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its equivalent for the checking engine over ``views``."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            _CHECKS[name] = (sql, views)
        return fn

    return register


def oracles() -> dict[str, str]:
    """Complete checking SQL of every query that has one."""
    return {name: with_views(views, sql) for name, (sql, views) in _CHECKS.items()}
