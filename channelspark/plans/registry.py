"""Registry of named queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from channelspark.plans.bindings import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``sql`` is its independent check over the named views."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return register


def r(value: Column, digits: int = 6) -> Column:
    """Round a reported double so both engines print the same number."""
    return F.round(value, digits)


def sr(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`r`; adding 0.0 folds -0.0 into 0.0."""
    return f"(ROUND(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
