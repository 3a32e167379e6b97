"""All queries over the test tables, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    """A query and, where SQL can express it, SQL for the same rows."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


_REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Decorator: put a query under ``name``."""

    def add(run):
        if name in _REGISTRY:
            raise ValueError(f"{name} is registered twice")
        _REGISTRY[name] = Query(run, sql)
        return run

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in _REGISTRY.items() if q.sql}
