"""Registry of named queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


_QUERIES: dict[str, Query] = {}
_MODULES = ["cleaning", "evaluation", "report", "tables", "corpus", "vectors", "clustering", "trainlog", "files", "streams"]


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query; without ``sql`` it is covered by the fixture tests alone."""

    def add(run: Run) -> Run:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = Query(name, run, sql)
        return run

    return add


def all_queries() -> dict[str, Query]:
    for module in _MODULES:
        import_module(f"helixframe.plans.queries.{module}")
    return dict(_QUERIES)
