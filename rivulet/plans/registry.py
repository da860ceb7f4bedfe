"""Registry of named queries: a Spark builder and, where the result is
SQL-expressible, the DuckDB oracle text over the raw test tables.

Both sides share the binding of ``rivulet.sources.binding``.  Every computed
column is aliased identically on both sides; doubles are rounded to 6 places
at the edge on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    section: str


REGISTRY: dict[str, Query] = {}


def register(name: str, section: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, section)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every module that registers queries."""
    from . import q_core, q_experiments, q_recommend, q_resolve, q_routes, q_streaming, q_text  # noqa: F401
    return REGISTRY
