"""The query registry shared by the catalog modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Q = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Q, str | None]] = {}


def register(key: str, sql: str | None = None):
    """Register a Spark query under ``key`` with its DuckDB oracle SQL
    (None -> rows-only check, covered by unit tests)."""
    def deco(fn: Q) -> Q:
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = (fn, sql)
        return fn
    return deco
