"""Where the modules of this package register their queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, build: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str | None = None, **defined: str) -> None:
    """build gets a function that returns a table or view by name; sql names them in braces."""
    QUERIES[name] = lambda spark, sf_dir: build(lambda what: view(spark, sf_dir, what))
    if sql:
        ORACLE[name] = duck(sql, **defined)
