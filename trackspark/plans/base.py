"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.registry import Registry
from trackspark.sources.fixtures import read, with_views

REGISTRY = Registry()


def query(name: str, *views: str, sql: str | None = None) -> Callable:
    """Register f(view, view, ...) -> DataFrame as a query over the named views and tables.

    ``sql`` may start with ``select`` or with further ``name as (...)`` definitions."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        oracle = None if sql is None else with_views(sql.strip(), *views)
        REGISTRY.add(name, oracle)(lambda spark, sf_dir: f(*[read(spark, sf_dir, v) for v in views]))
        return f

    return wrap


def r6(c) -> F.Column:
    """Six decimals: enough to compare engines."""
    return F.round(c, 6)
