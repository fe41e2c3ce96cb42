"""Registry of named queries and of the equivalent SQL used to check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import patterns as P
from .fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Register ``fn(spark, sf_dir)``; ``sql`` is DuckDB text over the test tables and the named views."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn
    return wrap


def re2(pattern: str) -> str:
    """A detector pattern in RE2 syntax, as a quoted SQL literal."""
    p = pattern.replace(P.LINE_START, "(?m:^)").replace(P.B, r"\b").replace(P.L, r"\b").replace(P.R, r"\b").replace("(?iu)", "(?i)")
    p = p.replace(r"(?!000|666|9\d{2})", "").replace("(?!00)", "").replace("(?!0000)", "")
    return "'" + p.replace("'", "''") + "'"
