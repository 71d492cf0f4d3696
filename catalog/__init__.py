"""Named queries over the test tables, each with an equivalent SQL statement where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function (spark, sf_dir) -> DataFrame and its SQL twin."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query name: {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    """Import every catalog module once."""
    from catalog import boosting, calibration, evaluation, extraction, files, merging, overlaps, records, scoring, splitting, streams  # noqa: F401
