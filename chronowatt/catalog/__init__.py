"""Every registered query with the ANSI SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL when SQL can express it."""

    def wrap(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return wrap


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import (  # noqa: F401
        consistency,
        energy,
        history,
        mixes,
        seasons,
        timeline,
        air,
        scalars,
        raw_files,
    )

    return QUERIES, ORACLES
