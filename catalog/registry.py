"""Collects queries and their checking SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, select: str | None = None, ctes: str = ""):
    """Register a query with its SQL over the feed views, see ``with_views``."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if select is not None:
            ORACLES[name] = with_views(select, ctes)
        return build

    return register
