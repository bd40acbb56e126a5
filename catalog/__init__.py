"""Queries over the test tables, each with the SQL that checks it."""

from catalog import backends, merging, runs, selection, streams, tagging, texts
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "backends", "merging", "runs", "selection", "streams", "tagging", "texts"]
