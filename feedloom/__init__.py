"""Incremental content enrichment of feed articles, expressed as Spark jobs."""

from feedloom.options import EnrichOptions

__all__ = ["EnrichOptions"]
