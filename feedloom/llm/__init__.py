"""Operators of a training-data pipeline: scoring, near-duplicates, filters, counts and packing."""
