"""Operators of a training-data pipeline: search, filters, deduplication, mixing, archives and packing."""
