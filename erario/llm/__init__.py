"""Operators for training-data pipelines: quality, deduplication, scoring, packing and sharding."""
