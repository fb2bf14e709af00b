"""Operators of a training-data pipeline: counting, sharding, filtering, deduplication, scoring."""
