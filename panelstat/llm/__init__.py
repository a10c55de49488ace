"""Operators of a training-data pipeline: counting, sharding, deduplication, scoring, extraction, packing."""
