"""Operators of a training-data pipeline: sharding, deduplication, search, scoring, cleaning, mixing, packing."""
