"""Operators of a training-data pipeline: filtering, scoring, deduplicating, mixing, packing and sharding."""
