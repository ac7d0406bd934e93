"""Operators of a training-data pipeline: mixing, scanning, deduplication, packing, scoring and extraction."""
