"""Operators of a training-data pipeline: extraction, deduplication, filtering, privacy and tokens."""
