"""Operators of a training-data pipeline: scoring, search, deduplication, scanning and mixing of text."""
