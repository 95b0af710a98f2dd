"""Operators for large training-data pipelines: dedup, mixing, search, extraction, scoring, packing."""
