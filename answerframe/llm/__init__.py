"""Operators for preparing training data: scoring, deduplication, search, mixing and packing."""
