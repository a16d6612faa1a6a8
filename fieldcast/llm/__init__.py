"""Operators that prepare training text: deduplication, near-duplicates, scoring, encoding and packing."""
