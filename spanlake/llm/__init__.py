"""Operators for large training-text corpora: scans, quality, deduplication, sharding, tokens, packing."""
