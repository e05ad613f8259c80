"""Operators of a training-data pipeline: scans, deduplication, packing, search, archives."""
