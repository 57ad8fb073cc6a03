"""Operators for preparing training data at scale (packing, sharding, deduplication, scoring, ...)."""
