"""Operators for preparing training data: filtering, deduplication, search, scoring, mixing, packing and archives."""
