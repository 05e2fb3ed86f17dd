"""Operators for building training data: quality, duplicates, contamination, secrets, tokens, packing, web archives."""
