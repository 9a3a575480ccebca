"""Operators for building training data: archives, deduplication, filters, mixing, token files, search."""
