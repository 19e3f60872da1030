"""Operators of a training-data pipeline: quality, search, deduplication, tokens, packing, archives.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
