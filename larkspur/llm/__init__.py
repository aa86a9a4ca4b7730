"""Operators for preparing training corpora: deduplication, sharding, search, binary token files, mixing and filtering.

Nothing else in the library imports this subpackage.
"""
