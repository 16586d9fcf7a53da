"""Operators for preparing training data: archives, search, deduplication, scoring, mixing and packing.

Nothing else in the library imports this subpackage; the entry module adds its queries when it is present.
"""
