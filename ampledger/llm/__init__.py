"""Operators for training corpora: deduplication, scoring, mixing, counting and packing.

Nothing else in the library imports this subpackage.
"""
