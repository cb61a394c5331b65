"""Operators that prepare a training corpus: deduplication, scoring, mixing, packing and counting.

Nothing else in the library imports this subpackage.
"""
