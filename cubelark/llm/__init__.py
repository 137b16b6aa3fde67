"""Corpus operators for training data: dedup, search, counting, scoring, mixing and packing.

Nothing outside this subpackage imports it.
"""
