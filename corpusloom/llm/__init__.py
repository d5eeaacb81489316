"""Operators for preparing text corpora for model training.

Nothing outside this package imports it; it may import the rest of the library.
"""
