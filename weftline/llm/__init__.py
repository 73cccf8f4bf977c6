"""Operators that prepare training corpora: filters, de-duplication, search, tokenising and packing.

Nothing outside this package imports it.
"""
