"""Operators that prepare training text: filters, near-duplicates, tokens, archives and packing.

Nothing else in the library imports this subpackage.
"""
