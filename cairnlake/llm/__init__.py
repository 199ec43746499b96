"""Operators for building training data: splitting, membership, encoding, packing, subjects.

Nothing else in the library imports this sub-package.
"""
