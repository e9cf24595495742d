"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it, so the rest of the library works
without it.
"""
