"""Operators for building training corpora: filtering, deduplication, search, packing and token output.

Nothing outside this subpackage imports it.
"""
