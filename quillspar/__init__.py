"""Sparse-relation analytics and zero-shot multi-label ranking on Spark."""

from .matrix import SparseMatrix

__all__ = ["SparseMatrix"]
