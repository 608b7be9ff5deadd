"""Expressions over sparse vectors `array<struct<j, v>>` and dense vectors `array<double>`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(dense: Column, j: Column) -> Column:
    return F.coalesce(F.get(dense, j), F.lit(0.0))


def dot(dense: Column, sparse: Column) -> Column:
    return F.aggregate(sparse, F.lit(0.0), lambda s, e: s + _at(dense, e["j"]) * e["v"])


def axpy(a: float, sparse: Column, dense: Column) -> Column:
    """dense + a * sparse."""
    at = F.map_from_entries(sparse)
    return F.transform(dense, lambda v, k: v + F.lit(float(a)) * F.coalesce(F.try_element_at(at, k.cast("long")), F.lit(0.0)))


def squared_norm(sparse: Column) -> Column:
    return F.aggregate(sparse, F.lit(0.0), lambda s, e: s + e["v"] * e["v"])


def dense_norm(dense: Column) -> Column:
    return F.sqrt(F.aggregate(dense, F.lit(0.0), lambda s, v: s + v * v))


def dense_divide(dense: Column, s: Column) -> Column:
    return F.transform(dense, lambda v: v / s)


def dense_normalise(dense: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = dense_norm(dense)
    return dense_divide(dense, F.when(norm == 0, 1.0).otherwise(norm))


def top_entries(sparse: Column, k: int) -> Column:
    """The k largest, ties to the smaller index."""
    flipped = F.transform(sparse, lambda e: F.struct((-e["v"]).alias("n"), e["j"].alias("j")))
    return F.transform(F.slice(F.array_sort(flipped), 1, k), lambda e: F.struct(e["j"].alias("j"), (-e["n"]).alias("v")))
