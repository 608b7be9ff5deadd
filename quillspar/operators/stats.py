"""Counts, sums, extremes, norms and propensities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix


def _along(m: SparseMatrix, axis: int, value, wanted: DataFrame | None = None, filled: bool = True) -> DataFrame:
    """(id, value) by entity (axis 0) or feature (axis 1), 0 where nothing is stored."""
    key, every = ("i", m.rows()) if axis == 0 else ("j", m.cols())
    df = m.df if wanted is None else m.df.join(wanted.select("i").distinct(), "i", "left_semi")
    found = df.groupBy(key).agg(value.alias("value"))
    if filled:
        found = every.join(found, key, "left").select(key, F.coalesce("value", F.lit(0)).alias("value"))
    return found.select(F.col(key).alias("id"), "value")


def frequency(m: SparseMatrix, axis: int) -> DataFrame:
    return _along(m, axis, F.count("*"))


def total(m: SparseMatrix, axis: int) -> DataFrame:
    return _along(m, axis, F.sum("v"))


def maximum(m: SparseMatrix, axis: int, wanted: DataFrame | None = None) -> DataFrame:
    """Of stored entries; 0 where there are none."""
    return _along(m, axis, F.max("v"), wanted)


def minimum(m: SparseMatrix, axis: int, wanted: DataFrame | None = None) -> DataFrame:
    return _along(m, axis, F.min("v"), wanted)


def norms(m: SparseMatrix) -> DataFrame:
    return _along(m, 0, F.sqrt(F.sum(F.col("v") * F.col("v"))))


def nnz(m: SparseMatrix) -> DataFrame:
    return m.df.agg(F.count("*").alias("nnz"))


def bytes_estimate(m: SparseMatrix) -> int:
    """Catalyst's size estimate of the entries."""
    return int(str(m.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def recall(m: SparseMatrix, truth: SparseMatrix) -> DataFrame:
    """Percentage of the true entries that m has; a product of at most 1e-10 doesn't count."""
    hits = m.df.join(truth.df.withColumnRenamed("v", "w"), ["i", "j"]).where(F.col("v") * F.col("w") > 1e-10).agg(F.count("*").alias("hits"))
    return hits.crossJoin(truth.df.agg(F.count("*").alias("n"))).select((F.lit(100.0) * F.try_divide("hits", "n")).alias("recall"))  # one row each


def active_features(m: SparseMatrix, wanted: DataFrame | None = None) -> DataFrame:
    """(id, value): features in use by the listed entities, with counts."""
    return _along(m, 1, F.count("*"), wanted, filled=False)


def signs(values: DataFrame, column: str) -> DataFrame:
    """How many values are +1, and how many are not."""
    return values.agg(F.count_if(F.col(column) == 1).alias("positive"), F.count_if(F.col(column) != 1).alias("other"))


def inverse_propensity(xy: SparseMatrix, a: float = 0.55, b: float = 1.5, scaled: bool = False) -> DataFrame:
    """(id, value): 1 + C (f + B)^-A of each label, f its frequency in xy; `scaled` divides by the largest."""
    c = (math.log(xy.n_rows) - 1) * (b + 1) ** a
    out = _along(xy, 1, F.count("*")).withColumn("value", 1 + c * F.exp(-a * F.log(F.col("value") + b)))
    if not scaled:
        return out
    return out.crossJoin(out.agg(F.max("value").alias("top"))).select("id", (F.col("value") / F.col("top")).alias("value"))


def weighted_labels(xy: SparseMatrix, a: float = 0.55, b: float = 1.5) -> SparseMatrix:
    """xy with each pair's value set to its label's scaled inverse propensity."""
    ips = inverse_propensity(xy, a, b, scaled=True).withColumnRenamed("id", "j")
    return xy.with_df(xy.df.join(ips, "j").select("i", "j", F.col("value").alias("v")))
