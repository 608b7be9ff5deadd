"""Sums, differences, maxima and concatenations of matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix


def add(a: SparseMatrix, b: SparseMatrix, coefficient: float = 1.0) -> SparseMatrix:
    """a + coefficient * b over the union of places; zeros that arise stay stored."""
    a.same_shape(b)
    both = a.df.unionByName(b.df.withColumn("v", F.col("v") * F.lit(float(coefficient))))
    return a.with_df(both.groupBy("i", "j").agg(F.sum("v").alias("v")))


def difference(a: SparseMatrix, b: SparseMatrix) -> SparseMatrix:
    return add(a, b, -1.0)


def larger(a: SparseMatrix, b: SparseMatrix) -> SparseMatrix:
    """The larger value of each place. One that only b has is at least 0; one that only a has stays; zeros go."""
    a.same_shape(b)
    both = a.df.join(b.df.withColumnRenamed("v", "w"), ["i", "j"], "full_outer")
    value = F.when(F.col("w").isNull(), F.col("v")).otherwise(F.greatest(F.coalesce("v", F.lit(0.0)), F.col("w")))
    return a.with_df(both.select("i", "j", value.alias("v")).where(F.abs("v") > 1e-10))


def stack_entities(a: SparseMatrix, b: SparseMatrix) -> SparseMatrix:
    """b's entities after a's."""
    if a.n_cols != b.n_cols:
        raise ValueError(f"features differ: {a!r} and {b!r}")
    return a.with_df(a.df.unionByName(b.df.withColumn("i", F.col("i") + a.n_rows)), n_rows=a.n_rows + b.n_rows)


def append_entity(a: SparseMatrix, vector: DataFrame) -> SparseMatrix:
    row = vector.select(F.lit(a.n_rows).cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    return a.with_df(a.df.unionByName(row), n_rows=a.n_rows + 1)


def stack_features(a: SparseMatrix, b: SparseMatrix) -> SparseMatrix:
    """b's features after a's, for the same entities."""
    if a.n_rows != b.n_rows:
        raise ValueError(f"entities differ: {a!r} and {b!r}")
    return a.with_df(a.df.unionByName(b.df.withColumn("j", F.col("j") + a.n_cols)), n_cols=a.n_cols + b.n_cols)
