"""Ranks and the best, least or random k entries of each entity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..matrix import SparseMatrix


def _order(order: str, seed: int = 0):
    """Total orders: by value, ties to the smaller feature; or by a seeded hash."""
    return {"desc": [F.col("v").desc(), F.col("j")], "asc": [F.col("v"), F.col("j")], "random": [F.md5(F.concat_ws("_", "i", "j", F.lit(seed))), F.col("j")]}[order]


def ranks(m: SparseMatrix, order: str = "desc") -> SparseMatrix:
    """Values become ranks within the entity, from 1."""
    return m.with_df(m.df.withColumn("v", F.row_number().over(Window.partitionBy("i").orderBy(*_order(order))).cast("double")))


def keep(m: SparseMatrix, k: int, order: str = "desc", seed: int = 0) -> SparseMatrix:
    """The k first entries of each entity: "desc" the largest, "asc" the smallest, "random" any, the same each time."""
    ranked = m.df.withColumn("_k", F.row_number().over(Window.partitionBy("i").orderBy(*_order(order, seed))))
    return m.with_df(ranked.where(F.col("_k") <= k))


def sample_integers(spark, low: int, high: int, n: int, seed: int = 0):
    """n distinct integers of [low, high], ascending."""
    return spark.range(low, high + 1).orderBy(F.md5(F.concat_ws("_", "id", F.lit(seed))), "id").limit(n).orderBy("id")
