"""Scores of shortlisted pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix


def link(margin: Column, kind: int, log: bool = False) -> Column:
    """A margin as a score: squared hinge (0), logistic (1), or any other kind its size; or the score's logarithm."""
    if kind == 0:
        gap = F.greatest(F.lit(0.0), 1 - margin)
        return -(gap * gap) if log else F.exp(-(gap * gap))
    if kind == 1:
        return -F.log1p(F.exp(-margin)) if log else 1 / (1 + F.exp(-margin))
    return F.log(F.abs(margin)) if log else F.abs(margin)


def masked_scores(pairs: SparseMatrix, xx: SparseMatrix, yy: SparseMatrix, weights: DataFrame) -> DataFrame:
    """(x, y, t): for listed pairs, sums of xx.v * w * yy.v over the map (xf, yf, w); 0 without a hit."""
    x = xx.df.select(F.col("i").alias("x"), F.col("j").alias("xf"), "v")
    q = x.join(weights, "xf").groupBy("x", "yf").agg(F.sum(F.col("v") * F.col("w")).alias("q"))
    y = yy.df.select(F.col("i").alias("y"), F.col("j").alias("yf"), "v")
    listed = pairs.df.select(F.col("i").alias("x"), F.col("j").alias("y"))
    t = listed.join(y, "y").join(q, ["x", "yf"]).groupBy("x", "y").agg(F.sum(F.col("q") * F.col("v")).alias("t"))
    return listed.join(t, ["x", "y"], "left").select("x", "y", F.coalesce("t", F.lit(0.0)).alias("t"))


def mixed(pairs: SparseMatrix, xx: SparseMatrix, yy: SparseMatrix, model: DataFrame, matches: DataFrame, alpha: float = 0.9, kind: int = 0) -> DataFrame:
    """(x, y, shortlist, bilinear, match, score)."""
    bias = model.where("xf is null").agg(F.coalesce(F.max("w"), F.lit(0.0)).alias("b"))
    t = masked_scores(pairs, xx, yy, model.where("xf is not null")).crossJoin(F.broadcast(bias))  # one row
    bilinear = t.select("x", "y", link(F.col("t") + F.col("b"), kind).alias("bilinear"))
    match = masked_scores(pairs, xx, yy, matches.withColumn("w", F.lit(1.0))).withColumnRenamed("t", "match")
    base = pairs.df.select(F.col("i").alias("x"), F.col("j").alias("y"), F.col("v").alias("shortlist"))
    return base.join(bilinear, ["x", "y"]).join(match, ["x", "y"]).withColumn("score", alpha * F.col("bilinear") + (1 - alpha) * F.col("match"))
