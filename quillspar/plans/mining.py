"""Associations between point features and label features, and matches of their names.

xx and yy are matrices of points and labels by their features, xy of points by labels.
Maps are frames (xf, yf, w).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..operators.products import association, best_by
from ..sources.scratch import Scratch


def cooccurrences(xx: SparseMatrix, yy: SparseMatrix, xy: SparseMatrix) -> DataFrame:
    """(xf, yf, co, f1, f2, a1, a2): pairs with both features, with either, points and labels with them.

    A pair's labels are first summed to label features of its point, so the last join has a row per
    (point, label feature) and not per pair.
    """
    x = xx.df.select(F.col("i").alias("x"), F.col("j").alias("xf"))
    y = yy.df.select(F.col("i").alias("y"), F.col("j").alias("yf"))
    pairs = xy.df.select(F.col("i").alias("x"), F.col("j").alias("y"))
    x_yf = pairs.join(y, "y").groupBy("x", "yf").agg(F.count("*").alias("n"))
    co = x_yf.join(x, "x").groupBy("xf", "yf").agg(F.sum("n").alias("co"))
    per_x = pairs.groupBy("x").agg(F.count("*").alias("n"))
    f1 = x.join(per_x, "x", "left").groupBy("xf").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("f1"), F.count("*").alias("a1"))
    f2 = x_yf.groupBy("yf").agg(F.sum("n").alias("f2")).join(y.groupBy("yf").agg(F.count("*").alias("a2")), "yf")
    return co.join(f1, "xf").join(f2, "yf")


def scored(xx: SparseMatrix, yy: SparseMatrix, xy: SparseMatrix, alpha: float) -> DataFrame:
    """(xf, yf, s): one score table, of which both maps are cuts, as the score is the same either way round."""
    return cooccurrences(xx, yy, xy).select("xf", "yf", association(alpha).alias("s"))


def cut(scores: DataFrame, key: str, other: str, k: int, threshold: float) -> DataFrame:
    """The k best of each key above the threshold, less the threshold."""
    best = best_by(scores, key, other, k).where(F.col("s") > threshold)
    return best.select("xf", "yf", (F.col("s") - F.lit(float(threshold))).alias("w"))


def after_prefix(name: Column) -> Column:
    """A name after its first underscore; all of it, if it has none."""
    return F.regexp_replace(name, "^[^_]*_", "")


def name_matches(wf: DataFrame, wl: DataFrame, weight: float = 1.0) -> DataFrame:
    """(xf, yf, w): label features whose name after the prefix is a point feature's name (the last id, if repeated)."""
    points = wf.groupBy("name").agg(F.max("id").alias("xf"))
    labels = wl.select(F.col("id").alias("yf"), after_prefix(F.col("name")).alias("name"))
    return labels.join(points, "name").select("xf", "yf", F.lit(float(weight)).alias("w"))


def add_maps(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("xf", "yf").agg(F.sum("w").alias("w"))


def dedupe(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a whose pair b hasn't got."""
    return a.join(b.select("xf", "yf"), ["xf", "yf"], "left_anti")


@dataclass(frozen=True)
class Maps:
    by_point: DataFrame
    by_label: DataFrame
    matches: DataFrame

    @property
    def pattern(self) -> DataFrame:
        """Both maps together; they have no pair in common."""
        return self.by_point.unionByName(self.by_label)


def mine(xx: SparseMatrix, yy: SparseMatrix, xy: SparseMatrix, wf: DataFrame, wl: DataFrame, k: int = 10, alpha: float = 0.2, threshold: float = 0.0, direct_weight: float = 0.2, scratch: Scratch | None = None) -> Maps:
    """Both maps and the name matches; the score table is written once, to a scratch that outlives the maps' use."""
    scores = (scratch or Scratch(xx.df.sparkSession)).stored(scored(xx, yy, xy, alpha), "scores")
    by_point, by_label = cut(scores, "xf", "yf", k, threshold), cut(scores, "yf", "xf", k, threshold)
    matches = name_matches(wf, wl)
    if direct_weight > 0:
        by_point = add_maps(by_point, matches.withColumn("w", F.lit(float(direct_weight))))
    by_label = dedupe(by_label, by_point)
    return Maps(by_point.where(F.abs("w") > 1e-10), by_label.where(F.abs("w") > 1e-10), matches)
