"""Candidate labels for points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..sources.scratch import Scratch, tasks

LEVELS = 20


def level(m: Column) -> Column:
    """The smallest n in 0..19 with m >= 2^-n, else null; comparisons only, so that engines agree."""
    out = F.when(m >= 1.0, 0)
    for n in range(1, LEVELS):
        out = out.when(m >= 2.0**-n, n)
    return out


def alike(yy: SparseMatrix, weights: DataFrame, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Labels with the same entries on the map's label features, which every point reaches with the same contributions.

    (c, n, yf, v): a group's least label, its number of labels and its entries; (c, y): its k least labels, which are
    all that can be among the k best of a point, as ties go to the smaller label.
    """
    used = weights.select("yf").distinct()
    y = yy.df.select(F.col("i").alias("y"), F.col("j").alias("yf"), "v").join(used, "yf")
    kinds = scratch.stored(y.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("yf", "v"))).alias("kind")), "kinds")
    groups = kinds.groupBy("kind").agg(F.min("y").alias("c"), F.count("*").alias("n"))
    entries = groups.select("c", "n", F.explode("kind").alias("e")).select("c", "n", "e.yf", "e.v")
    first = Window.partitionBy("kind").orderBy("y")
    least = kinds.withColumns({"_k": F.row_number().over(first), "c": F.min("y").over(first)}).where(F.col("_k") <= k)
    return scratch.stored(entries, "groups"), scratch.stored(least.select("c", "y"), "members")


def reach(xx: SparseMatrix, groups: DataFrame, weights: DataFrame) -> DataFrame:
    """(x, c, n, m, s): largest and summed contributions of label features, points reaching them through the map.

    One join feeds both aggregates. Contributions of label weights above 1 are held to what reached the feature.
    Points are dealt once, to tasks in proportion to their entries; all that follows goes by point.
    """
    x = xx.df.select(F.col("i").alias("x"), F.col("j").alias("xf"), "v")
    at = x.join(weights, "xf").select("x", "yf", (F.col("v") * F.col("w")).alias("q")).repartition(tasks(xx.df), "x")
    p = at.groupBy("x", "yf").agg(F.sum("q").alias("p"))
    c = F.col("p") * F.col("v")
    return p.join(groups, "yf").groupBy("x", "c").agg(F.max("n").alias("n"), F.max(F.least(F.col("p"), c)).alias("m"), F.sum(c).alias("s"))


def _best(rows: DataFrame, members: DataFrame, k: int, xx: SparseMatrix, yy: SparseMatrix) -> SparseMatrix:
    """The k best labels of each point: only groups that fewer than k labels surpass are expanded."""
    rows = rows.withColumn("_n", F.sum("n").over(Window.partitionBy("x").orderBy(F.col("s").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("_s", F.max(F.when(F.col("_n") >= k, F.col("s"))).over(Window.partitionBy("x"))).where("_s is null or s >= _s")
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.col("s").desc(), "y"))
    best = rows.select("x", "c", "s").join(members, "c").withColumn("_k", rank).where(F.col("_k") <= k)
    return SparseMatrix(best.select(F.col("x").alias("i"), F.col("y").alias("j"), F.col("s").alias("v")), xx.n_rows, yy.n_rows)


def shortlist(xx: SparseMatrix, yy: SparseMatrix, weights: DataFrame, k: int = 100, factor: int = 10, scratch: Scratch | None = None) -> SparseMatrix:
    """The k best labels of each point among its candidates.

    Candidates come level by level, a level halving the contribution asked for, as long as the levels before
    hold fewer than factor * k. Labels that are alike for the map stand in one row with their number, so the rows of
    a point don't grow with the labels but with their kinds; tables of those go to the scratch.
    """
    groups, members = alike(yy, weights, k, scratch or Scratch(xx.df.sparkSession))
    rows = reach(xx, groups, weights).withColumn("lev", level(F.col("m"))).where("lev is not null")
    before = F.sum("n").over(Window.partitionBy("x").orderBy("lev").rangeBetween(Window.unboundedPreceding, -1))
    return _best(rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < factor * k), members, k, xx, yy)


def exact_shortlist(xx: SparseMatrix, yy: SparseMatrix, weights: DataFrame, k: int = 100, scratch: Scratch | None = None) -> SparseMatrix:
    """The k best labels of each point by the full product, labels that are alike for the map in one row."""
    groups, members = alike(yy, weights, k, scratch or Scratch(xx.df.sparkSession))
    return _best(reach(xx, groups, weights), members, k, xx, yy)
