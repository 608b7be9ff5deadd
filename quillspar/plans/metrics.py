"""Precision and gain of rankings, plain and weighted by inverse propensities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..operators.stats import inverse_propensity


def drop_known(scores: SparseMatrix, known: SparseMatrix) -> SparseMatrix:
    """Scores without pairs to ignore and without zeros."""
    return scores.with_df(scores.df.join(known.df.select("i", "j"), ["i", "j"], "left_anti").where("v <> 0"))


def ranking_metrics(scores: SparseMatrix, truth: SparseMatrix, propensity: DataFrame | None = None, k: int = 5) -> DataFrame:
    """(metric, k, value): P, nDCG and, given (id, value) inverse propensities, PSP and PSnDCG at 1..k, times 100.

    Means are over points with a true label. P@k = hits / k. nDCG@k divides a point's gain by that of an ideal
    ranking of its true labels. The weighted ones divide the sum over points by the sum of the best each could
    reach (a ratio of sums).
    """
    weights = truth.df.select("i", "j").join(propensity.select(F.col("id").alias("j"), F.col("value").alias("p")), "j", "left") if propensity is not None else truth.df.select("i", "j").withColumn("p", F.lit(1.0))
    weights = weights.select("i", "j", F.coalesce("p", F.lit(1.0)).alias("p"))
    ranked = scores.df.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.col("v").desc(), "j"))).where(F.col("r") <= k)
    hits = ranked.join(weights, ["i", "j"]).select("i", "r", "p")
    ideal = weights.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.col("p").desc(), "j"))).where(F.col("r") <= k).select("i", "r", F.col("p").alias("best"))
    grid = truth.df.select("i").distinct().withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(k))))
    cells = grid.join(hits, ["i", "r"], "left").join(ideal, ["i", "r"], "left")
    discount = 1 / F.log2(F.col("r") + 1.0)
    up_to = Window.partitionBy("i").orderBy("r")
    hit, best = F.coalesce("p", F.lit(0.0)), F.coalesce("best", F.lit(0.0))
    one = lambda c: F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)
    sums = cells.select("i", "r", *[F.sum(e).over(up_to).alias(n) for n, e in (("h", one("p")), ("dh", one("p") * discount), ("di", one("best") * discount), ("ph", hit), ("pi", best), ("pdh", hit * discount), ("pdi", best * discount))])
    values = sums.groupBy("r").agg(F.avg(F.col("h") / F.col("r")).alias("P"), F.avg(F.coalesce(F.try_divide("dh", "di"), F.lit(0.0))).alias("nDCG"), F.try_divide(F.sum("ph"), F.sum("pi")).alias("PSP"), F.try_divide(F.sum("pdh"), F.sum("pdi")).alias("PSnDCG"))
    names = ["P", "nDCG"] + (["PSP", "PSnDCG"] if propensity is not None else [])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), (100 * F.col(n)).alias("value")) for n in names])).alias("m")
    return values.select(F.col("r").alias("k"), rows).select("m.metric", "k", "m.value")


def evaluate(scores: SparseMatrix, truth: SparseMatrix, train: SparseMatrix, a: float = 0.55, b: float = 1.5, known: SparseMatrix | None = None, k: int = 5) -> DataFrame:
    if known is not None:
        scores = drop_known(scores, known)
    return ranking_metrics(scores, truth, inverse_propensity(train, a, b), k)
