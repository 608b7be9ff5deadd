"""Products of matrices and co-occurrence scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..sources.scratch import Scratch, tasks


#: Features of a row that go to a task together.
_RUN = 1024


def _pairs(a: SparseMatrix, b: SparseMatrix, n: int) -> DataFrame:
    """(i, j, p): products of matches of b (i, k) and a (k, j), dealt to n tasks by i.

    Rows of a meet b's entries in runs, so that what is dealt is a run for each match, and not a row for each product.
    """
    right = b.df.select("i", F.col("j").alias("k"), F.col("v").alias("w"))
    run = F.floor(F.col("j") / _RUN)
    e = F.array_sort(F.collect_list(F.struct((F.col("j") - run * _RUN).cast("int").alias("j"), "v")))
    runs = a.df.groupBy(F.col("i").alias("k"), run.alias("run")).agg(e.alias("e")).select("k", "run", F.col("e.j").alias("js"), F.col("e.v").alias("vs"))
    runs = Scratch(a.df.sparkSession).stored(runs, "runs")  # of a written table Spark knows the size, and sends a small one to all tasks
    dealt = right.join(runs, "k").select("i", "w", "run", "js", "vs").repartition(n, "i")
    return dealt.select("i", "w", "run", F.explode(F.arrays_zip("js", "vs")).alias("e")).select("i", (F.col("run") * _RUN + F.col("e.js")).alias("j"), (F.col("e.vs") * F.col("w")).alias("p"))


def product(a: SparseMatrix, b: SparseMatrix, agg: str = "sum", top: int | None = None, norm_share: float | None = None, by_size: bool = False) -> SparseMatrix:
    """For each entity i of b, the features of a that it reaches: sum, max or mean over k of a[k, j] * b[i, k].

    A max is never below 0; a mean divides by the number of i's entries in b. `top` keeps an entity's best
    (ties: smaller j; `by_size` ranks by absolute value), else `norm_share` keeps values of at least that
    share of the entity's L2 norm. After the one shuffle of `_pairs`, all goes by entity in the same tasks.
    """
    if agg not in ("sum", "max", "mean"):
        raise ValueError(f"no such aggregate: {agg}")
    n = tasks(a.df, b.df)
    pairs = _pairs(a, b, n).groupBy("i", "j")
    if agg == "max":
        out = pairs.agg(F.greatest(F.max("p"), F.lit(0.0)).alias("v"))
    else:
        out = pairs.agg(F.sum("p").alias("v"))
    if agg == "mean":
        sizes = b.df.select("i").repartition(n, "i").groupBy("i").agg(F.count("*").alias("n"))
        out = out.join(sizes, "i").select("i", "j", (F.col("v") / F.col("n")).alias("v"))
    shape = SparseMatrix(out, b.n_rows, a.n_cols)
    if top is not None:
        order = F.abs("v").desc() if by_size else F.col("v").desc()
        return shape.with_df(out.withColumn("_k", F.row_number().over(Window.partitionBy("i").orderBy(order, "j"))).where(F.col("_k") <= top))
    if norm_share is not None:
        norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("i")))
        return shape.with_df(out.withColumn("norm", norm).where(F.col("v") >= norm_share * F.col("norm")))
    return shape


def noisy_top_product(a: SparseMatrix, b: SparseMatrix, top: int, seed: int = 0) -> SparseMatrix:
    """The product's best by value plus seeded noise within 1e-5, which breaks ties at random."""
    out = product(a, b)
    digits = F.substring(F.md5(F.concat_ws("_", "i", "j", F.lit(seed))), 1, 8)
    noise = (F.conv(digits, 16, 10).cast("long") % 2_000_001 - 1_000_000) / 1e11
    return out.with_df(out.df.withColumn("_k", F.row_number().over(Window.partitionBy("i").orderBy((F.col("v") + noise).desc(), "j"))).where(F.col("_k") <= top))


def masked_product(a: SparseMatrix, b: SparseMatrix, pattern: SparseMatrix) -> SparseMatrix:
    """a[j, k] * b[i, k] summed over k for each (i, j) stored in the pattern; places without a match are 0.

    The pattern is joined first, so work follows its size and not that of the full product.
    """
    left = a.df.select(F.col("i").alias("j"), F.col("j").alias("k"), "v")
    right = b.df.select("i", F.col("j").alias("k"), F.col("v").alias("w"))
    places = pattern.df.select("i", "j")
    sums = places.join(right, "i").join(left, ["j", "k"]).groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return pattern.with_df(places.join(sums, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v")))


def multiply(a: SparseMatrix, b: SparseMatrix) -> SparseMatrix:
    """Element-wise product without zeros."""
    a.same_shape(b)
    return a.with_df(a.df.join(b.df.withColumnRenamed("v", "w"), ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v")).where(F.abs("v") > 1e-10))


def association(alpha: float) -> Column:
    """Score of a co-occurrence row (co, f1, f2, a1, a2): a Jaccard coefficient mixed with independent frequencies."""
    return F.col("co") / (F.lit(float(alpha)) * (F.col("f1") + F.col("f2") - F.col("co")) + F.lit(float(1 - alpha)) * F.col("a1") * F.col("a2"))


def best_by(scores: DataFrame, key: str, other: str, k: int, keep_above: float | None = 100.0) -> DataFrame:
    """Rows (key, other, s) among the k best of their key, and any that score above `keep_above`.

    Two branches, so that the ranking alone is pruned before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("s").desc(), F.col(other)))
    top = scores.withColumn("_k", rank).where(F.col("_k") <= k).drop("_k")
    if keep_above is None:
        return top
    return top.unionByName(scores.where(F.col("s") > keep_above)).distinct()


def best_per_group(scores: DataFrame, key: str, other: str, group: str, k: int | None) -> DataFrame:
    """For each key, the best row of each group; of those the k best."""
    first = F.row_number().over(Window.partitionBy(key, group).orderBy(F.col("s").desc(), F.col(other)))
    out = scores.withColumn("_g", first).where("_g = 1").drop("_g")
    if k is None:
        return out
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("s").desc(), F.col(other)))
    return out.withColumn("_k", rank).where(F.col("_k") <= k).drop("_k")


def best_gradients(scores: DataFrame, key: str, other: str, group: str, threshold: float) -> DataFrame:
    """For each key, the best row of each group, if it reaches the threshold."""
    return best_per_group(scores.where(F.col("s") >= threshold), key, other, group, None)


def gradient_score(alpha: float, reg: float) -> Column:
    """(co - alpha t) / (t + reg) with t = a1 a2."""
    t = F.col("a1") * F.col("a2")
    return (F.col("co") - F.lit(float(alpha)) * t) / (t + F.lit(float(reg)))
