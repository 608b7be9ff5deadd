"""Pair features and the linear learners on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import squared_norm
from ..matrix import SparseMatrix
from ..sources.scratch import Scratch


def pair_features(pairs: SparseMatrix, xx: SparseMatrix, yy: SparseMatrix, pattern: DataFrame) -> DataFrame:
    """(x, y, xf, yf, v): for each pair, the products of feature values over the pattern's feature pairs.

    The pattern cuts a point's features down before labels come in, so no full feature product is made.
    """
    x = xx.df.select(F.col("i").alias("x"), F.col("j").alias("xf"), F.col("v").alias("vx"))
    y = yy.df.select(F.col("i").alias("y"), F.col("j").alias("yf"), F.col("v").alias("vy"))
    y = y.join(pattern.select("yf").distinct(), "yf", "left_semi")
    listed = pairs.df.select(F.col("i").alias("x"), F.col("j").alias("y"))
    return listed.join(y, "y").join(x.join(pattern.select("xf", "yf"), "xf"), ["x", "yf"]).select("x", "y", "xf", "yf", (F.col("vx") * F.col("vy")).alias("v"))


def alike(features: DataFrame, rows: DataFrame, normalise: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Features and rows in which instances of the same features and label are one, under the least of their (x, y).

    Its weight is the sum of theirs, so every loss and slope is the same sum in other words. Features are of unit length
    then, if `normalise`. What a round of `fit` costs follows the kinds of instances and not their number.
    """
    e = F.array_sort(F.collect_list(F.struct("xf", "yf", "v")))
    lists = features.groupBy("x", "y").agg(e.alias("e")).withColumn("_n", F.sqrt(squared_norm(F.col("e"))) if normalise else F.lit(1.0))
    unit = F.transform("e", lambda e: F.struct(e["xf"].alias("xf"), e["yf"].alias("yf"), (e["v"] / F.when(F.col("_n") == 0, 1.0).otherwise(F.col("_n"))).alias("v")))
    kinds = rows.join(lists.select("x", "y", unit.alias("e")), ["x", "y"], "left").groupBy("label", "e").agg(F.min(F.struct("x", "y")).alias("at"), F.sum("c").alias("c"))
    kinds = scratch.stored(kinds.select("at.x", "at.y", "label", "c", "e"), "kinds")
    return kinds.select("x", "y", F.explode("e").alias("e")).select("x", "y", "e.xf", "e.yf", "e.v"), kinds.select("x", "y", "label", "c")


def label_bias_features(pairs: SparseMatrix, yy: SparseMatrix) -> DataFrame:
    """Extra parameters (null, yf), one for each label feature of a pair."""
    y = yy.df.select(F.col("i").alias("y"), F.col("j").alias("yf"), "v")
    return pairs.df.select(F.col("i").alias("x"), F.col("j").alias("y")).join(y, "y").select("x", "y", F.lit(-1).cast("long").alias("xf"), "yf", "v")


def instances(pairs: SparseMatrix, truth: SparseMatrix, cost: float = 1.0, positive_weight: float = 1.0) -> DataFrame:
    """(x, y, label, c): +1 where the pair is true, else -1, and the weight of its loss."""
    true = truth.df.select(F.col("i").alias("x"), F.col("j").alias("y"), F.lit(1).alias("hit"))
    out = pairs.df.select(F.col("i").alias("x"), F.col("j").alias("y")).join(true, ["x", "y"], "left")
    label = F.when(F.col("hit").isNotNull(), 1).otherwise(-1)
    return out.select("x", "y", label.alias("label"), F.when(F.col("hit").isNotNull(), cost * positive_weight).otherwise(cost).alias("c"))


def loss(kind: int, label, margin):
    """Loss and its slope, as expressions."""
    if kind == 0:
        gap = F.greatest(F.lit(0.0), 1 - label * margin)
        return gap * gap, -2 * label * gap
    z = -label * margin
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))), -label / (1 + F.exp(label * margin))


def classifier_cost(kind: int, cost: Column | float, node_n: Column, all_n: Column | float) -> Column:
    """The weight of a node's losses: the cost itself, or for the logistic loss its share for the node's instances."""
    return F.lit(cost) if kind == 0 else F.lit(cost) * node_n / F.lit(all_n)


def _direction(gram: np.ndarray, memory: int) -> np.ndarray:
    """Coefficients of the quasi-Newton direction over steps, turns and gradient, from their scalar products alone."""
    d = np.zeros(2 * memory + 1)
    d[-1] = 1.0
    alphas = {}
    for k in reversed(range(memory)):
        alphas[k] = d @ gram[:, k] / gram[k, memory + k]
        d[memory + k] -= alphas[k]
    if memory:
        d *= gram[memory - 1, 2 * memory - 1] / gram[2 * memory - 1, 2 * memory - 1]
    for k in range(memory):
        d[k] += alphas[k] - d @ gram[:, memory + k] / gram[k, memory + k]
    return d


def _pseudo(w, g, l1: bool):
    """The slope of the whole objective: the regulariser's is added, or for absolute values the nearest of its slopes."""
    if not l1:
        return g + w
    return F.when(w > 0, g + 1).when(w < 0, g - 1).when(g > 1, g - 1).when(g < -1, g + 1).otherwise(F.lit(0.0))


def fit(features: DataFrame, rows: DataFrame, kind: int = 0, rounds: int = 20, normalise: bool = True, tolerance: float = 1e-3, penalty: str = "l2", memory: int = 5) -> DataFrame:
    """(xf, yf, w) minimising penalty + sum of c * loss, with a regularised bias, whose row has null keys.

    The penalty is 0.5 w.w ("l2") or the sum of absolute weights ("l1"), whose minimum has weights that are exactly 0.
    Limited-memory quasi-Newton descent with a backtracking line search; for "l1" by orthants.

    All that grows with the parameters stays in tables: one row for each parameter holds its weight, slope and last
    `memory` steps and turns. A trial joins weights to features and sums margins by instance, an accepted one
    sums slopes by parameter, and the direction comes from the scalar products of the columns, which with the bias's
    own numbers are all that reaches the driver. Each state is written to the shared folder, and its predecessor deleted.
    """
    if kind not in (0, 1) or penalty not in ("l1", "l2"):
        raise ValueError("kind must be 0 (squared hinge) or 1 (logistic), penalty l1 or l2")
    spark, l1 = features.sparkSession, penalty == "l1"
    keep, scratch = Scratch(spark), Scratch(spark)
    features, rows = alike(features, rows, normalise, scratch)
    entries, table = scratch.stored(features, "features"), scratch.stored(rows, "instances")
    keys = ["xf", "yf"]
    lag = [f"{n}{k}" for n in "sy" for k in range(memory)]
    own = {n: 0.0 for n in ["w", "g", *lag]}  # the bias's numbers, as the table has them for each parameter

    def losses(weights: DataFrame, bias: float) -> tuple[DataFrame, float, float]:
        sums = entries.join(weights, keys).groupBy("x", "y").agg(F.sum(F.col("v") * F.col("w")).alias("m"))
        margin = F.coalesce("m", F.lit(0.0)) + bias
        value, slope = loss(kind, F.col("label"), margin)
        out = scratch.stored(table.join(sums, ["x", "y"], "left").select("x", "y", (F.col("c") * slope).alias("slope"), (F.col("c") * value).alias("value")), "slopes")
        total = out.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("f"), F.coalesce(F.sum("slope"), F.lit(0.0)).alias("g")).first()
        return out, total.f, total.g

    def slopes_of(out: DataFrame) -> DataFrame:
        return entries.join(out.select("x", "y", "slope"), ["x", "y"]).groupBy(*keys).agg(F.sum(F.col("slope") * F.col("v")).alias("new_g"))

    def cost(w):
        return F.abs(w) if l1 else w * w / 2

    start = entries.select(*keys).distinct().select(*keys, F.lit(0.0).alias("w"))
    slopes, f, own["g"] = losses(start, 0.0)
    state = scratch.stored(start.join(slopes_of(slopes), keys).withColumnRenamed("new_g", "g").select(*keys, "w", "g", *[F.lit(0.0).alias(n) for n in lag]), "state")
    scratch.release(slopes)
    first, known = None, 0
    for _ in range(rounds):
        names = [*lag[memory - known : memory], *lag[2 * memory - known :]]
        basis = [*[F.col(n) for n in names], _pseudo(F.col("w"), F.col("g"), l1)]
        pairs = [(a, b) for a in range(len(basis)) for b in range(a, len(basis))]
        dots = [F.coalesce(F.sum(basis[a] * basis[b]), F.lit(0.0)).alias(f"d{k}") for k, (a, b) in enumerate(pairs)]
        gram = np.zeros((len(basis), len(basis)))
        for (a, b), x in zip(pairs, state.agg(*dots).first(), strict=True):
            gram[a, b] = gram[b, a] = x
        bias, slope = own["w"], own["g"]  # the bias is one more parameter, whose numbers are here
        bias_q = slope + bias if not l1 else slope + np.sign(bias) if bias else np.sign(slope) * max(0.0, abs(slope) - 1)
        bias_basis = np.array([*(own[n] for n in names), bias_q])
        gram += np.outer(bias_basis, bias_basis)
        size = float(np.sqrt(gram[-1, -1]))
        first = size if first is None else first
        if size <= tolerance * max(first, 1e-12):
            break
        weights = _direction(gram, known)
        q = basis[-1]
        step = -sum((float(c) * x for c, x in zip(weights, basis, strict=True)), F.lit(0.0))
        bias_step = -float(weights @ bias_basis)
        if l1:
            step = F.when(step * q < 0, step).otherwise(F.lit(0.0))
            bias_step = bias_step if bias_step * bias_q < 0 else 0.0
        rate = 1.0 if known else 1 / max(1.0, size)
        side = F.when(F.col("w") != 0, F.signum("w")).otherwise(F.signum(-q))
        while True:
            moved = F.col("w") + rate * step
            if l1:
                moved = F.when(moved * side > 0, moved).otherwise(F.lit(0.0))
            trial = state.select("*", moved.alias("new_w"), q.alias("q"))
            new_bias = bias + rate * bias_step
            if l1 and new_bias * (np.sign(bias) or -np.sign(bias_q)) <= 0:
                new_bias = 0.0
            slopes, value, bias_slope = losses(trial.select(*keys, F.col("new_w").alias("w")), new_bias)
            change = trial.agg(F.sum(cost(F.col("new_w")) - cost(F.col("w"))).alias("p"), F.sum(F.col("q") * (F.col("new_w") - F.col("w"))).alias("d")).first()
            p = (change.p or 0.0) + (abs(new_bias) - abs(bias) if l1 else (new_bias**2 - bias**2) / 2)
            d = (change.d or 0.0) + bias_q * (new_bias - bias)
            if value - f + p <= 1e-4 * d or rate < 1e-8:
                break
            scratch.release(slopes)
            rate /= 2
        # the smooth part's turns; an l2 penalty is smooth, so its own turn counts
        turn = F.col("new_g") - F.col("g") + (F.lit(0.0) if l1 else F.col("new_w") - F.col("w"))
        grown = trial.join(slopes_of(slopes), keys)
        shifted = {**{f"s{k}": F.col(f"s{k + 1}") for k in range(memory - 1)}, f"s{memory - 1}": F.col("new_w") - F.col("w"), **{f"y{k}": F.col(f"y{k + 1}") for k in range(memory - 1)}, f"y{memory - 1}": turn}
        bias_s, bias_y = new_bias - bias, bias_slope - slope + (0.0 if l1 else new_bias - bias)
        new = scratch.stored(grown.select(*keys, F.col("new_w").alias("w"), F.col("new_g").alias("g"), *[c.alias(n) for n, c in shifted.items()]), "state")
        last = F.col(f"s{memory - 1}") * F.col(f"y{memory - 1}")
        if (new.agg(F.sum(last).alias("p")).first().p or 0.0) + bias_s * bias_y > 1e-12:
            for n, x in (("s", bias_s), ("y", bias_y)):
                for k in range(memory - 1):
                    own[f"{n}{k}"] = own[f"{n}{k + 1}"]
                own[f"{n}{memory - 1}"] = x
            known = min(memory, known + 1)
        else:  # a step without a turn tells nothing: the columns stay as they were
            scratch.release(new)
            new = scratch.stored(grown.select(*keys, F.col("new_w").alias("w"), F.col("new_g").alias("g"), *lag), "state")
        own["w"], own["g"], f = new_bias, bias_slope, value
        scratch.release(state, slopes)
        state = new
    bias = spark.createDataFrame([(None, None, own["w"])], "xf long, yf long, w double")
    out = keep.stored(state.select(F.col("xf").cast("long"), F.col("yf").cast("long"), "w").unionByName(bias), "model")
    scratch.release(*[df for df, _ in scratch.paths.values()])
    return out


def residuals(features: DataFrame, rows: DataFrame, model: DataFrame, kind: int = 0, normalise: bool = True, penalty: str = "l2") -> DataFrame:
    """(xf, yf, residual): how far each parameter's slope is from what holds at the minimum; null keys for the bias."""
    pairs = SparseMatrix(rows.select(F.col("x").alias("i"), F.col("y").alias("j"), F.lit(1.0).alias("v")), 0, 0)
    _, slope = loss(kind, F.col("label"), F.col("t"))
    slopes = rows.join(margins(features, pairs, model, normalise), ["x", "y"]).select("x", "y", (F.col("c") * slope).alias("slope"))
    norms = features.groupBy("x", "y").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_n"))
    unit = F.col("v") / F.when(F.col("_n") == 0, 1.0).otherwise(F.col("_n")) if normalise else F.col("v")
    sums = features.join(norms, ["x", "y"]).join(slopes, ["x", "y"]).groupBy("xf", "yf").agg(F.sum(unit * F.col("slope")).alias("g"))
    bias = slopes.agg(F.sum("slope").alias("g")).select(F.lit(None).cast("long").alias("xf"), F.lit(None).cast("long").alias("yf"), "g")
    both = sums.unionByName(bias).alias("a").join(model.alias("b"), F.col("a.xf").eqNullSafe(F.col("b.xf")) & F.col("a.yf").eqNullSafe(F.col("b.yf")))
    return both.select("a.xf", "a.yf", F.abs(_pseudo(F.col("w"), F.col("g"), penalty == "l1")).alias("residual"))


def margins(features: DataFrame, pairs: SparseMatrix, model: DataFrame, normalise: bool = False) -> DataFrame:
    """(x, y, t): the model's margin of each listed pair, its bias included."""
    weights, bias = model.where("xf is not null"), model.where("xf is null").agg(F.coalesce(F.max("w"), F.lit(0.0)).alias("b"))
    sums = features.join(weights, ["xf", "yf"], "left").groupBy("x", "y").agg(F.sum(F.col("v") * F.coalesce("w", F.lit(0.0))).alias("t"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    t = F.col("t") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")) if normalise else F.col("t")
    listed = pairs.df.select(F.col("i").alias("x"), F.col("j").alias("y")).join(sums, ["x", "y"], "left")
    return listed.crossJoin(F.broadcast(bias)).select("x", "y", (F.coalesce(t, F.lit(0.0)) + F.col("b")).alias("t"))  # one row


def accuracy(scored: DataFrame) -> DataFrame:
    """Over (label, t): share of instances and of true pairs on the right side, and their numbers."""
    right = F.col("label") * F.col("t") > 0
    return scored.agg(F.avg(right.cast("double")).alias("accuracy"), F.try_divide(F.count_if(right & (F.col("label") == 1)).cast("double"), F.count_if(F.col("label") == 1)).alias("positive_accuracy"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == -1).alias("negative"))
