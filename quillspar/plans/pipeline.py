"""Mine, train, predict and evaluate over tables."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..operators.elementwise import normalise, set_values
from ..operators.select import seen_labels
from ..operators.stats import recall
from ..sources import formats
from ..sources.scratch import Scratch
from . import learner, metrics, scoring
from .mining import Maps, mine
from .params import Params
from .shortlist import shortlist


@dataclass(frozen=True)
class Inputs:
    """Points and labels by features, training pairs, and the features' names."""

    xx: SparseMatrix
    yy: SparseMatrix
    xy: SparseMatrix
    wf: DataFrame
    wl: DataFrame


def prepare(xx: SparseMatrix | None = None, xy: SparseMatrix | None = None, yy: SparseMatrix | None = None, weighted: bool = False) -> tuple[SparseMatrix | None, ...]:
    """Points and labels of unit length; with `weighted`, all training pairs count 1 whatever their stored value."""
    return (xx and normalise(xx)), (set_values(xy, 1.0) if xy and weighted else xy), (yy and normalise(yy))


def mine_maps(data: Inputs, p: Params, scratch: Scratch | None = None) -> Maps:
    """Stage A: seen labels only, features as present or absent."""
    return mine(data.xx, seen_labels(data.yy, data.xy), data.xy, data.wf, data.wl, p.bs_count, p.bs_alpha, p.bs_threshold, p.bs_direct_wt, scratch)


def train(data: Inputs, maps: Maps, p: Params, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Stage B: the model, and a row of what it rests on (recall of the shortlist)."""
    scratch = scratch or Scratch(data.xx.df.sparkSession)
    xx, _, yy = prepare(data.xx, None, seen_labels(data.yy, data.xy))
    short = shortlist(xx, yy, maps.pattern, p.shortyK, p.F, scratch)
    short = short.with_df(scratch.stored(short.df, "shortlist"))
    features = learner.pair_features(short, xx, yy, maps.pattern)
    if p.bilinear_add_bias:
        features = features.unionByName(learner.label_bias_features(short, yy))
    rows = learner.instances(short, data.xy, p.bilinear_classifier_cost, p.bilinear_classifier_pos_wt)
    model = learner.fit(features, rows, p.bilinear_classifier_kind, p.bilinear_classifier_maxitr, p.bilinear_normalize)
    return model, recall(set_values(short, 1.0), set_values(data.xy, 1.0))


def predict(points: SparseMatrix, labels: SparseMatrix, maps: Maps, model: DataFrame, p: Params, scratch: Scratch | None = None) -> DataFrame:
    """Stage C: all labels are candidates, also those that no training pair has. The shortlist is written to the scratch."""
    scratch = scratch or Scratch(points.df.sparkSession)
    xx, _, yy = prepare(points, None, labels)
    short = shortlist(xx, yy, maps.pattern, p.shortyK, p.F, scratch)
    short = short.with_df(scratch.stored(short.df, "shortlist"))
    return scoring.mixed(short, xx, yy, model, maps.matches, p.score_alpha, p.bilinear_classifier_kind)


def main(args: list[str]) -> None:
    """Command line: stages hand over through Parquet tables in model_dir; scores and metrics go to res_dir."""
    spark = SparkSession.builder.appName("quillspar").getOrCreate()
    with Scratch(spark) as scratch:
        run(spark, Params.parse(args), scratch)


def run(spark: SparkSession, p: Params, scratch: Scratch) -> None:
    read = lambda path: formats.read_matrix(spark, path)
    yy, wf, wl = read(p.Y_Yf), formats.read_names(spark, p.Xf), formats.read_names(spark, p.Yf)
    table = lambda name: f"{p.model_dir}/{name}.parquet"
    if p.type in ("all", "train", "xhtp_approx", "xhtp_fine_tune"):
        data = Inputs(read(p.trn_X_Xf), yy, read(p.trn_X_Y), wf, wl)
    if p.type in ("all", "train", "xhtp_approx"):
        maps = mine_maps(data, p, scratch)
        for name, df in (("by_point", maps.by_point), ("by_label", maps.by_label), ("matches", maps.matches)):
            df.write.mode("overwrite").parquet(table(name))
    maps = Maps(*(spark.read.parquet(table(n)) for n in ("by_point", "by_label", "matches")))
    if p.sparsity_pattern_file:
        maps = Maps(spark.read.parquet(p.sparsity_pattern_file), maps.by_label.limit(0), maps.matches)
    if p.type in ("all", "train", "xhtp_fine_tune"):
        model, found = train(data, maps, p, scratch)
        model.write.mode("overwrite").parquet(table("model"))
        found.write.mode("overwrite").parquet(table("recall"))
    if p.type in ("all", "predict"):
        scores = predict(read(p.tst_X_Xf), yy, maps, spark.read.parquet(table("model")), p, scratch)
        scores.write.mode("overwrite").parquet(f"{p.res_dir}/scores.parquet")
        if p.tst_X_Y:
            truth, made = read(p.tst_X_Y), spark.read.parquet(f"{p.res_dir}/scores.parquet")
            ranked = SparseMatrix(made.select(F.col("x").alias("i"), F.col("y").alias("j"), F.col("score").alias("v")), truth.n_rows, truth.n_cols)
            metrics.evaluate(ranked, truth, read(p.trn_X_Y), p.propensity_A, p.propensity_B).write.mode("overwrite").parquet(f"{p.res_dir}/metrics.parquet")


if __name__ == "__main__":
    main(sys.argv[1:])
