"""Filters, submatrices and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..sources.scratch import Scratch
from .elementwise import TINY


def threshold(m: SparseMatrix, t: float, ignore_sign: bool = True) -> SparseMatrix:
    """Keep entries strictly above t, in size or (ignore_sign=False) in value."""
    return m.with_df(m.df.where((F.abs("v") if ignore_sign else F.col("v")) > t))


def drop_zeros(m: SparseMatrix) -> SparseMatrix:
    return m.with_df(m.df.where(F.abs("v") > TINY))


def without(m: SparseMatrix, other: SparseMatrix) -> SparseMatrix:
    """Drop every entry whose place is stored in `other`, whatever its value."""
    return m.with_df(m.df.join(other.df.select("i", "j"), ["i", "j"], "left_anti"))


def within(m: SparseMatrix, other: SparseMatrix) -> SparseMatrix:
    return m.with_df(m.df.join(other.df.select("i", "j"), ["i", "j"], "left_semi"))


def pick_features(m: SparseMatrix, wanted: list[int]) -> SparseMatrix:
    """Keep the listed features, renumbered by their place in the list (the last one, if repeated)."""
    at = {j: k for k, j in enumerate(wanted)}
    table = m.df.sparkSession.createDataFrame(list(at.items()), "j long, to long")
    return m.with_df(m.df.join(F.broadcast(table), "j").select("i", F.col("to").alias("j"), "v"), n_cols=len(wanted))


def mask_entities(m: SparseMatrix, wanted: DataFrame, shrink: bool = False) -> SparseMatrix:
    """Keep the entities of (i); `shrink` renumbers them in order, otherwise the others stay, without entries."""
    ids = wanted.select("i").distinct()
    if not shrink:
        return m.with_df(m.df.join(ids, "i", "left_semi"))
    places = positions(ids, "i")
    return m.with_df(m.df.join(places, "i").select(F.col("pos").alias("i"), "j", "v"), n_rows=ids.count())


def positions(ids: DataFrame, key: str) -> DataFrame:
    """(key, pos): 0, 1, ... in the order of distinct keys, by range partitions: counts of each, then ranks within."""
    return _ranked(ids.select(key), key).select(key, "pos")


def _ranked(df: DataFrame, *keys: str) -> DataFrame:
    """df with pos, its rows' places in the order of the keys; the ranges are written once, so that they stay as they are."""
    spark = df.sparkSession
    parts = Scratch(spark).stored(df.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "ranges")
    total, base = 0, []
    for p, n in sorted((r["_p"], r["n"]) for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect()):
        base.append((p, total))
        total += n
    starts = spark.createDataFrame(base, "_p int, _base long")  # a row for each range
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*keys)).cast("long") - 1
    return parts.withColumn("_r", rank).join(F.broadcast(starts), "_p").withColumn("pos", F.col("_base") + F.col("_r")).drop("_p", "_r", "_base")


def chunk(m: SparseMatrix, start: int, count: int) -> SparseMatrix:
    """Entities start .. start+count-1, renumbered from 0."""
    part = m.df.where((F.col("i") >= start) & (F.col("i") < start + count)).withColumn("i", F.col("i") - start)
    return m.with_df(part, n_rows=min(count, max(0, m.n_rows - start)))


def split(m: SparseMatrix, second) -> tuple[SparseMatrix, SparseMatrix]:
    """By a condition on i: entities that don't meet it, and those that do, each renumbered densely."""
    rows = m.rows().withColumn("_b", second)
    return tuple(mask_entities(m, rows.where(F.col("_b") == flag), shrink=True) for flag in (False, True))


def shrink(m: SparseMatrix, wanted: DataFrame) -> tuple[SparseMatrix, DataFrame]:
    """The listed entities, features compacted to those in use; also (j, pos), the features' new places."""
    part = m.df.join(wanted.select("i").distinct(), "i", "left_semi")
    places = positions(part.select("j").distinct(), "j")
    return m.with_df(part.join(places, "j").select("i", F.col("pos").alias("j"), "v"), n_cols=places.count()), places


def seen_labels(yy: SparseMatrix, xy: SparseMatrix) -> SparseMatrix:
    """Label features of labels that some training pair has."""
    return yy.with_df(yy.df.join(xy.df.select(F.col("j").alias("i")).distinct(), "i", "left_semi"))


def ordinals(m: SparseMatrix) -> DataFrame:
    """(i, j, v, ordinal): places of the entries in (i, j) order."""
    return _ranked(m.df, "i", "j").select("i", "j", "v", F.col("pos").alias("ordinal"))


def slice_ordinals(m: SparseMatrix, wanted: DataFrame) -> SparseMatrix:
    """Entries by their ordinals (ordinal)."""
    return m.with_df(ordinals(m).join(wanted.select("ordinal").distinct(), "ordinal", "left_semi"))


def look_up(m: SparseMatrix, places: DataFrame, default: float = 0.0) -> DataFrame:
    """Values at (i, j), or the default."""
    return places.join(m.df, ["i", "j"], "left").withColumn("v", F.coalesce("v", F.lit(float(default))))


def is_empty(m: SparseMatrix) -> bool:
    return m.df.isEmpty()
