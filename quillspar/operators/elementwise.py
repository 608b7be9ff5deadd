"""Value maps, norms, bias entries and renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..sources.scratch import tasks

TINY = 1e-10


def map_values(m: SparseMatrix, value: Column) -> SparseMatrix:
    """Every stored value becomes `value`, an expression of i, j and v."""
    return m.with_df(m.df.withColumn("v", value.cast("double")))


def set_values(m: SparseMatrix, c: float) -> SparseMatrix:
    return map_values(m, F.lit(c))


def scale(m: SparseMatrix, c: float) -> SparseMatrix:
    return map_values(m, F.col("v") * F.lit(float(c)))


def shift(m: SparseMatrix, c: float) -> SparseMatrix:
    """Add to stored entries only."""
    return map_values(m, F.col("v") + F.lit(float(c)))


def log_values(m: SparseMatrix) -> SparseMatrix:
    """Natural logarithms; values of at most 1e-10 in size go, negative ones are an error."""
    kept = m.df.where(F.abs("v") > TINY)
    return m.with_df(kept.withColumn("v", F.when(F.col("v") < 0, F.raise_error(F.lit("logarithm of a negative entry")).cast("double")).otherwise(F.log("v"))))


def exp_values(m: SparseMatrix) -> SparseMatrix:
    return map_values(m, F.exp("v"))


def scale_features(m: SparseMatrix, weights: DataFrame) -> SparseMatrix:
    """Multiply each entry by the weight (j, w) of its feature; a missing weight is 1."""
    return m.with_df(m.df.join(weights, "j", "left").withColumn("v", F.col("v") * F.coalesce("w", F.lit(1.0))))


def scale_entities(m: SparseMatrix, weights: DataFrame) -> SparseMatrix:
    """Multiply each entry by the weight (i, w) of its entity; a missing weight is 1."""
    return m.with_df(m.df.join(weights, "i", "left").withColumn("v", F.col("v") * F.coalesce("w", F.lit(1.0))))


def normalise(m: SparseMatrix, kind: str = "L2") -> SparseMatrix:
    """Divide each entity's entries by its norm: "L2", "L1", or "max", the signed maximum (a norm near 0 counts as 1).

    The norms are aggregated before they are joined back, so an entity of many entries never has to fit a task.
    """
    norm = {"L2": F.sqrt(F.sum(F.col("v") * F.col("v"))), "L1": F.sum(F.abs("v")), "max": F.max("v")}[kind]
    least = 1e-8 if kind == "max" else 0.0
    norms = m.df.groupBy("i").agg(norm.alias("norm")).withColumn("norm", F.when(F.abs("norm") <= least, 1.0).otherwise(F.col("norm")))
    return m.with_df(m.df.join(norms, "i").withColumn("v", F.col("v") / F.col("norm")))


def idf(m: SparseMatrix) -> SparseMatrix:
    """Multiply by ln((entities + 1) / (df + 1)), df counting the feature's stored entries."""
    df = m.df.groupBy("j").agg(F.count("*").alias("df"))
    return m.with_df(m.df.join(df, "j").withColumn("v", F.col("v") * F.log(F.lit(float(m.n_rows + 1)) / (F.col("df") + 1))))


def append_bias(m: SparseMatrix, bias: float | DataFrame = 1.0) -> SparseMatrix:
    """One more feature that every entity has, also those without entries; or a frame (i, v) of biases."""
    rows = bias.select("i", F.lit(m.n_cols).cast("long").alias("j"), F.col("v").cast("double")) if isinstance(bias, DataFrame) else m.rows().select("i", F.lit(m.n_cols).cast("long").alias("j"), F.lit(float(bias)).alias("v"))
    return m.with_df(m.df.unionByName(rows), n_cols=m.n_cols + 1)


def remove_bias(m: SparseMatrix) -> SparseMatrix:
    return m.with_df(m.df.where(F.col("j") < m.n_cols - 1), n_cols=m.n_cols - 1)


def renumber_features(m: SparseMatrix, mapping: DataFrame, n_cols: int) -> SparseMatrix:
    """j becomes `to` of mapping (j, to); features that collide stay separate entries."""
    return m.with_df(m.df.join(mapping, "j").select("i", F.col("to").alias("j"), "v"), n_cols=n_cols)


def renumber_entities(m: SparseMatrix, mapping: DataFrame, n_rows: int) -> SparseMatrix:
    """i becomes `to` of mapping (i, to); of entities that collide, the last one stays."""
    last = mapping.groupBy("to").agg(F.max("i").alias("i"))
    return m.with_df(m.df.join(last, "i").select(F.col("to").alias("i"), "j", "v"), n_rows=n_rows)


def transpose(m: SparseMatrix) -> SparseMatrix:
    return SparseMatrix(m.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), m.n_cols, m.n_rows)


def fill_entity(m: SparseMatrix, i: int, vector: DataFrame) -> SparseMatrix:
    """Replace an entity's entries by (j, v)."""
    return m.with_df(m.df.where(F.col("i") != i).unionByName(vector.select(F.lit(i).cast("long").alias("i"), F.col("j").cast("long"), F.col("v").cast("double"))))


def densify(m: SparseMatrix) -> DataFrame:
    """(i, values): each entity as a dense array, zeros included; for narrow matrices."""
    stored = m.df.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("at"))
    found = m.rows().join(stored, "i", "left")
    places = F.sequence(F.lit(0), F.lit(m.n_cols - 1)) if m.n_cols else F.array().cast("array<int>")
    return found.select("i", F.transform(places, lambda j: F.coalesce(F.try_element_at(F.col("at"), j.cast("long")), F.lit(0.0))).alias("values"))


def dense_blocks(m: SparseMatrix, width: int = 16) -> DataFrame:
    """(i, block, entries, values): the parts of each entity's dense array where anything is stored, and its entries there.

    Places count from the part's start. Work follows the stored entries, and not entities times features.
    """
    block = F.floor(F.col("j") / width)
    parts = m.df.repartition(tasks(m.df), "i").groupBy("i", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct((F.col("j") - block * width).alias("j"), "v"))).alias("entries"))
    at = parts.withColumn("at", F.map_from_entries("entries"))
    return at.select("i", "block", "entries", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.coalesce(F.try_element_at(F.col("at"), j.cast("long")), F.lit(0.0))).alias("values"))


def append_dense_bias(dense: DataFrame, bias: float) -> DataFrame:
    return dense.withColumn("values", F.concat("values", F.array(F.lit(float(bias)))))


def constant_dense(spark, n_rows: int, n_cols: int, value: float = 0.0) -> DataFrame:
    return spark.range(n_rows).select(F.col("id").alias("i"), F.array_repeat(F.lit(float(value)), n_cols).alias("values"))
