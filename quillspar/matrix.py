"""Sparse matrices as relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "i long, j long, v double"


@dataclass(frozen=True)
class SparseMatrix:
    """Entries (i, j, v) of entities i and features j, with the shape, which entries alone don't tell.

    Keys (i, j) are unique. An absent entry is 0; stored zeros are legal until `drop_zeros`.
    """

    df: DataFrame
    n_rows: int
    n_cols: int

    @classmethod
    def of(cls, df: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> SparseMatrix:
        """From a frame of i, j, v; a missing dimension is one more than the largest index."""
        df = df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
        if n_rows is None or n_cols is None:
            top = df.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
            n_rows = n_rows if n_rows is not None else (top.i + 1 if top.i is not None else 0)
            n_cols = n_cols if n_cols is not None else (top.j + 1 if top.j is not None else 0)
        return cls(df, n_rows, n_cols)

    @classmethod
    def empty(cls, spark: SparkSession, n_rows: int, n_cols: int) -> SparseMatrix:
        return cls(spark.createDataFrame([], SCHEMA), n_rows, n_cols)

    def with_df(self, df: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> SparseMatrix:
        return SparseMatrix(df.select("i", "j", "v"), self.n_rows if n_rows is None else n_rows, self.n_cols if n_cols is None else n_cols)

    def rows(self) -> DataFrame:
        """All entity ids, with or without entries."""
        return self.df.sparkSession.range(self.n_rows).select(F.col("id").alias("i"))

    def cols(self) -> DataFrame:
        return self.df.sparkSession.range(self.n_cols).select(F.col("id").alias("j"))

    def same_shape(self, other: SparseMatrix) -> None:
        if (self.n_rows, self.n_cols) != (other.n_rows, other.n_cols):
            raise ValueError(f"shapes differ: {self!r} and {other!r}")

    def vectors(self) -> DataFrame:
        """(i, entries): each entity's entries as an array ordered by j."""
        return self.df.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("entries"))

    def __repr__(self) -> str:
        return f"SparseMatrix({self.n_rows} x {self.n_cols})"
