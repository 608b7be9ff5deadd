"""Scoring of points that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..matrix import SparseMatrix
from ..plans.mining import Maps
from ..plans.params import Params
from ..plans.pipeline import predict
from ..sources.scratch import Scratch


def score_stream(entries: DataFrame, n_cols: int, labels: SparseMatrix, maps: Maps, model: DataFrame, params: Params, path: str, checkpoint: str) -> StreamingQuery:
    """Rank labels for each micro-batch of whole points (i, j, v); a batch is written under its number, once."""

    def one(batch: DataFrame, number: int) -> None:
        points = SparseMatrix.of(batch, n_cols=n_cols)
        with Scratch(batch.sparkSession) as scratch:
            predict(points, labels, maps, model, params, scratch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return entries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
