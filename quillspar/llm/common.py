"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: long texts must not add up in a Python worker.
BATCH_ROWS = 1000
#: Bytes that the numpy kernels look at together.
BLOCK_BYTES = 1 << 20
#: The white space of the contracts, `[\x20\x09-\x0D]`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillspar-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what `stored` wrote for frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings into a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads, so that others can't clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty), and where each text starts; one more offset ends the last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def in_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes; a longer text is a range of its own."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, which: str = "up") -> np.ndarray:
    """The first n powers of the hash's base, or of its inverse, modulo 2^64."""
    if len(_powers[which]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        steps = np.full(size, _BASE if which == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which][:n]


class RollingHash:
    """Polynomial hashes of every substring of some bytes, from one array of prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * powers(len(data)), out=self.sums[1:])
        self.down = powers(len(data) + 1, "down")

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of [start, end)."""
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def every(self, width: int) -> np.ndarray:
        """Mixed hashes of all windows of a width."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): (node, component), component being the smallest node reachable.

    Each round maps every node to the least of itself and its neighbours and keeps the links between
    different images, so a star is gone after one round; nodes without links don't appear. Rounds are
    written to the shared folder; nothing but one emptiness flag a round reaches the driver.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links = stored(edges.where("a <> b").select(low, high).distinct(), "links")
    labels, steps = None, []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "step")
        if labels is None:
            labels = step.select("node", F.col("to").alias("component"))
        else:
            on, old = step.select(F.col("node").alias("component"), "to"), labels
            labels = stored(labels.join(on, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
            if len(steps) > 1:
                release(old)
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = links.join(a, "a").join(b, "b").where("x <> y")
        old, links = links, stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        release(old)
        steps.append(step)
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    release(links, *steps[1:])  # the first step holds the labels of a single round
    return labels
