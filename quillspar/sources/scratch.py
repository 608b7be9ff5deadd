"""Intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of stored input that a task takes, where tables are dealt in proportion to their size.
_SHARE = 1 << 20


def tasks(*frames: DataFrame) -> int:
    """Tasks to deal frames to, so that what one holds doesn't grow with them: by the sizes of the tables they read."""
    sizes = []
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes += [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    spark = frames[0].sparkSession
    if any(s >= 1 << 50 for s in sizes):  # Spark's word for a size it doesn't know
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, -(-sum(sizes) // _SHARE))


class Scratch:
    """Tables that are written once and read from there: cuts lineage and survives lost executors.

    The folder is the one the session names in spark.checkpoint.dir; one of our own only in a local session that
    names none. Leaving a `with` block deletes the tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="quillspar-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            where = f"file://{folder}"
            spark.conf.set("spark.checkpoint.dir", where)
        self.folder = where.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def release(self, *frames: DataFrame) -> None:
        for df in frames:
            _, path = self.paths.pop(id(df))
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.release(*[df for df, _ in self.paths.values()])
