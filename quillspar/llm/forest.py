"""Approximate nearest neighbours with a hash-prefix forest."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, small_batches


class PrefixForest:
    """Trees over some vectors, each a sorted array of hash strings.

    A vector's string in a tree is the signs of its products with the tree's own random orthogonal directions,
    first bit first, so vectors under a node of the tree are those that share a prefix: a range of the array.
    """

    def __init__(self, vectors: np.ndarray, trees: int = 128, bits: int = 20, seed: int = 11):
        self.vectors, self.trees = vectors, trees
        width = vectors.shape[1]
        self.bits = min(bits, 31)
        rng = np.random.default_rng(seed)
        self.directions = []
        for _ in range(trees):
            turns = [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(-(-self.bits // max(1, width)))]
            self.directions.append(np.hstack(turns)[:, : self.bits])
        self.centre = vectors.mean(axis=0) if len(vectors) else np.zeros(width)
        codes = self._codes(vectors)
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((self.trees, len(x)), np.int64)
        value = (1 << np.arange(self.bits, dtype=np.int64))[::-1]
        for t in range(self.trees):
            out[t] = ((x - self.centre) @ self.directions[t] > 0).astype(np.int64) @ value
        return out

    def candidates(self, queries: np.ndarray, least: int, reach: int = 40) -> list[np.ndarray]:
        """For each query, positions of the vectors that share most: `least`, and all that tie with the last of them.

        Descend each tree to the longest prefix that matches, then ascend all trees together, one level at a
        time, until the ranges at that level have `reach` entries for each vector wanted (at the root there are
        no more). Of the vectors in them, those that stand in the ranges of most trees are candidates.
        """
        n = len(self.vectors)
        codes = self._codes(queries)
        lo = np.empty((self.bits + 1, self.trees, len(queries)), np.int64)
        hi = np.empty_like(lo)
        for depth in range(self.bits + 1):
            free = self.bits - depth
            for t in range(self.trees):
                start = codes[t] >> free << free
                lo[depth, t] = np.searchsorted(self.sorted[t], start, "left")
                hi[depth, t] = np.searchsorted(self.sorted[t], start + (1 << free) - 1, "right")
        wanted = min(reach * least, n * self.trees)
        out = []
        for q in range(len(queries)):
            depth = self.bits
            while depth and (hi[depth, :, q] - lo[depth, :, q]).sum() < wanted:
                depth -= 1
            seen = np.concatenate([self.order[t, lo[depth, t, q] : hi[depth, t, q]] for t in range(self.trees)])
            votes = np.bincount(seen, minlength=n)
            cut = max(1, np.partition(votes, n - least)[n - least]) if least < n else 1
            out.append(np.flatnonzero(votes >= cut))
        return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = 128, bits: int = 20, breadth: float = 10.0, shard_rows: int = 16_384, query_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest vectors found for each query, by Euclidean distance: query_id, rank, vec_id, score.

    Every row is indexed: rows are dealt by a hash of their id to shards of about `shard_rows`, and queries
    to blocks of about `query_rows`. A task builds the forest of one shard and asks it one block of
    queries; the candidates, `breadth` times the root of the shard's rows, whatever its size, are ranked by exact
    distances in double precision, and each shard's k best meet in a ranking by query. So a task holds one shard and one block at a time, whatever the tables'
    sizes; blocks of a shard follow one another.

    Nearest first, ties to the smaller vec_id; a query's own rows (by id) are no candidates. Vectors that are
    null, empty, zero, or hold null or non-finite components take no part, nor do those whose length is not
    the commonest one; rows of a null id neither. Repeated rows are candidates one by one. Queries that repeat
    an id and a vector are asked once; of an id with several vectors the least (in order of its components) is asked.
    Tables without usable vectors give an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)

    def usable(df):
        df = need(df, id_col, vector_col).toDF("vec_id", "embedding").where("vec_id is not null and embedding is not null")
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(finite & F.exists("embedding", lambda x: x != 0))

    rows, asked = usable(vectors), usable(queries)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    kind = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], kind)
    width, n = sizes[0].d, sizes[0]["count"]
    asked = asked.where(F.size("embedding") == width).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked.count() // query_rows))
    rows = rows.where(F.size("embedding") == width).select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int").alias("shard"), F.lit(-1).alias("block"))
    asked = asked.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))

    def run(batches):
        shard, forest, ids, ask_ids, ask, block = None, None, [], [], [], None
        held: list[np.ndarray] = []

        def answer():
            found = {"query_id": [], "vec_id": [], "score": []}
            points = np.vstack(ask)
            for q, cand in enumerate(forest.candidates(points, math.ceil(breadth * math.sqrt(len(forest.vectors))))):
                cand = cand[names[cand] != ask_ids[q]]
                gap = forest.vectors[cand] - points[q]
                d = np.sqrt((gap * gap).sum(axis=1))
                best = np.lexsort((names[cand], d))[:k]
                found["query_id"] += [ask_ids[q]] * len(best)
                found["vec_id"] += names[cand[best]].tolist()
                found["score"] += d[best].tolist()
            return pa.RecordBatch.from_pydict(found, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

        for b in batches:
            for i, v, s, g in zip(b.column(0).to_pylist(), np.asarray(b.column(1).flatten()).reshape(-1, width), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if ask and (s, g) != (shard, block):
                    yield answer()
                    ask_ids, ask = [], []
                if s != shard:
                    shard, forest, ids, held = s, None, [], []
                if g < 0:
                    ids.append(i)
                    held.append(v)
                    continue
                if not ids:
                    continue
                if forest is None:
                    names, forest = np.array(ids), PrefixForest(np.vstack(held), trees, bits)
                block = g
                ask_ids.append(i)
                ask.append(v)
        if ask:
            yield answer()

    both = rows.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "block", "vec_id", "embedding")
    near = both.mapInArrow(run, "query_id long, vec_id long, score double")

    def nearest(found, *by):
        best = found.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
        return best.select("query_id", F.posexplode("best").alias("pos", "hit"))

    # in two steps, so that no row gathers what all shards found for a query: the root of that at most
    salt = F.pmod(F.xxhash64("vec_id", "score"), F.lit(math.isqrt(shards - 1) + 1))
    some = nearest(near.withColumn("salt", salt), "query_id", "salt").select("query_id", "hit.score", "hit.vec_id")
    out = nearest(some, "query_id")
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
