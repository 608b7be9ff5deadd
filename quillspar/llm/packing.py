"""Conflict-constrained best-fit packing."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, partitions, small_batches, stored


class Bins:
    """Open bins in order of what they have left; each carries bitmaps of its sources and duplicate clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, bin), ascending
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.looks = 0

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Put an item into the tightest bin that has room and no conflict, else into a new one: (bin, offset)."""
        at = bisect_left(self.order, (size, -1))
        order, sources, clusters = self.order, self.sources, self.clusters
        while at < len(order):
            self.looks += 1
            residual, b = order[at]
            if not (sources[b] & source or clusters[b] & cluster):
                del order[at]
                break
            at += 1  # the successor is the next tightest
        else:
            b, residual = len(sources), self.capacity
            sources.append(0)
            clusters.append(0)
        sources[b] |= source
        clusters[b] |= cluster
        if residual > size:
            insort(order, (residual - size, b))
        return b, self.capacity - residual


_ROWS = "shard int, bin long, doc_id long, piece int, piece_start long, length long, bin_offset long"


def pack(docs: DataFrame, capacity: int = 2048, shard_items: int = 4000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    r"""Pack documents into bins of `capacity` words so that no bin holds a source or a duplicate cluster twice.

    One row per piece: shard, bin (with the shard, its key), doc_id, piece, piece_start (its first word),
    length, bin_offset. A document's length is its number of words `[^\x20\x09-\x0D]+`. One longer than
    `capacity` fills bins of its own with full pieces, and its rest is packed like the others. Documents are
    placed in order of decreasing length (ties: smaller doc_id), each into the tightest compatible bin.

    Items are dealt to shards of about `shard_items` by a hash of doc_id, so a hot source spreads evenly, and
    each shard packs its own bins; only ids, lengths, sources and cluster codes are shuffled. Duplicate
    clusters are texts of the same words (by a 64-bit hash; a collision only keeps two texts apart).

    Documents without words (null, empty, white space) take no room: one row with a null bin, shard -1. A
    null source conflicts with nothing. Null ids are packed like others. Repeated rows are items of their
    own, and never share a bin. Lengths and codes are written once before packing. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = need(docs, id_col, text_col, source_col).toDF("doc_id", "text", "source")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    items = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words.alias("w"))
    items = items.select("doc_id", "source", F.size("w").cast("long").alias("n"), F.xxhash64("w").alias("cluster"))
    return pack_items(stored(items, "items"), capacity, shard_items)  # texts are split once


def pack_items(items: DataFrame, capacity: int, shard_items: int) -> DataFrame:
    """Pack (doc_id, source, n, cluster) items; see `pack`."""
    spark = items.sparkSession
    shards = max(1, -(-items.count() // shard_items))
    dealt = items.withColumn("shard", F.when(F.col("n") > 0, F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)).cast("int")).otherwise(F.lit(-1)))
    rest = F.col("n") % capacity
    ordered = dealt.where("n > 0").repartition(max(shards, partitions(spark)), "shard").sortWithinPartitions("shard", rest.desc(), "doc_id", "cluster", "source")

    def run(batches):
        shard, bins, sources, clusters = None, None, {}, {}
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, source, n, cluster, s in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if s != shard:
                    shard, bins, sources, clusters = s, Bins(capacity), {}, {}
                src = 0 if source is None else 1 << sources.setdefault(source, len(sources))
                dup = 1 << clusters.setdefault(cluster, len(clusters))
                full, left = divmod(n, capacity)
                placed = [(*bins.place(capacity, src, dup), k, k * capacity, capacity) for k in range(full)]
                if left:
                    placed.append((*bins.place(left, src, dup), full, full * capacity, left))
                for where, offset, piece, start, length in placed:
                    for c, v in zip(out, (s, where, doc, piece, start, length, offset), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["shard", "bin", "doc_id", "piece", "piece_start", "length", "bin_offset"])

    packed = ordered.select("doc_id", "source", "n", "cluster", "shard").mapInArrow(run, _ROWS)
    empty = dealt.where("n = 0").select("shard", F.lit(None).cast("long").alias("bin"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("piece_start"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("long").alias("bin_offset"))
    return packed.unionByName(empty)
