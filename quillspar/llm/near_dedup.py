"""Near-duplicates by MinHash with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, RollingHash, components, in_blocks, mix, need, partitions, small_batches, stored, texts_of

_STEP = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    r"""For each text its sorted distinct shingles of so many words, as 64-bit hashes.

    Words are `[^\x20\x09-\x0D]+` after A-Z became a-z. A text with fewer words has its whole sequence as the
    one shingle; a text without words has none.
    """
    data = LOWER[data]
    n = len(offsets) - 1
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    word = RollingHash(data).of(start, end)
    of = np.searchsorted(offsets, start, "right") - 1
    counts = np.bincount(of, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    h = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        h = mix(h * _STEP + word[k : k + len(h)])
    out = []
    for d in range(n):
        a, b = first[d], first[d + 1]
        if b - a >= words:
            out.append(np.unique(h[a : b - words + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for w in word[a:b]:
                one = mix(one * _STEP + w)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class TensorSketch:
    """Half-sketches of a set: two collections of `tables` groups of `rows` minhashes each.

    A table key pairs one group of the first collection with one of the second, so tables^2 keys of 2*rows
    minhashes come from 2*tables*rows minhashes instead of 2*rows*tables^2.
    """

    def __init__(self, tables: int, rows: int, seed: int = 7):
        self.tables, self.rows = tables, rows
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, 2 * tables * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, 2 * tables * rows, dtype=np.uint64)

    def minhashes(self, sets: list[np.ndarray]) -> np.ndarray:
        """sets x functions; every set must have members."""
        flat = np.concatenate(sets)
        at = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((len(sets), len(self.a)), np.uint64)
        for k, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            out[:, k] = np.minimum.reduceat(flat * a + b, at)
        return out

    def halves(self, sets: list[np.ndarray]) -> np.ndarray:
        """sets x (2 * tables) group hashes."""
        m = mix(self.minhashes(sets)).reshape(len(sets), 2 * self.tables, self.rows)
        h = np.zeros(m.shape[:2], np.uint64)
        for k in range(self.rows):
            h = mix(h * _STEP + m[:, :, k])
        return h


def set_codes(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums for each set; zeros for an empty one."""
    codes = np.zeros((len(sets), 2), np.int64)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        at = np.cumsum([0, *(len(sets[k]) for k in full[:-1])])
        flat = np.concatenate([sets[k] for k in full])
        codes[full, 0] = np.add.reduceat(mix(flat), at).view(np.int64)
        codes[full, 1] = np.add.reduceat(mix(flat ^ _STEP), at).view(np.int64)
    return codes


def linked(sets: list[np.ndarray], num: int, den: int, sides: np.ndarray | None = None) -> np.ndarray:
    """Component number of each set under the links den * |A & B| >= num * |A | B|, every link being found.

    Pairs are looked up through the rarest tokens of the sets (a pair that is similar enough shares one of the
    first n - ceil(num/den n) + 1) and confirmed by full intersections. A few sets are tried as centres
    first; sets in the largest component needn't search then, as each pair with one outside is searched
    from there. With `sides`, only links between side 0 and side 1 count.
    """
    n = len(sets)
    comp = np.arange(n)
    if n < 2:
        return comp
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    of = np.repeat(np.arange(n), sizes)
    order = np.lexsort((rank[inverse], of))
    tokens = rank[inverse][order]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    prefix = sizes - -(-num * sizes // den) + 1
    lead = np.arange(len(tokens)) - np.repeat(begin[:-1], sizes) < np.repeat(prefix, sizes)
    by = np.argsort(tokens[lead], kind="stable")
    posted, post_of = tokens[lead][by], of[lead][by]
    mark = np.zeros(len(counts), bool)

    def confirm(d: int, cand: np.ndarray) -> None:
        cand = cand[(comp[cand] != comp[d]) & (den * np.minimum(sizes[cand], sizes[d]) >= num * np.maximum(sizes[cand], sizes[d]))]
        if sides is not None:
            cand = cand[sides[cand] != sides[d]]
        for at in range(0, len(cand), 2000):
            part = cand[at : at + 2000]
            own = tokens[begin[d] : begin[d + 1]]
            mark[own] = True
            where = np.concatenate([np.arange(begin[c], begin[c + 1]) for c in part])
            shared = np.add.reduceat(mark[tokens[where]].astype(np.int64), np.cumsum([0, *sizes[part][:-1]]))
            mark[own] = False
            hit = part[den * shared >= num * (sizes[part] + sizes[d] - shared)]
            if len(hit):
                groups = np.unique(np.append(comp[hit], comp[d]))
                comp[np.isin(comp, groups)] = groups[0]

    every = np.arange(n)
    for d in every[:: max(1, n // 4)][:4]:
        confirm(d, every)
    largest = np.bincount(comp).argmax()
    for d in every[comp != largest]:
        lo = np.searchsorted(posted, tokens[begin[d] : begin[d] + prefix[d]], "left")
        hi = np.searchsorted(posted, tokens[begin[d] : begin[d] + prefix[d]], "right")
        found = [post_of[a:b] for a, b in zip(lo, hi, strict=True)]
        confirm(d, np.unique(np.concatenate(found)))
    return comp


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, tables: int = 14, rows: int = 5, task_shingles: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Documents are linked when den * |A & B| >= num * |A | B| on full shingle sets.

    1. Sketch every whole text; documents of identical sets become one representative, before anything else.
    2. Pair half-sketches to table keys, but only those halves that another representative has too, as no
       other can make a shared key; each representative is joined with the least one of each of its
       buckets. Components of these candidate links are clusters: two documents that share a bucket are in
       the same cluster. Only ids travel; no pairs within a bucket are made.
    3. Bring the texts of clustered representatives together by cluster and find every link there
       (`linked`). A cluster of more than `task_shingles` is cut into blocks, and each task takes two blocks,
       so no group needs to fit a task; copies of a text or set never count, as one stands for them.
    4. Components of confirmed links, and of sets that share an id, named by their smallest id; then back from
       representatives to documents.

    With `tables`=14 and `rows`=5, a pair of similarity 0.85 shares a bucket with probability 0.9995 and one of
    0.3 with 0.001; with 15 and 4, one of 0.8 with 0.9993. More similar pairs are surer still. A pair that shares
    none is found only through others of its cluster.

    Null and empty texts, and those of white space, have no shingles, are linked with nothing, and stay. Rows
    that repeat a doc_id are one node, each with a row in the result. Rows without an id are linked with nothing
    either, as nothing can name them: they have a null component and stay. An empty table gives an empty result.
    Sets are equal where they have as many shingles and two equal 64-bit sums of them; shingles are 64-bit hashes of
    their words. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = TensorSketch(tables, rows)

    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for first, last in in_blocks(offsets):
                sets = shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], words)
                sizes = np.array([len(s) for s in sets], np.int64)
                codes, half = set_codes(sets), [None] * len(sets)
                full = np.flatnonzero(sizes)
                if len(full):
                    for k, h in zip(full, sketch.halves([sets[k] for k in full]).view(np.int64), strict=True):
                        half[k] = h
                ids = batch.column(0).slice(first, last - first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(codes[:, 0]), pa.array(codes[:, 1]), pa.array(half, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "c1", "c2", "half"])

    kind = "doc_id long, n_shingles long, c1 long, c2 long, half array<long>"
    sketched = stored(source.mapInArrow(run, kind), "sketches")
    reps = sketched.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "c1", "c2").agg(F.min("doc_id").alias("least"), F.first("half").alias("half"))
    reps = stored(reps.withColumn("rep", F.xxhash64("n_shingles", "c1", "c2")), "reps")  # a set's own name, as an id may have several

    halves = reps.select("rep", F.posexplode("half").alias("place", "h"))
    shared = halves.groupBy("place", "h").agg(F.count("*").alias("n")).where("n > 1").select("place", "h")
    common = halves.join(shared, ["place", "h"]).groupBy("rep").agg(F.collect_list(F.struct("place", "h")).alias("own"))
    one, two = F.filter("own", lambda x: x["place"] < tables), F.filter("own", lambda x: x["place"] >= tables)
    keys = F.flatten(F.transform(one, lambda x: F.transform(two, lambda y: F.xxhash64(x["place"], y["place"], x["h"], y["h"]))))
    keyed = common.select("rep", F.explode(keys).alias("key"))
    least = keyed.groupBy("key").agg(F.min("rep").alias("to"), F.count("*").alias("n")).where("n > 1").select("key", "to")
    candidates = keyed.join(least, "key").where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b"))
    clusters = components(candidates).toDF("rep", "cluster")

    sized = clusters.join(reps.select("rep", "n_shingles", "c1", "least"), "rep")
    blocks = sized.groupBy("cluster").agg(F.sum("n_shingles").alias("total")).select("cluster", F.ceil(F.col("total") / task_shingles).cast("int").alias("blocks"))
    placed = sized.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    same = source.join(placed, source.doc_id == placed.least).withColumn("code", F.xxhash64("text"))
    texts = same.dropDuplicates(["rep", "code"]).select("rep", "c1", "text", "cluster", "blocks", "block")  # of an id, all its texts
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    dealt = texts.withColumn("task", F.explode(tasks)).select("cluster", F.col("task.i").alias("i"), F.col("task.j").alias("j"), "block", "rep", "text", "c1")

    def confirm(batches):
        held: list = []

        def links():
            ids, own = np.array([h[1] for h in held]), np.array([h[3] for h in held])
            apart = held[0][0][1] != held[0][0][2]  # links within a block are found in its own task
            comp = linked([h[2] for h in held], num, den, (own != own.min()).astype(int) if apart else None)
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, comp, ids)
            far = ids != least[comp]
            return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(least[comp][far])], names=["a", "b"])

        for batch in batches:
            data, offsets = texts_of(batch.column(5))
            names = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            owns, ids, wanted = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(6).to_pylist()
            for first, last in in_blocks(offsets):
                sets = shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], words)
                for k, s, (c1, _) in zip(range(first, last), sets, set_codes(sets).tolist(), strict=True):
                    if c1 != wanted[k]:  # another text of the id
                        continue
                    if held and held[0][0] != names[k]:
                        yield links()
                        held.clear()
                    if not held or held[-1][1] != ids[k]:  # texts that differ in white space or case have one set
                        held.append((names[k], ids[k], s, owns[k]))
        if held:
            yield links()

    together = dealt.repartition(partitions(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "rep")
    links = together.mapInArrow(confirm, "a long, b long")
    codes = sketched.where("n_shingles > 0 and doc_id is not null").select("doc_id", F.xxhash64("n_shingles", "c1", "c2").alias("a"))
    several = codes.groupBy("doc_id").agg(F.min("a").alias("b"), F.max("a").alias("other")).where("b <> other").select("doc_id", "b")
    links = links.unionByName(codes.join(several, "doc_id").where("a <> b").select("a", "b"))
    found = components(links).toDF("rep", "class")
    smallest = found.join(reps.select("rep", "least"), "rep").groupBy("class").agg(F.min("least").alias("component_id"))
    found = found.join(smallest, "class").select("rep", "component_id")
    named = reps.join(found, "rep", "left").select("n_shingles", "c1", "c2", F.coalesce("component_id", "least").alias("component_id"))
    out = sketched.join(named.hint("merge"), ["n_shingles", "c1", "c2"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
