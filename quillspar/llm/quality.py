"""Quality by nearest labelled neighbours in a latent-semantic space."""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, small_batches

#: Term slots: shapes and marks come first, hashed words after them.
SHAPES, TERMS = 512, 2048
_EDGE = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


def _slot(text: str, first: int, size: int) -> int:
    return first + zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


class Terms:
    """Terms of a chunk between white space: the form of its word, the marks around it, and the word itself."""

    def __init__(self, most: int = 500_000):
        self.known: dict[str, tuple[int, ...]] = {}
        self.most = most

    def of(self, chunk: str) -> tuple[int, ...]:
        hit = self.known.get(chunk)
        if hit is None:
            if chunk.isalpha():
                before, word, after = "", chunk, ""
            else:
                before, word, after = _EDGE.match(chunk).groups()
            form = "none" if not word else "upper" if word.isupper() and len(word) > 1 else "lower" if word.islower() else "title" if word.istitle() else "digit" if word.isdigit() else "mixed"
            out = [_slot(f"form {form} {min(len(word), 12) // 4}", 0, SHAPES)]
            out += [_slot(f"mark {m[:3]}", 0, SHAPES) for m in (before, after) if m]
            if word:
                out.append(_slot(word.lower(), SHAPES, TERMS - SHAPES))
            hit = tuple(out)
            if len(self.known) < self.most:
                self.known[chunk] = hit
        return hit

    def count(self, text: str | None) -> Counter:
        """Term counts of a whole text; a chunk like the one before it also counts as a repetition."""
        chunks = (text or "").split()
        known, out = self.known.get, Counter()
        for c, n in Counter(chunks).items():
            for t in known(c) or self.of(c):
                out[t] += n
        again = sum(map(eq, chunks, chunks[1:]))
        if again:
            out[_slot("again", 0, SHAPES)] += again
        return out


@functools.lru_cache(1)
def _terms() -> Terms:
    """One for each Python worker, which many tasks use in turn."""
    return Terms()


def vector(counts: Counter, weight: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Slots and unit-length weights: square roots of term shares, forms and marks weighing more than words."""
    at = np.fromiter(counts.keys(), np.int64, len(counts))
    v = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    v[at < SHAPES] *= weight
    norm = np.sqrt((v * v).sum())
    return at, v / norm if norm else v


@dataclass
class Neighbours:
    """The latent space and the labelled vectors in it."""

    basis: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled x rank, unit length
    labels: np.ndarray
    k: int
    prior: float

    def project(self, counts: list[Counter]) -> np.ndarray:
        out = np.zeros((len(counts), self.basis.shape[1]))
        for i, c in enumerate(counts):
            if c:
                at, v = vector(c)
                out[i] = v @ self.basis[at]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def score(self, counts: list[Counter], block: int = 256) -> np.ndarray:
        """Share of the neighbours' similarity that votes for label 1; exact cosine products, block by block.

        The `k` nearest vote, and all that are as near as the last of them (to 1e-9). A vote weighs the fourth power
        of its cosine; negative ones weigh nothing, and a text whose neighbours all weigh nothing gets the prior.
        """
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        k = min(self.k, len(self.labels))
        points = self.project(counts)
        for at in range(0, len(counts), block):
            sims = points[at : at + block] @ self.vectors.T
            last = np.partition(sims, -k, axis=1)[:, [-k]]
            s = np.where(sims >= last - 1e-9, np.clip(sims, 0, None) ** 2, 0) ** 2
            total = s.sum(axis=1)
            out[at : at + block] = np.where(total > 0, s @ self.labels / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def fit_neighbours(counts: list[Counter], labels: np.ndarray, rank: int = 48, k: int = 15) -> Neighbours:
    """Latent space by singular value decomposition of the labelled rows' term matrix."""
    x = np.zeros((len(counts), TERMS))
    for i, c in enumerate(counts):
        if c:
            at, v = vector(c)
            x[i, at] = v
    values, vectors = np.linalg.eigh(x.T @ x)
    basis = vectors[:, ::-1][:, :rank]
    out = Neighbours(basis, np.zeros((0, rank)), labels.astype(float), k, float(labels.mean()) if len(labels) else 0.5)
    out.vectors = out.project(counts)
    return out


_COUNTS = "label int, slots array<int>, counts array<int>, doc_id long"


def train_neighbours(docs: DataFrame, labelled: DataFrame, sample_rows: int = 3000, rank: int = 48, k: int = 15) -> Neighbours:
    """Fit on a bounded sample of labelled rows (doc_id, label): at most `sample_rows`, least by a hash of doc_id.

    Executors turn the sample's texts into term counts; only those reach the driver. Null labels, ids and texts are
    left out; rows that repeat an id count one by one, up to the bound. Without labelled rows the model has no
    neighbours, and all texts get the score 0.5. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = labelled.where("label is not null and doc_id is not null").orderBy(*order).limit(sample_rows)
    rows = need(docs, "doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select(F.col("label").cast("int").alias("label"), "text", F.col("doc_id").cast("long").alias("doc_id"))

    def run(batches):
        terms = _terms()
        for b in batches:
            found = [terms.count(t) for t in b.column(1).to_pylist()]
            found = [dict(sorted(c.items())) for c in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32())), b.column(2)], names=["label", "slots", "counts", "doc_id"])

    counted = rows.mapInArrow(run, _COUNTS).orderBy(*order, "label", "slots", "counts").limit(sample_rows)
    sample = sorted((r.label, r.slots, r.counts) for r in counted.collect())
    return fit_neighbours([Counter(dict(zip(s, c, strict=True))) for _, s, c in sample], np.array([x[0] for x in sample], int), rank, k)


def score_quality(docs: DataFrame, model: Neighbours) -> DataFrame:
    """(doc_id, score) of every whole text, in one pass without a shuffle.

    The broadcast holds the latent basis and the labelled vectors, both of a size that the sample's bound
    fixes. A text without terms (null, empty, white space only) has no neighbours and gets the label mean. Equal
    texts get equal scores. Repeated rows and rows of a null id are scored one by one; an empty table gives an
    empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        terms, m = _terms(), shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score([terms.count(t) for t in part.column(1).to_pylist()]))], names=["doc_id", "score"])

    return need(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
