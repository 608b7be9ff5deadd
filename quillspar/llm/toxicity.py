"""Toxicity by a classifier chain."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, release, small_batches, stored

_WORD = re.compile(r"\w+")
#: Lengths of the prefixes that catch forms of a word that the sample has not.
PREFIXES = (3, 4, 5, 6)


def pairs_of(word: str) -> list[tuple[str, str]]:
    """What a word adds to a text: a feature, and the feature of texts that have a second word with the first one."""
    return [(word, ""), *((f"{word[:n]}-", f"{word[:n]}+") for n in PREFIXES if len(word) > n)]


def features(words: set[str]) -> set[str]:
    """A text's words, their prefixes, and the prefixes that several of its different words share."""
    found: set[str] = set()
    for w in words:
        for one, two in pairs_of(w):
            found.add(two if one in found and two else one)
    return found


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Chain:
    """Linear models in chain order; model k sees the features and the probabilities of models 0..k-1."""

    names: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray  # models x features
    links: np.ndarray  # models x models, lower triangle
    bias: np.ndarray

    def __post_init__(self):
        self._known: dict[str, list[tuple[int, int]]] = {}

    def row(self, text: str | None) -> np.ndarray:
        """Indices of the features that a text has."""
        known, most, at = self._known, 500_000, self.vocabulary.get
        found: set[int] = set()
        once: set[int] = set()
        for w in words_of(text):
            hit = known.get(w)
            if hit is None:
                hit = [x for one, two in pairs_of(w) if (x := (at(one, -1), at(two, -1))) != (-1, -1)]
                if len(known) < most:
                    known[w] = hit
            for one, two in hit:
                if one >= 0:
                    found.add(one)
                if two >= 0:
                    (found if two in once else once).add(two)
        return np.fromiter(found, np.int64, len(found))

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """texts x models: probabilities, each model fed with those before it."""
        base = np.array([self.weights[:, r].sum(axis=1) if len(r := self.row(t)) else np.zeros(len(self.names)) for t in texts]).reshape(len(texts), len(self.names)) + self.bias
        out = np.zeros_like(base)
        for k in range(len(self.names)):
            out[:, k] = _sigmoid(base[:, k] + out[:, :k] @ self.links[k, :k])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fit_linear(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, size: int, l2: float = 1.0, steps: int = 150) -> tuple[np.ndarray, np.ndarray, float]:
    """Regularised logistic regression by accelerated gradient descent on sparse binary rows and dense extras."""
    n = len(rows)
    flat = np.concatenate(rows) if n else np.zeros(0, np.int64)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    weight = np.where(y > 0, 0.5 * n / max(1, y.sum()), 0.5 * n / max(1, n - y.sum()))
    weight = np.clip(weight, 0.1, 10)
    w, e, b = np.zeros(size), np.zeros(extra.shape[1]), 0.0
    gw, ge, gb = np.zeros(size), np.zeros(extra.shape[1]), 0.0
    for _ in range(steps):  # adaptive steps: rare features move as fast as frequent ones
        p = _sigmoid(np.bincount(of, w[flat], n) + extra @ e + b)
        d = weight * (p - y)
        dw = np.bincount(flat, d[of], size) + l2 * w
        de, db = extra.T @ d + l2 * e, d.sum()
        gw, ge, gb = gw + dw**2, ge + de**2, gb + db**2
        w, e, b = w - 0.5 * dw / np.sqrt(gw + 1e-9), e - 0.5 * de / np.sqrt(ge + 1e-9), b - 0.5 * db / np.sqrt(gb + 1e-9)
    return w, e, float(b)


def fit_chain(rows: list[np.ndarray], labels: dict[str, np.ndarray], vocabulary: dict[str, int], folds: int = 3) -> Chain:
    """Fit the chain on texts given as the sorted indices of the features they have, one label array a model.

    Later models are trained on out-of-fold probabilities of the earlier ones: each fold's are predicted by
    models that have not seen it, so that in use the inputs look as they did in training.
    """
    names, n, size = list(labels), len(rows), max(1, len(vocabulary))
    fold = np.arange(n) % folds
    fed = np.zeros((n, 0))
    weights, links, bias = np.zeros((len(names), size)), np.zeros((len(names), len(names))), np.zeros(len(names))
    for k, name in enumerate(names):
        y = labels[name]
        weights[k], links[k, :k], bias[k] = _fit_linear(rows, fed, y, size)
        out = np.zeros(n)
        for f in range(folds if k < len(names) - 1 else 0):
            seen = np.flatnonzero(fold != f)
            w, e, b = _fit_linear([rows[i] for i in seen], fed[seen], y[seen], size)
            for i in np.flatnonzero(fold == f):
                out[i] = _sigmoid(w[rows[i]].sum() + fed[i] @ e + b)
        fed = np.column_stack([fed, out])
    return Chain(names, vocabulary, weights, links, bias)


def kinds_of(rows: list[np.ndarray], size: int, kinds: int) -> np.ndarray:
    """A kind for each toxic text, given as indices of its features: clusters in their latent space, the largest first.

    The texts' unit vectors are projected on the leading right singular vectors of their matrix. Centres start as the
    text nearest to the mean and then, each time, the one least like any centre so far; a few rounds of spherical
    k-means follow. Ties go to the earlier text or centre, so the kinds are the same for the same rows.
    """
    x = np.zeros((len(rows), size))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(max(1, len(r)))
    if len(rows) <= kinds:
        return np.arange(len(rows)) % max(1, kinds)
    basis = np.linalg.svd(x, full_matrices=False)[2][: 2 * kinds]
    x = x @ basis.T
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.where(norm > 0, norm, 1)
    centres = x[[int(np.argmax(x @ x.mean(axis=0)))]]
    while len(centres) < kinds:
        centres = np.vstack([centres, x[int(np.argmin((x @ centres.T).max(axis=1).round(9)))]])
    for _ in range(20):
        of = (x @ centres.T).round(9).argmax(axis=1)
        centres = np.vstack([x[of == k].sum(axis=0) if (of == k).any() else centres[k] for k in range(kinds)])
        norm = np.linalg.norm(centres, axis=1, keepdims=True)
        centres /= np.where(norm > 0, norm, 1)
    rank = np.empty(kinds, int)
    rank[np.argsort(-np.bincount(of, minlength=kinds), kind="stable")] = np.arange(kinds)
    return rank[of]


def best_size(rows: list[np.ndarray], y: np.ndarray, fold: np.ndarray, orders: list[np.ndarray], sizes: tuple[int, ...]) -> int:
    """The number of features with the least log loss out of fold; orders[f] ranks features without the rows of fold f."""
    losses = []
    for size in sizes:
        loss = 0.0
        for f, order in enumerate(orders):
            place = np.full(int(max((r.max() for r in rows if len(r)), default=-1)) + 1, -1)
            top = order[:size]
            place[top[top < len(place)]] = np.flatnonzero(top < len(place))
            own = [(p := place[r])[p >= 0] for r in rows]
            seen, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(seen):
                continue
            w, _, b = _fit_linear([own[i] for i in seen], np.zeros((len(seen), 0)), y[seen], max(1, size), steps=60)
            q = np.clip([_sigmoid(w[own[i]].sum() + b) for i in held], 1e-6, 1 - 1e-6)
            loss -= float(np.sum(y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q)))
        losses.append(loss)
    return sizes[int(np.argmin(losses))]


def train_chain(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, kinds: int = 4, sizes: tuple[int, ...] = (200, 400, 800), folds: int = 3) -> Chain:
    """Fit on a bounded sample of labelled rows: at most `sample_rows`, those least by a hash of doc_id.

    The labels name no categories of toxicity. The chain's first models are of `kinds` learned from the data, the
    clusters of the sample's toxic texts (`kinds_of`); a text is a positive of its own kind. The last is the label.

    Up to half of the sample are toxic rows; null labels, ids and texts are left out, and rows that repeat an id
    and a text count one by one, up to the bound. Executors turn the sample's whole texts into features and count
    them; the vocabulary has those in at least three texts whose share among toxic texts differs most from that
    among the others. How many, of `sizes`, is chosen out of fold, each fold ranking features without its own rows.
    What reaches the driver is at most `folds` + 1 times the largest size of features and, for each row of the
    sample, indices into them, however long the texts are. Without labelled rows the chain has no features, and
    all its models give the same score to all texts.
    """
    small_batches(docs.sparkSession)
    labelled = need(labels, "doc_id", "toxic").where("toxic is not null and doc_id is not null")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    both = labelled.where("toxic = 1").orderBy(*order).limit(sample_rows // 2).unionAll(labelled.where("toxic <> 1").orderBy(*order).limit(sample_rows // 2))
    texts = need(docs, "doc_id", "text").where("text is not null").join(F.broadcast(both), "doc_id")

    def featured(batches):
        for b in batches:
            has = [sorted(features(words_of(t))) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(has, pa.list_(pa.string()))], names=["doc_id", "toxic", "features"])

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic"), "text").mapInArrow(featured, "doc_id long, toxic int, features array<string>")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(folds)).cast("int").alias("fold")
    sample = stored(rows.orderBy(*order, "features").limit(sample_rows).select("doc_id", "toxic", fold, "features"), "toxicity-sample")

    total = {r.fold: r for r in sample.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()}
    per = sample.select("toxic", "fold", F.explode("features").alias("feature")).groupBy("feature")
    counts = stored(per.agg(*[F.count_if((F.col("fold") != f) & (F.col("toxic") == x)).alias(f"n{f}_{x}") for f in range(folds + 1) for x in (0, 1)]), "toxicity-counts")

    def ranked(f: int) -> list[str]:
        """Features by what they tell without the rows of fold f; no fold has the number `folds`."""
        n1 = max(1, sum(r.t for k, r in total.items() if k != f))
        n0 = max(1, sum(r.n - r.t for k, r in total.items() if k != f))
        t, o = F.col(f"n{f}_1"), F.col(f"n{f}_0")
        share, odds = t / n1 - o / n0, F.log((t + 0.5) / n1) - F.log((o + 0.5) / n0)
        return [r.feature for r in counts.where(t + o >= 3).orderBy(F.desc(F.abs(share) * F.abs(odds)), "feature").limit(max(sizes)).select("feature").collect()]

    lists = [ranked(f) for f in range(folds + 1)]
    every = {x: i for i, x in enumerate(dict.fromkeys(x for ls in lists[::-1] for x in ls))}  # those of all rows come first, in order

    def indexed(batches):
        for b in batches:
            at = [sorted(every[f] for f in fs if f in every) for fs in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(at, pa.list_(pa.int32()))], names=["doc_id", "toxic", "fold", "at"])

    found = sample.mapInArrow(indexed, "doc_id long, toxic int, fold int, at array<int>").orderBy(*order, "at").collect()
    release(sample, counts)
    at = [np.array(r.at, np.int64) for r in found]
    toxic = np.array([r.toxic for r in found], float)
    size = best_size(at, toxic, np.array([r.fold for r in found]), [np.array([every[x] for x in ls], np.int64) for ls in lists[:-1]], sizes)
    vocabulary = {x: i for i, x in enumerate(lists[-1][:size])}
    at = [r[r < len(vocabulary)] for r in at]
    kind = np.full(len(found), -1)
    kind[toxic == 1] = kinds_of([r for r, t in zip(at, toxic, strict=True) if t], max(1, len(vocabulary)), kinds)
    return fit_chain(at, {**{f"kind_{k + 1}": (kind == k).astype(float) for k in range(kinds)}, "toxic": toxic}, vocabulary, folds)


#: What `score_toxicity` adds to a table.
RESULTS = ("toxicity", "toxic_score", "is_toxic")


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.4) -> DataFrame:
    """All columns of docs, then `toxicity` (struct of the chain's probabilities), `toxic_score` and `is_toxic`.

    Whole texts are scored, in one pass without a shuffle. Null and empty texts have no features and get the
    chain's bias, but never count as toxic. Repeated rows and rows of a null id are scored one by one; an empty
    table gives an empty result. Where docs has a column of one of the three names (in any case), its own stays and
    the result's name gets underscores at its end until it is free.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(chain)  # at most the largest size of features: a fixed size
    kind = ", ".join(f"`{n}` double" for n in chain.names)

    @F.pandas_udf(f"struct<{kind.replace(' double', ': double')}>")
    def probabilities(texts):
        import pandas as pd

        return pd.DataFrame(shared.value.predict(texts.tolist()), columns=chain.names)

    probabilities = probabilities.asNondeterministic()  # else the filter on it would run it twice
    taken, names = {c.lower() for c in docs.columns}, []
    for name in RESULTS:
        while name in taken:
            name += "_"
        names.append(name)
    out = docs.withColumn(names[0], probabilities(F.coalesce(F.col("text"), F.lit(""))))
    out = out.withColumn(names[1], F.col(f"{names[0]}.`{chain.names[-1]}`"))
    return out.withColumn(names[2], (F.col(names[1]) >= threshold) & (F.length(F.coalesce("text", F.lit(""))) > 0))


__all__ = ["Chain", "fit_chain", "score_toxicity", "train_chain"]
