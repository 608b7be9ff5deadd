"""Tokens, term weights and label features of texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.elementwise import normalise
from ..matrix import SparseMatrix
from ..sources.scratch import Scratch


def stopwords() -> list[str]:
    """Spark's English list; pass another to `tokens` for other results."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def split_on(text: Column, separator: str) -> Column:
    """Pieces between a character; one at the end leaves an empty last piece."""
    return F.split(text, r"\Q" + separator + r"\E", -1)


def tokens(text: Column, stops: list[str] | tuple[str, ...] = ()) -> Column:
    """Lower-case runs of Unicode letters and digits, without stop words."""
    out = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.filter(out, lambda t: ~t.isin(list(stops))) if stops else out


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda p: p.isNotNull())


def plain_words(text: Column) -> Column:
    """Runs of two word characters or more, case kept."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\b\w\w+\b"), 0)


def stemmed(words: DataFrame, column: str = "token") -> DataFrame:
    """Tokens replaced by their stems: distinct tokens go through the stemmer, and the table is joined back."""
    @F.pandas_udf("string")
    def stems(s: pd.Series) -> pd.Series:
        from .stem import stem

        return s.map(stem)

    table = words.select(column).distinct().withColumn("_stem", stems(column))
    return words.join(table, column).drop(column).withColumnRenamed("_stem", column)


def stemmed_words(docs: DataFrame, words: Column) -> DataFrame:
    """(id, words): each document's tokens as stems, in order, so that n-grams can be made of them; empty arrays stay."""
    places = docs.select("id", F.posexplode(words).alias("place", "token"))
    lists = stemmed(places).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("ws"))
    return docs.select("id").join(lists, "id", "left").select("id", F.coalesce(F.col("ws.token"), F.array().cast("array<string>")).alias("words"))


def _counted(words: Column) -> Column:
    """A row's distinct words with their numbers, as an array of (term, tf): runs of the sorted words."""
    def runs(ws: Column) -> Column:
        last = F.size(ws) - 1
        starts = F.filter(F.when(last < 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), last)), lambda k: (k == 0) | (F.get(ws, k) != F.get(ws, k - 1)))
        return F.transform(F.array(starts), lambda at: F.transform(at, lambda k, n: F.struct(F.get(ws, k).alias("term"), (F.coalesce(F.get(at, n + 1), F.size(ws)) - k).cast("long").alias("tf"))))[0]

    return F.transform(F.array(F.sort_array(words)), runs)[0]  # the arrays bind what is made once a row


def term_counts(docs: DataFrame, words: Column) -> DataFrame:
    """(id, term, tf).

    A row's words are counted where the row is. Only ids that several rows have, which a look at the ids tells, go
    through a shuffle of terms.
    """
    counts = lambda df: df.select("id", F.explode(_counted(words)).alias("e")).select("id", "e.term", "e.tf")
    several = docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_id"))
    if several.isEmpty():
        return counts(docs)
    same = F.col("id").eqNullSafe(F.col("_id"))
    merged = counts(docs.join(several, same, "left_semi")).groupBy("id", "term").agg(F.sum("tf").alias("tf"))
    return counts(docs.join(several, same, "left_anti")).unionByName(merged)


def fit_vocabulary(counts: DataFrame, n_docs: int, max_features: int | None = None, max_df: float = 0.5) -> DataFrame:
    """(term, j, df, idf): terms in at most a share of documents, the most frequent ones by corpus count, ids in term order.

    Written, so that terms are counted once and Spark knows the size of what `transform` joins.
    """
    scratch = Scratch(counts.sparkSession)
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).where(F.col("df") <= max_df * n_docs)
    if max_features is not None:
        stats = stats.orderBy(F.col("n").desc(), "term").limit(max_features)
    from ..operators.select import positions

    stats = scratch.stored(stats, "terms")
    ids = positions(stats.select("term"), "term").withColumnRenamed("pos", "j")
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    return scratch.stored(stats.join(ids, "term").select("term", "j", "df", idf.alias("idf")), "vocabulary")


def transform(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(i, j, v): tf * idf of known terms, not normalised."""
    return counts.join(vocabulary, "term").select(F.col("id").alias("i"), "j", (F.col("tf") * F.col("idf")).alias("v"))


def features(blocks: list[SparseMatrix]) -> SparseMatrix:
    """Blocks of features side by side, each row then of unit length."""
    from ..operators.setops import stack_features

    out = blocks[0]
    for b in blocks[1:]:
        out = stack_features(out, b)
    return normalise(out)


def private_features(seen: DataFrame, value: float | Column) -> DataFrame:
    """(i, j, v): one feature of its own for each seen label (i), in order."""
    from ..operators.select import positions

    v = F.lit(value) if isinstance(value, (int, float)) else value
    return positions(seen.select("i").distinct(), "i").select("i", F.col("pos").alias("j"), v.cast("double").alias("v"))


def label_feature_name(i: Column, text: Column) -> Column:
    return F.concat(F.lit("__label__"), i.cast("string"), F.lit("__"), F.substring(text, 1, 50))


def parent_feature_name(name: Column) -> Column:
    return F.concat(F.lit("__parent__"), name)


def top_features(m: SparseMatrix, names: DataFrame, k: int) -> DataFrame:
    """(i, top): a row's k heaviest features as `name: weight` texts, heaviest first."""
    named = m.df.join(names.select(F.col("id").alias("j"), "name"), "j")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.col("v").desc(), "j"))
    best = named.withColumn("_k", rank).where(F.col("_k") <= k)
    text = F.format_string("%s: %.2f", "name", "v")
    return best.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("_k", text.alias("t")))).alias("e")).select("i", F.array_join(F.col("e.t"), ", ").alias("top"))
