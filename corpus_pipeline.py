"""A corpus pipeline: toxicity, exact dedup, near dedup, repeated passages, packing.

Stages take (spark, docs, sf_dir); `run` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.llm.common import stored
from quillspar.llm.exact_dedup import exact_dedup
from quillspar.llm.near_dedup import near_duplicates
from quillspar.llm.packing import pack
from quillspar.llm.suffix_dedup import suffix_dedup
from quillspar.llm.toxicity import score_toxicity, train_chain

#: Passages of so many words that occur elsewhere too are cut, however short in bytes: all that have over fifty.
PASSAGE_WORDS = 51
#: Tables of the near-duplicate sketch and minhashes in a half key: a lone pair at 0.8 is found with probability 0.9993.
NEAR_TABLES, NEAR_ROWS = 15, 4
#: Words in a bin.
BIN_WORDS = 2048


def _apart(docs: DataFrame, *read: str) -> DataFrame:
    """docs with names of their own for all columns but those a stage reads: no name can clash."""
    return docs.toDF(*[c if c in read else f"held_{k}" for k, c in enumerate(docs.columns)])


def _staying(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose id has a kept row in found, and those without an id, which nothing can name as copies."""
    named = docs.where("doc_id is not null").join(found.where("kept").select("doc_id"), "doc_id", "left_semi")
    return named.select(*[F.col(f"`{c}`") for c in docs.columns]).union(docs.where("doc_id is null"))


def _once(docs: DataFrame) -> DataFrame:
    """One row of each id and text, equal as in exact dedup; rows of a null id all stay. Only rows of repeated ids move, if there are any."""
    held = _apart(docs, "doc_id", "text")
    often = stored(held.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    if often.where("doc_id is not null").isEmpty():
        return docs
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    again = held.join(often.where("doc_id is not null"), "doc_id", "left_semi").withColumn("text_sha256", F.sha2(clean.cast("binary"), 256))
    others = held.join(often.where("doc_id is not null"), "doc_id", "left_anti").select(*held.columns)
    one = again.dropDuplicates(["doc_id", "text_sha256"]).select(*held.columns)
    return stored(one.union(others).toDF(*docs.columns), "once")  # which row stays is settled here


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go.

    Null and empty texts stay, as do null ids; of repeated rows all go or stay. Without rows or labels, nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(_apart(docs, "text"), train_chain(docs, labels))
    return scored.where(~F.col("is_toxic")).drop("toxicity", "toxic_score", "is_toxic").toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id stays.

    Null and empty texts are equal. Rows that share an id stay together; rows of a null id stay.
    """
    return _staying(docs, exact_dedup(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8), the one with the smallest id stays.

    Texts without words are linked with nothing. Rows that share an id stay together; rows of a null id stay.
    """
    return _staying(docs, near_duplicates(docs, words=5, num=80, den=100, tables=NEAR_TABLES, rows=NEAR_ROWS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 51 words or more that occur elsewhere too are cut from every text; n_chars follows the text.

    They are judged by words alone: shorter strings that documents share stay, whatever their bytes.

    Of rows that repeat an id and a text, one stays, whole but for what other texts hold; all others stay. Null
    texts and rows of a null id stay as they are.
    """
    docs = _once(docs)
    held = _apart(docs, "doc_id", "text").withColumn("no_text", F.col("text").isNull())
    others = [c for c in held.columns if c not in ("doc_id", "text")]
    cut = suffix_dedup(held.where("doc_id is not null"), characters=True, carry=tuple(others), words=PASSAGE_WORDS)
    changed = F.col("n_removed") > 0
    values = {"doc_id": F.col("doc_id"), "text": F.when(~F.col("no_text"), F.col("kept_text"))}
    values |= {c: F.col(h) for c, h in zip(docs.columns, held.columns) if c not in values}
    if "n_chars" in values:
        values["n_chars"] = F.when(changed, F.length("kept_text").cast("long")).otherwise(values["n_chars"])
    return cut.select(*[values[c].alias(c) for c in docs.columns]).union(docs.where("doc_id is null"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in bins; texts without words have a row with a null bin (see `pack`)."""
    return pack(docs, BIN_WORDS)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("suffix-array dedup", passages), ("best-fit packing", packed)]

#: SQL can't express the classifier chain, MinHash candidates or best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
