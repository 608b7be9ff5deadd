"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, forest, licences, near_dedup, packing, quality, sentencepieces, suffix_dedup, token_store, toxicity


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; QUILLSPAR_TOKENIZERS names the folder where no package does."""
    try:
        return importlib.import_module("public_tokenizers").path(name)
    except ImportError:
        return os.path.join(os.environ.get("QUILLSPAR_TOKENIZERS", "/opt/tokenizers"), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train_chain(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, chain)
    return scored.select("doc_id", *[F.col(f"toxicity.`{n}`").alias(f"p_{n}") for n in chain.names], "toxic_score", "is_toxic")


def op2_grace_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op4_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labelled = table(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("quality").alias("label"))
    model = quality.train_neighbours(docs, labelled)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), span=400).drop("kept_text")


def op6_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op7_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return forest.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op8_conflict_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_sentencepiece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepieces.digests(sentencepieces.encode_documents(docs, vocabulary("piece_bpe_32k.model")))


def op10_zstd_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = token_store.write_tokens(docs, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_store.digests(token_store.read_tokens(spark, store))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity_chain, op2_grace_hash_dedup, op3_licence_dice, op4_quality_neighbours, op5_prefix_free_parsing, op6_tensored_minhash, op7_hash_prefix_forest, op8_conflict_best_fit, op9_sentencepiece_chunks, op10_zstd_token_store, pipeline)}

_CLEAN = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
_PAIRS = "list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: concat(w[i], ' ', w[i + 1])))"
_TEMPLATES = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in licences.TEMPLATES)

SQL = {
    "op2_grace_hash_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_CLEAN}) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    # tb: templates' bigrams; b: texts' bigrams with their last place before; h: those of a template; ws: windows from
    # one to another; bw: the best from each start; gr: the best window left, and then those that share no word with it
    "op3_licence_dice": f"""
        WITH RECURSIVE t0 AS (SELECT name, {_WORDS.format("body")} AS w FROM (VALUES {_TEMPLATES}) v(name, body)),
        t AS (SELECT row_number() OVER () AS tid, name, {_PAIRS} AS g FROM t0),
        tb AS (SELECT tid, len(g) AS m, UNNEST(g) AS g FROM t),
        d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        l0 AS (SELECT rid, string_split(text, chr(10)) AS lines FROM d),
        l1 AS (SELECT rid, UNNEST(lines) AS line, UNNEST(range(1, len(lines) + 1)) AS line_no FROM l0),
        l AS (SELECT rid, line_no, sum(len({_WORDS.format("line")})) OVER (PARTITION BY rid ORDER BY line_no) AS words FROM l1),
        w0 AS (SELECT rid, {_WORDS.format("text")} AS w FROM d),
        b0 AS (SELECT rid, UNNEST(list_transform(range(1, greatest(len(w), 1)), lambda i: concat(w[i], ' ', w[i + 1]))) AS g, UNNEST(range(0, len(w) - 1)) AS p FROM w0),
        b AS (SELECT *, lag(p) OVER (PARTITION BY rid, g ORDER BY p) AS before, lead(p) OVER (PARTITION BY rid, g ORDER BY p) AS after FROM b0),
        k AS (SELECT rid, tid FROM (SELECT DISTINCT rid, g FROM b0) u JOIN tb USING (g) GROUP BY rid, tid, m HAVING count(*) * 120 >= m * 80),
        h AS (SELECT b.rid, tb.tid, tb.m, p, before, after FROM k JOIN tb ON k.tid = tb.tid JOIN b ON b.rid = k.rid AND b.g = tb.g),
        ws AS (SELECT x.rid, x.tid, x.m, x.p AS i, y.p AS j FROM h x JOIN h y ON x.rid = y.rid AND x.tid = y.tid AND y.p >= x.p AND (x.after IS NULL OR y.p < x.after) AND (y.before IS NULL OR y.before < x.p)),
        s AS (SELECT rid, tid, i, j, count(*) AS s FROM ws JOIN h USING (rid, tid) WHERE p BETWEEN i AND j AND (before IS NULL OR before < i) GROUP BY rid, tid, i, j),
        n AS (SELECT rid, i, j, count(*) AS n FROM (SELECT DISTINCT rid, i, j FROM ws) u JOIN b USING (rid) WHERE p BETWEEN i AND j AND (before IS NULL OR before < i) GROUP BY rid, i, j),
        di AS (SELECT rid, tid, i, j, CAST(2 * s AS DOUBLE) / (m + n) AS dice FROM ws JOIN s USING (rid, tid, i, j) JOIN n USING (rid, i, j) WHERE 2 * s * 100 >= 80 * (m + n)),
        bw AS (SELECT rid, name, i, j, dice FROM di JOIN t USING (tid) QUALIFY row_number() OVER (PARTITION BY rid, tid, i ORDER BY dice DESC, j) = 1),
        gr AS (
            SELECT rid, list(struct_pack(dice := dice, i := i, j := j, name := name) ORDER BY dice DESC, i, j DESC, name) AS ws, 0 AS n FROM bw GROUP BY rid
            UNION ALL SELECT rid, list_filter(ws[2:], lambda x: x.i > ws[1].j + 1 OR x.j + 1 < ws[1].i), n + 1 FROM gr WHERE len(ws) > 0),
        c AS (SELECT rid, max(n) AS n, max(CASE WHEN n = 0 THEN ws[1] END) AS best FROM gr GROUP BY rid)
        SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_matches, c.best.name AS licence, c.best.dice AS dice, CAST((SELECT min(line_no) FROM l WHERE l.rid = d.rid AND l.words > c.best.i) AS BIGINT) AS line_no
        FROM d JOIN l0 USING (rid) LEFT JOIN c USING (rid)""",
}
