"""The pipeline's stages, each against brute force on what the stage before it kept."""

import re
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import pytest
from test_operators import SF, brute_exact, brute_near

from quillspar.llm.common import stored
from quillspar.llm.near_dedup import TensorSketch
from quillspar.llm.suffix_dedup import suffix_dedup


def brute_passages(rows, n):
    """What is left when every string of n words that also occurs elsewhere goes, from its first word to its last."""
    raw = {i: (t or "").encode() for i, t in rows}
    words = {i: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for i, t in raw.items()}
    windows = {i: [tuple(raw[i][a:b] for a, b in w[k : k + n]) for k in range(len(w) - n + 1)] for i, w in words.items()}
    seen = Counter(x for w in windows.values() for x in w)
    out = {}
    for i, t in raw.items():
        mask = np.zeros(len(t), bool)
        for k, x in enumerate(windows[i]):
            mask[words[i][k][0] : words[i][k + n - 1][1]] |= seen[x] > 1
        out[i] = bytes(np.frombuffer(t, np.uint8)[~mask]).decode()
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    stages = dict(pipeline.STAGES)
    kept = stored(stages["toxicity"](spark, docs, SF), "t")
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert len(toxic & gone) >= 0.8 * len(toxic)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    exact = stored(stages["exact dedup"](spark, kept, SF), "e")
    assert {r.doc_id for r in exact.collect()} == {i for i, v in brute_exact(rows).items() if v[2]}
    rows = [(r.doc_id, r.text) for r in exact.collect()]
    near = stored(stages["near dedup"](spark, exact, SF), "n")
    assert {r.doc_id for r in near.collect()} == {i for i, v in brute_near(rows, 5, 80, 100).items() if v[2]}
    rows = [(r.doc_id, r.text) for r in near.collect()]
    cut = stored(stages["suffix-array dedup"](spark, near, SF), "c")
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text for r in cut.collect()} == brute_passages(rows, pipeline.PASSAGE_WORDS)
    words = {r.doc_id: len(r.text.split()) for r in cut.collect()}
    placed = Counter()
    for r in stages["best-fit packing"](spark, cut, SF).collect():
        placed[r.doc_id] += r.length
    assert placed == words


CLASHES = ("toxicity", "toxic_score", "IS_TOXIC", "kept", "cut_text", "no_text", "n_removed", "held_0", "component_id", "a.b")


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_edge_cases(spark, empty):
    """Nulls anywhere, empty and repeated texts, repeated rows, clashing names, and a table without rows."""
    passage = "".join(chr(97 + k * k % 23) + " " * (k % 5 == 4) for k in range(400))
    texts = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "one two"), (5, "one  two"), (None, "one two"), (None, None), (6, "left " + passage), (7, "right one " + passage), (8, "w" * 5000), (9, None)]
    rows = [(i, t, None, "s" if i else None, len(t) if t else None, *("keep",) * len(CLASHES)) for i, t in texts]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = stored(spark.createDataFrame(rows[: 0 if empty else None], kind), "edge")
    want = {"toxicity": texts, "exact dedup": [x for x in texts if x[0] not in (2, 5, 9)]}
    want["near dedup"] = [x for x in want["exact dedup"] if x[0] != 7]
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        found = got.collect()
        assert all(r[5:] == ("keep",) * len(CLASHES) for r in found)
        if name in want and not empty:
            assert Counter((r.doc_id, r.text) for r in found) == Counter(want[name])
        docs = stored(got, "next")  # each stage works on what its predecessor kept
        if name == "exact dedup":
            both = docs
    assert empty or not {6, 7} - {r.doc_id for r in both.collect()}
    cut = {(r.doc_id, r.text): r.n_chars for r in stored(pipeline.passages(spark, both, SF), "cut").collect()}
    if not empty:
        assert len(cut) == len(set(want["exact dedup"])) and (1, None) in cut and (None, "one two") in cut
        assert all(n == len(t) for (i, t), n in cut.items() if i in (6, 7) and t is not None) and all(len(t) < 20 for i, t in cut if i in (6, 7))
    assert (pipeline.packed(spark, both, SF).count() == 0) == empty


def test_passages_of_short_words(spark):
    """A passage of 51 words goes at any length in bytes and in any white space; one of 50 words stays."""
    words = [a + b for a in "abcdefgh" for b in "klmnopqr"]
    long, short = words[:51], words[13:63][::-1]
    texts = {1: f"one {' '.join(long)} first", 2: "two " + "\n".join(long) + " second", 3: f"three {' '.join(short)} third", 4: f"four {' '.join(short)} fourth", 5: None, 6: "e " * 51 + "f"}
    assert len(" ".join(long)) < 300
    docs = spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.passages(spark, docs, SF).collect()}
    want = texts | {1: "one  first", 2: "two  second"}
    assert got == {i: (t, len(t or "")) for i, t in want.items()}


@pytest.mark.parametrize("seed", range(3))
def test_passages_by_words(spark, seed):
    """The words that are left are those outside every window of so many words that occurs twice."""
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 3000, 90) for _ in range(6)]
    pieces = lambda: [w for k in rng.integers(0, 6, 3) for w in [*base[k][int(rng.integers(0, 40)) :][: int(rng.integers(20, 90))], rng.integers(9999)]]
    texts = {i: " ".join(f"{w:x}" for w in pieces()) for i in range(25)}
    seen = Counter(tuple(w[k : k + 51]) for t in texts.values() for w in [t.split()] for k in range(len(w) - 50))
    want = {}
    for i, t in texts.items():
        w = t.split()
        gone = {j for k in range(len(w) - 50) if seen[tuple(w[k : k + 51])] > 1 for j in range(k, k + 51)}
        want[i] = [x for j, x in enumerate(w) if j not in gone]
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = suffix_dedup(docs, 100_000, characters=True, words=51).collect()
    assert {r.doc_id: r.kept_text.split() for r in got} == want and any(want[i] != t.split() for i, t in texts.items())


def test_passages_of_a_whole_table(spark):
    """What goes is what repeated strings of 51 words cover, and nothing else; a repeated string of many bytes and fewer words stays."""
    docs = stored(spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["text"]), "distinct")
    long = " ".join(f"{k:020d}" for k in range(50))
    more = spark.createDataFrame([(90_001, f"a {long} b", "en", "s", 1), (90_002, f"c {long} d", "en", "s", 1)], docs.schema)
    docs = docs.union(more)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_passages(rows, pipeline.PASSAGE_WORDS)
    got = {r.doc_id: r.text or "" for r in pipeline.passages(spark, docs, SF).collect()}
    assert got == want and any(want[i] != (t or "") for i, t in rows) and want[90_001] == f"a {long} b"


def test_repeated_rows_leave_one_text(spark):
    """Of a batch loaded twice, one whole text of each document is left after the passages stage, as of a single load."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"{w:x}" for w in rng.integers(0, 1 << 30, 120)) for _ in range(6)]
    rows = [*enumerate(texts), *enumerate(texts[:4]), (0, texts[0].replace(" ", "\n")), (5, texts[4][:500]), (None, "x"), (None, "x")]
    docs = spark.createDataFrame([(i, t, "s", len(t), "keep") for i, t in rows], "doc_id long, text string, source string, n_chars long, text_sha256 string")
    for stage in (pipeline.exact, pipeline.near, pipeline.passages):
        docs = stored(stage(spark, docs, SF), "twice")
    got = docs.collect()
    left = Counter((r.doc_id, " ".join(r.text.split())) for r in got)
    assert {x: n for x, n in left.items() if x[0] in range(4)} == {(i, texts[i]): 1 for i in range(4)} and left[None, "x"] == 2
    assert all(r.text_sha256 == "keep" and r.n_chars == len(r.text) for r in got)


def test_near_tables_find_pairs_at_the_threshold():
    """Of 8,000 lone pairs at exactly 0.8, at most one in 500 shares no bucket."""
    rng = np.random.default_rng(21)
    tables, n = pipeline.NEAR_TABLES, 8000
    sets = rng.integers(0, 1 << 63, (n, 10), dtype=np.uint64)  # eight shared shingles and one of each side's own
    a, b = (TensorSketch(tables, pipeline.NEAR_ROWS).halves([np.sort(np.append(s[:8], s[k])) for s in sets]) for k in (8, 9))
    same = a == b
    found = same[:, :tables].any(axis=1) & same[:, tables:].any(axis=1)
    assert (~found).sum() <= n / 500
