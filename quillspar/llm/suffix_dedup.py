"""Removal of repeated passages by prefix-free parsing and suffix arrays."""

from __future__ import annotations

import re
import struct
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BLOCK_BYTES, SPACE, RollingHash, in_blocks, mix, partitions, release, small_batches, stored, texts_of


# ---- suffix arrays


def suffix_ranks(first: np.ndarray, group_end: np.ndarray, step: int, depth: int) -> np.ndarray:
    """Ranks of suffixes, equal ranks where the first `depth` symbols (to the group's end) are equal.

    `first` ranks the first `step` symbols of each suffix. Prefix doubling: each round sorts only suffixes
    whose rank is still shared, by the rank that stands as many symbols on as are sorted so far.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    rank = np.empty(n, np.int64)
    new = np.append(True, ordered[1:] != ordered[:-1]) if n else np.zeros(0, bool)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1 if n else 0
    open_ = order[~(new & np.append(new[1:], True))] if n else order
    while step < depth and len(open_):
        on = open_ + step
        second = np.where(on < group_end[open_], rank[np.minimum(on, n - 1)], 0)
        by = np.lexsort((second, rank[open_]))
        open_, second = open_[by], second[by]
        old = rank[open_]
        head = np.append(True, old[1:] != old[:-1])
        new = head | np.append(True, second[1:] != second[:-1])
        at = np.arange(len(open_))
        # a group's ranks go from its old rank upwards, one for each member
        start = np.maximum.accumulate(np.where(head, at, 0))
        rank[open_] = old + np.maximum.accumulate(np.where(new, at, 0)) - start
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= 2
    return rank


def parse(data: np.ndarray, offsets: np.ndarray, hashes: RollingHash, width: int = 8, modulus: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Prefix-free parse: where phrases start and end.

    A window of `width` bytes whose rolling hash is 0 modulo `modulus` is a trigger. A phrase goes from a
    trigger (or a text's start) to the end of the next trigger (or of the text), so that neighbours overlap
    by `width` bytes, and no phrase's suffix longer than that is a proper prefix of another's.
    """
    codes = hashes.every(width)
    trigger = (codes % np.uint64(modulus) == 0) if len(codes) else np.zeros(0, bool)
    at = np.flatnonzero(trigger)
    of = np.searchsorted(offsets, at, "right") - 1
    at = at[(at + width <= offsets[of + 1]) & (at > offsets[of])]
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], at)
    text_end = offsets[np.searchsorted(offsets, starts, "right")]
    following = np.append(starts[1:], len(data))
    return starts, np.minimum(np.where(following < text_end, following + width, text_end), text_end)


def repeated_windows(data: np.ndarray, offsets: np.ndarray, span: int, width: int = 8, modulus: int = 32) -> np.ndarray:
    """For each byte position, whether the `span` bytes from it, within its text, also start elsewhere in data.

    The suffix array of the dictionary of distinct phrases, in bytes, and that of the parse, in phrases,
    combine into corpus order: a position is ordered by the rank of its phrase's rest in the dictionary, then
    by the rank of the parse from the next phrase on. Equal strings stand together in that order, so
    comparing neighbours finds all of them.
    """
    n = len(data)
    out = np.zeros(n, bool)
    position = np.arange(n)
    text_end = np.repeat(offsets[1:], np.diff(offsets))
    windows = position[position + span <= text_end]
    if len(windows) < 2:
        return out
    hashes = RollingHash(data)
    starts, ends = parse(data, offsets, hashes, width, modulus)
    last = ends == offsets[np.searchsorted(offsets, starts, "right")]  # phrases without a trigger at their end
    known: dict[tuple[bytes, bool], int] = {}
    raw = data.tobytes()
    phrase = np.fromiter((known.setdefault((raw[a:b], c), len(known)) for a, b, c in zip(starts.tolist(), ends.tolist(), last.tolist(), strict=True)), np.int64, len(starts))
    _, at = np.unique(phrase, return_index=True)

    # dictionary: its bytes, one phrase after the other, and ranks of all suffixes of phrases
    length = (ends - starts)[at]
    begin = np.concatenate([[0], np.cumsum(length)])
    inside = np.arange(begin[-1]) - np.repeat(begin[:-1], length)
    source = np.repeat(starts[at], length) + inside
    group_end = np.repeat(begin[1:], length)
    head = np.zeros(len(source), np.uint64)
    for k in range(7):  # seven bytes and how many there are
        there = np.arange(len(source)) + k < group_end
        head = head * np.uint64(257) + np.where(there, data[np.minimum(source + k, n - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    in_dictionary = suffix_ranks(head, group_end, 7, span + width)

    # parse: the dictionary's ranks of whole phrases, and ranks of all suffixes of texts in phrases
    symbols = in_dictionary[begin[:-1]][phrase] * 2 + last
    text = np.searchsorted(offsets, starts, "right")
    parse_end = np.searchsorted(text, text, "right")
    in_parse = suffix_ranks(symbols, parse_end, 1, span)

    # corpus order of the windows
    phrase_of = np.searchsorted(starts, windows, "right") - 1
    rest = in_dictionary[begin[phrase[phrase_of]] + windows - starts[phrase_of]]
    following = phrase_of + 1
    then = np.where(following < parse_end[phrase_of], in_parse[np.minimum(following, len(starts) - 1)], 0)
    order = np.argsort(rest.astype(np.uint64) << np.uint64(32) | then.astype(np.uint64), kind="stable")
    ordered = windows[order]
    codes = hashes.of(ordered, ordered + span)
    same = np.flatnonzero(codes[1:] == codes[:-1])  # the hash proposes, the bytes decide
    one, two = np.minimum(ordered[same], ordered[same + 1]), np.maximum(ordered[same], ordered[same + 1])
    equal = equal_windows(data, one, two, span)
    out[one[equal]] = True
    out[two[equal]] = True
    return out


def equal_windows(data: np.ndarray, one: np.ndarray, two: np.ndarray, span: int) -> np.ndarray:
    """Whether the `span` bytes from one[k] are those from two[k]. Neighbouring pairs share their comparisons."""
    n = len(one)
    if not n:
        return np.zeros(0, bool)
    far = two - one
    by = np.lexsort((one, far))
    at, far = one[by], far[by]
    new = np.append(True, (far[1:] != far[:-1]) | (at[1:] - at[:-1] > span))
    begin, end = at[new], at[np.append(np.flatnonzero(new)[1:], n) - 1] + span
    size = end - begin
    first = np.cumsum(size) - size
    index = np.arange(size.sum()) + np.repeat(begin - first, size)
    unlike = np.concatenate([[0], np.cumsum(data[index] != data[index + np.repeat(far[new], size)])])
    place = at + (first - begin)[np.cumsum(new) - 1]
    out = np.empty(n, bool)
    out[by] = unlike[place + span] == unlike[place]
    return out


# ---- anchors: what brings equal strings together


def anchors(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Runs of windows by the place they hang on: (key, context, first window, last window, anchor).

    A window of `span` bytes hangs on the leftmost of its substrings of half that length with the least
    rolling hash. That depends on the window's bytes alone, so equal windows hang on equal substrings (the
    key) at equal distances; neighbouring windows mostly hang on the same one, and a run of them is one
    row. The context is the hash of all bytes of a run and its place about the anchor.
    """
    half = span // 2
    empty = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    if len(data) < span:
        return empty
    hashes = RollingHash(data)
    codes = hashes.every(half)
    bits = np.uint64(max(22, int(len(data)).bit_length()))
    packed = (codes >> bits << bits) | np.arange(len(codes), dtype=np.uint64)
    low, wide = packed, 1
    while 2 * wide <= span - half + 1:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    rest = span - half + 1 - wide
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    good = np.zeros(len(at), bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        good[a : max(a, b - span + 1)] = True
    windows = np.flatnonzero(good)
    if not len(windows):
        return empty
    at = at[windows]
    new = np.append(True, (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1))
    first, last, at = windows[new], windows[np.append(np.flatnonzero(new)[1:], len(windows)) - 1], at[new]
    context = mix(hashes.of(first, last + span) ^ mix(((at - first) * (span + 1) + at - last).astype(np.uint64)))
    return codes[at], context, first, last, at


_ANCHORS = "key long, context long, node long, tag int, first int, last int, anchor int"


def _find_anchors(span: int):
    """(node, tag, text) batches as runs of windows."""

    def run(batches):
        for batch in batches:
            nodes, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, offsets = texts_of(batch.column(2))
            for a, b in in_blocks(offsets):
                own = offsets[a : b + 1]
                for at in range(own[0], max(own[0] + 1, own[-1] - span + 1), BLOCK_BYTES):  # a longer text in overlapping pieces
                    until = min(own[-1], at + BLOCK_BYTES + span - 1)
                    if b - a > 1:
                        at, until = own[0], own[-1]
                    key, context, first, last, anchor = anchors(data[at:until], np.clip(own, at, until) - at, span)
                    doc = np.searchsorted(own, first + at, "right") - 1
                    shift = at - own[doc]
                    if len(key):
                        places = (pa.array((x + shift).astype(np.int32)) for x in (first, last, anchor))
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), pa.array(nodes[a + doc]), pa.array(tags[a + doc]), *places], names=["key", "context", "node", "tag", "first", "last", "anchor"])
                    if b - a > 1:
                        break

    return run


#: A part of a content: its key, context, first and last window in the text, and anchor, 8 bytes each.
_PART = struct.Struct("<5q")
_CONTENTS = pa.schema([("route", pa.int64()), ("base", pa.int32()), ("content", pa.binary()), ("parts", pa.binary())])
_FOUND = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
#: Into so many ranges of distances from the anchor the windows of a key of many contexts are split.
RANGES = 8


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def contents_of(raw: bytes, wanted: list[tuple], span: int, split_contexts: int) -> list[tuple[int, int, bytes, bytes]]:
    """(route, base, content, parts) of the runs (route, first, last, anchor, key, context, m, main) that a text is asked for.

    m is 0 for runs whose key has one context. Of those, runs that follow one another on the same route are one
    content, as their windows are one piece of the text. Runs of a key of more than `split_contexts` contexts are
    split by the windows' distance from the anchor, and each range of distances is routed by the bytes that all
    its windows hold; equal windows stand at the same distance and hold the same bytes, so they still meet.
    """
    half, out = span // 2, []
    chain: list = []  # route, first, last, parts

    def close():
        if chain:
            out.append((chain[0], chain[1], raw[chain[1] : chain[2] + span], b"".join(chain[3])))
            chain.clear()

    for route, first, last, anchor, key, context, m, main in sorted(wanted):
        part = [_PART.pack(key, context, first, last, anchor)] if main else []
        if m > split_contexts:
            rest = span - half  # windows start 0 to `rest` bytes before their anchor
            for k in range(RANGES):
                near, far = (rest + 1) * k // RANGES, (rest + 1) * (k + 1) // RANGES - 1
                a, b = max(first, anchor - far), min(last, anchor - near)
                if a <= b:
                    core = raw[anchor - near : anchor + half + rest - far]
                    own = int.from_bytes(blake2b(core, digest_size=8, salt=bytes([k])).digest(), "little", signed=True)
                    out.append((own, a, raw[a : b + span], _PART.pack(key, context, a, b, anchor) if main else b""))
            continue
        if chain and m == 0 and chain[0] == route and chain[2] + 1 == first:
            chain[2] = last
            chain[3] += part
            continue
        close()
        chain[:] = [route, first, last, part]
        if m:
            close()
    close()
    return out


def _contents(span: int, split_contexts: int, words: bool):
    """(node, tag, text, wanted) batches as contents. Of rows that repeat an id and a text and follow one another, two are sent."""

    def run(batches):
        last, times = None, 0
        for batch in batches:
            for node, tag, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                last, times = (node, tag), times + 1 if last == (node, tag) else 1
                if times > 2:
                    continue
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if words:
                    raw = word_codes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes()
                rows = contents_of(raw, [tuple(w[c] for c in ("route", "first", "last", "anchor", "key", "context", "m", "main")) for w in wanted], span, split_contexts)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CONTENTS, strict=True)], schema=_CONTENTS)

    return run


def _search(span: int, task_bytes: int):
    """Over contents sorted by route: whole routes, as many as fit, are searched together."""

    def found(rows: list):
        data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])])
        mask = repeated_windows(data, offsets, span)
        out = []
        for (_, base, _, parts), start in zip(rows, offsets.tolist(), strict=False):
            for key, context, first, last, anchor in np.frombuffer(parts, np.int64).reshape(-1, 5).tolist():
                lo, hi = _runs(mask[start + first - base : start + last - base + 1])
                out += [(key, context, int(a) + first - anchor, int(b) - 1 + first - anchor) for a, b in zip(lo, hi, strict=True)]
        cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)

    def run(batches):
        held, size, group, group_size = [], 0, [], 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if group and group[0][0] != r[0]:
                    if held and size + group_size > task_bytes:
                        yield found(held)
                        held, size = [], 0
                    held, size, group, group_size = held + group, size + group_size, [], 0
                group.append(r)
                group_size += len(r[2])
        if held and size + group_size > task_bytes:
            yield found(held)
            held = []
        if held or group:
            yield found(held + group)

    return run


#: Bytes that stand for a word where repeats are judged by words.
WORD_BYTES = 8
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and how many words are before each text's end; the first is 0."""
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return RollingHash(data).of(start, end), np.searchsorted(start, offsets)


def _code_words(batches):
    """Texts as the hashes of their words, so that windows of bytes there are windows of words."""
    for batch in batches:
        data, offsets = texts_of(batch.column(2))
        for first, last in in_blocks(offsets):
            codes, at = word_codes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            raw = codes.tobytes()
            texts = [raw[WORD_BYTES * a : WORD_BYTES * b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(texts, pa.binary())], names=["node", "tag", "text"])


def repeated_spans(docs: DataFrame, span: int = 400, split_contexts: int = 4000, task_bytes: int = 1 << 20, words: bool = False) -> DataFrame:
    """(node, tag, spans: array of [lo, hi] window starts) of texts with strings that occur elsewhere.

    docs has (node, tag, text); rows of one node and tag hold the same text. Hashes only bring equal strings
    together; which windows are repeated, the suffix arrays decide, on bytes.

    1. Every whole text is cut into runs of windows by anchors; a run's row is seven numbers. A window belongs to
       one run, and equal windows have the same key.
    2. Runs whose key occurs once end here.
    3. Of runs of one key and context, the first and the last send their text: they confirm each other. Where a
       key has one context, the two go to a route of their two documents, on which neighbouring runs are one
       piece of text; where it has several, all meet on the key's route (see `contents_of` for very many).
    4. A task runs `repeated_windows` over whole routes. What it finds for a context holds for its other runs.

    A row holds the runs of one document at most, which grow as its text does. With `words`, what is searched is
    the hashes of a text's words instead (`_code_words`), coded in the same worker that reads them.
    """
    spark = docs.sparkSession
    find = _find_anchors(span)
    all_runs = stored(docs.mapInArrow((lambda batches: find(_code_words(batches))) if words else find, _ANCHORS), "anchors")
    # written first, so that the join has two plain exchanges and adaptive execution can split a hot key
    keys = stored(all_runs.groupBy("key").agg(F.count("*").alias("n"), (F.min("context") == F.max("context")).alias("alone")).where("n > 1").select("key", "alone"), "keys")
    runs = stored(all_runs.join(keys, "key"), "runs")
    release(all_runs, keys)

    place = F.struct("node", "tag", "first", "last", "anchor")
    contexts = runs.groupBy("key", "context", "alone").agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("b"))
    per_key = runs.where("not alone").select("key", "context").distinct().groupBy("key").agg(F.count("*").cast("int").alias("m"))
    contexts = contexts.join(per_key, "key", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    route = F.when(F.col("alone"), F.xxhash64("a.node", "a.tag", "b.node", "b.tag")).otherwise(F.col("key"))
    same = F.col("a") == F.col("b")

    def sender(of: str, main: bool):
        return F.struct(*[F.col(f"{of}.{c}") for c in ("node", "tag")], route.alias("route"), *[F.col(f"{of}.{c}") for c in ("first", "last", "anchor")], F.col("key"), F.col("context"), F.col("m"), F.lit(main).alias("main"))

    both = F.when((F.col("n") > 1) & ~same, F.array(sender("a", True), sender("b", False))).otherwise(F.array(sender("a", True)))
    asked = contexts.select(F.explode(both).alias("s")).select("s.*")
    wanted = asked.groupBy("node", "tag").agg(F.collect_list(F.struct(*asked.columns[2:])).alias("wanted"))
    sent = docs.join(wanted, ["node", "tag"]).select("node", "tag", "text", "wanted").mapInArrow(_contents(span, split_contexts, words), "route long, base int, content binary, parts binary")
    found = sent.repartition(partitions(spark), "route").sortWithinPartitions("route").mapInArrow(_search(span, task_bytes), "key long, context long, lo int, hi int")
    verdicts = stored(found.groupBy("key", "context").agg(F.collect_list(F.struct("lo", "hi")).alias("parts")), "verdicts")

    moved = F.transform("parts", lambda p: F.struct((p["lo"] + F.col("anchor")).alias("lo"), (p["hi"] + F.col("anchor")).alias("hi")))
    hits = runs.join(verdicts, ["key", "context"]).select("node", "tag", moved.alias("spans"))
    # a set, so that rows that repeat an id and a text hold their spans once
    return hits.groupBy("node", "tag").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def merged(spans: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
    """The maximal runs [start, end) of bytes that windows cover."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + span)
        else:
            out.append([lo, hi + span])
    return [(a, b) for a, b in out]


def to_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without characters that they cover in part."""
    out = []
    for a, b in runs:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def word_runs(raw: bytes, spans: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """The bytes [start, end) that windows of words cover, of spans over word codes; those within a word's code don't count."""
    whole = [(-(-lo // WORD_BYTES), hi // WORD_BYTES) for lo, hi in spans]
    runs = merged([(a, b) for a, b in whole if a <= b], words - 1)  # to the last word; runs that share none stay apart
    at = [m.span() for m in _WORD.finditer(raw)] if runs else []
    return [(at[a][0], at[min(b, len(at) - 1)][1]) for a, b in runs if a < len(at)]


_CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def suffix_dedup(docs: DataFrame, span: int = 400, characters: bool = False, split_contexts: int = 4000, task_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), words: int = 0) -> DataFrame:
    r"""Remove every byte of a string of `span` bytes that also starts anywhere else, in any document or the same.

    With `words`, strings of so many words `[^\x20\x09-\x0D]+` are searched instead: each that also occurs elsewhere
    goes, from its first word to its last, however short in bytes and whatever white space stands between its
    words. Words are compared by 64-bit hashes; `span` isn't used then.

    One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and
    kept_text. With `characters`, only characters that are covered as a whole go, so that what is left is
    text; else kept_text is null and the figures are of bytes.

    Texts are UTF-8 bytes, null counts as empty; texts shorter than `span` stay as they are. Overlaps count,
    matches never cross documents, and strings are judged on the input. All copies of a passage go, the
    first as well. Every row is a document of its own: ids may be null or repeated, and a row that repeats
    another one, id and all, holds what the other holds. Rows are told apart by their id and a hash of their text.
    An empty table gives an empty result. The columns `carry` names follow, as they are; no others are read.
    """
    small_batches(docs.sparkSession)
    span = WORD_BYTES * words if words else span
    text = F.col(f"`{text_col}`")
    own = F.col(f"`{id_col}`").cast("long")
    held = [f"carry_{k}" for k in range(len(carry))]  # names of their own, so that none can clash
    whole = docs.select(F.coalesce(own, F.xxhash64(text)).alias("node"), F.hash(own.isNull(), text).alias("tag"), own.alias("doc_id"), text.alias("text"), *[F.col(f"`{c}`").alias(h) for c, h in zip(carry, held, strict=True)])
    spans = repeated_spans(whole.select("node", "tag", "text"), span, split_contexts, task_bytes, bool(words))

    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(*(batch.column(c).to_pylist() for c in (1, 2)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                windows = [(s["lo"], s["hi"]) for s in found or []]
                runs = word_runs(raw, windows, words) if words else merged(windows, span)
                runs = to_characters(raw, runs) if characters else runs
                at, kept = 0, []
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                for c, v in zip(out, (len(raw), len(raw) - len(left), len(runs), sha256(left).hexdigest(), left.decode("utf-8", "replace") if characters else None), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)), *batch.columns[3:]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *held])

    kind = StructType([*StructType.fromDDL(f"doc_id long, {_CUT}"), *whole.select(*held).schema])
    done = whole.join(spans, ["node", "tag"], "left").select("doc_id", "text", "spans", *held).mapInArrow(cut, kind)
    return done.toDF(*done.columns[:6], *carry)
