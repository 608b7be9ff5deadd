"""Token ids on disk: one zstandard frame per document under a shared dictionary, with an index of offsets."""

from __future__ import annotations

import functools
import itertools
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, need, small_batches
from .sentencepieces import ChunkTable

#: File format. A shard is: magic, the dictionary's sha256, the frames one after the other, the index, and
#: the tail. An index entry has a document's id, the offset of its frame, and its number of ids.
MAGIC = b"QSTOK001"
_ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n_tokens", "<u4")])
_TAIL = struct.Struct("<QQ8s")  # where the index starts, number of documents, magic

_MADE = pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

#: Texts of these characters only are split here; all others go to the library whole. Characters that lower-case
#: to others than these, as U+018F does, are not plain: the local pattern knows none of those as letters.
_PLAIN_CHARS = "".join(c for c in map(chr, (*b"\t\n\r", *range(0x20, 0x7F), *range(0xA1, 0x250))) if all(x < "\u0250" for x in c.lower()))
_PLAIN = re.compile(f"[{re.escape(_PLAIN_CHARS)}]*")


@functools.lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Encodes texts as `Tokenizer.encode(text, add_special_tokens=False)` does, through a table of words.

    A tokenizer whose pre-tokeniser is a split into words encodes each word by itself. Its words hold no white
    space, so the table has the chunks between white space: each distinct one is cut with the tokenizer's own
    pattern, and the library's merges run on its words once. That holds for
    texts in NFC of plain characters and for a tokenizer of this form; anything else goes to the library whole.
    """

    def __init__(self, path: str, most: int = 700_000):
        import json

        import regex
        from tokenizers import pre_tokenizers

        self.tk = tokenizer(path)
        form = json.loads(self.tk.to_str())
        self.words = None
        want = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
        steps = (form.get("pre_tokenizer") or {}).get("pretokenizers") or []
        plain = (form.get("normalizer") or {}).get("normalizers") == want and len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        self.wide = self.tk.get_vocab_size() > 1 << 16
        self.kind = "I" if self.wide else "H"
        if plain and form["post_processor"] is None and form["model"].get("dropout") is None:
            # In plain texts, letters and digits of the pattern are these characters.
            plain_chars = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250))]
            letters = "".join(re.escape(c) for c in plain_chars if regex.match(r"\p{L}", c))
            digits = "".join(re.escape(c) for c in plain_chars if regex.match(r"\p{N}", c))
            pattern = steps[0]["pattern"]["Regex"]
            if pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
                self.words = re.compile(f"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{digits}]|[^\\s{letters}{digits}]+").findall
        self.special = tuple(t.content for t in self.tk.get_added_tokens_decoder().values())
        model, level, words = self.tk.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), self.words

        def merges(chunk: str) -> list[int]:
            return [t.id for w in words(chunk) for t in model.tokenize(w if w.isascii() else level.pre_tokenize_str(w)[0][0])]

        self.table = ChunkTable(merges, most, self.kind)

    def blob(self, text: str) -> bytes:
        """The packed ids of a text."""
        if self.words is None or not _PLAIN.fullmatch(text) or not unicodedata.is_normalized("NFC", text) or any(s in text for s in self.special):
            return array(self.kind, self.tk.encode(text, add_special_tokens=False).ids).tobytes()
        return self.table.join(text.lower().split())

    def blobs(self, texts: list[str | None]) -> list[bytes]:
        """Of many; null counts as empty."""
        return [self.blob(t or "") for t in texts]


@functools.lru_cache(2)
def encoder(path: str, most: int) -> WordEncoder:
    """One for each Python worker, which many tasks use in turn."""
    return WordEncoder(path, most)


def filesystem(uri: str):
    """(file system, path) of a URI, for executors as for the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: What a document gives to the training of the dictionary: pieces of so many bytes, and so many of them at most.
PIECE_BYTES, PIECES = 1 << 13, 16


def pieces(ids: bytes) -> list[bytes]:
    """Serialized ids for training: whole if they are few, else pieces of equal distance from the first to the last."""
    last = len(ids) - PIECE_BYTES
    if last <= 0:
        return [ids]
    n = min(PIECES, -(-len(ids) // PIECE_BYTES))
    return [ids[a : a + PIECE_BYTES] for a in (last * k // (n - 1) // 4 * 4 + last % 4 * (k == n - 1) for k in range(n))]


def plain_dictionary(blobs: list[bytes], dict_bytes: int, end: bytes) -> bytes:
    """The dictionary of tables too small to train one: the sampled ids themselves, in order of size, and some end ids."""
    return (b"".join(sorted(blobs, key=lambda b: (len(b), b))) + end)[-max(dict_bytes, len(end)) :]


def train_dictionary(docs: DataFrame, path: str, sample_docs: int, dict_bytes: int, end_id: int) -> bytes:
    """A zstandard dictionary trained on the serialized ids of a bounded sample: the rows least by a hash of the id."""
    import zstandard

    def ids(batches):
        enc = encoder(path, 700_000)
        for b in batches:
            for text in b.column(0):
                own = pieces(enc.blob(text.as_py() or "") + array(enc.kind, [end_id]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], names=["ids"])

    sample = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).select("text")
    blobs = [bytes(r.ids) for r in sample.mapInArrow(ids, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(dict_bytes, blobs).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples for the trainer
        return plain_dictionary(blobs, dict_bytes, array(encoder(path, 700_000).kind, [end_id] * 8).tobytes())


def write_shard(folder: str, part: int, dictionary: bytes, rows: Iterator[tuple[int, bytes, int]], level: int = 3) -> tuple[str, int, int]:
    """Write (doc_id, packed ids, n) rows as a shard; its path, documents and ids. A retried task writes its own file."""
    import zstandard

    fs, base = filesystem(folder)
    name = f"shard-{part:06d}-{uuid.uuid4().hex}.qstok"
    pressed = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_dict_id=False)
    index, at, total = [], len(MAGIC) + 32, 0
    with fs.open_output_stream(f"{base}/{name}", buffer_size=1 << 20) as out:
        out.write(MAGIC + sha256(dictionary).digest())
        for doc_id, ids, n in rows:
            frame = pressed.compress(ids)
            out.write(frame)
            index.append((doc_id, at, n))
            at, total = at + len(frame), total + n
        out.write(np.array(index, _ENTRY).tobytes())
        out.write(_TAIL.pack(at, len(index), MAGIC))
    return name, len(index), total


class Shard:
    """A shard for reading: the index is in memory, frames are read as they are asked for."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        import zstandard

        fs, base = filesystem(folder)
        self.file = fs.open_input_file(f"{base}/{name}")
        size = self.file.size()
        self.file.seek(size - _TAIL.size)
        self.end, n, magic = _TAIL.unpack(self.file.read(_TAIL.size))
        self.file.seek(0)
        head = self.file.read(len(MAGIC) + 32)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{name} is not a token shard")
        if head[len(MAGIC) :] != sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self.file.seek(self.end)
        self.index = np.frombuffer(self.file.read(n * _ENTRY.itemsize), _ENTRY)
        self.dctx = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def frames(self, first: int, last: int) -> list[bytes]:
        """The packed ids of documents [first, last) in the shard, read in one piece."""
        if first >= last:
            return []
        ends = np.append(self.index["offset"][first + 1 : last], self.index["offset"][last] if last < len(self.index) else self.end)
        at = int(self.index["offset"][first])
        self.file.seek(at)
        data = self.file.read(int(ends[-1]) - at)
        return [self.dctx.decompress(data[int(a) - at : int(b) - at]) for a, b in zip(self.index["offset"][first:last], ends, strict=True)]

    def document(self, k: int, kind: str = "<u2") -> np.ndarray:
        """Short-document access: the ids of the k-th document alone."""
        return np.frombuffer(self.frames(k, k + 1)[0], kind)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None, shards: int | None = None, shard_bytes: int = 16 << 20, dict_docs: int = 500, dict_bytes: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write the ids of all documents in ascending doc_id order; what `read_tokens` needs: folder, dictionary, shards.

    Documents are dealt to shards by ranges of doc_id (and of a hash of the text, so that rows of one id or of none
    don't need to fit a shard), one for about `shard_bytes` of text unless `shards` says how many, and sorted within; each task encodes its shard, appends
    `end_id`, and streams frames into a file of its own, so memory holds one batch and the index. The
    dictionary is trained on at most `dict_docs` documents, encoded whole, of which each gives at most 16 pieces
    of 8 KB of ids from all over it, and is at most `dict_bytes` large; where they are too few or short to train one,
    the ids sampled are the dictionary. The driver gets a row per shard. Null texts count as empty and give the end id alone;
    null ids come first; rows of equal ids keep together in no set order among equal texts. Ids are 16 bits
    wide if the vocabulary allows it, else 32. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    folder = folder or fresh_path(spark, "tokens")
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    dictionary = train_dictionary(rows, tokenizer_path, dict_docs, dict_bytes, end_id)
    with fs.open_output_stream(f"{base}/dictionary") as out:
        out.write(dictionary)

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer_path, 700_000)
        end = array(enc.kind, [end_id]).tobytes()
        least: list = []

        def encoded():
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1)
                if not least and ids:
                    least.append(ids[0])
                for at in range(0, len(ids), 100):
                    for i, blob in zip(ids[at : at + 100], enc.blobs(texts.slice(at, 100).to_pylist()), strict=True):
                        yield -(1 << 63) if i is None else i, blob + end, len(blob) // len(end) + 1

        first = next(it := encoded(), None)
        if first:
            part = TaskContext.get().partitionId()
            name, n, total = write_shard(folder, part, dictionary, itertools.chain([first], it))
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "docs": n, "tokens": total}], schema=_MADE)

    shards = shards or max(1, -(-(rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) // shard_bytes))
    ranged = rows.withColumn("code", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "code").sortWithinPartitions("doc_id", "code", "text").select("doc_id", "text")
    made = ranged.mapInArrow(run, "part int, name string, docs long, tokens long").collect()
    made = sorted(made, key=lambda r: r.part)
    starts = [0, *itertools.accumulate(r.tokens for r in made)]
    return {"folder": folder, "kind": encoder(tokenizer_path, 700_000).kind, "shards": [(r.name, r.docs, s) for r, s in zip(made, starts, strict=False)]}


def read_tokens(spark: SparkSession, store: dict, block_docs: int = 500) -> DataFrame:
    """Read the files back: (doc_id, start, n_tokens, ids) in file order; start counts all ids before the document."""
    folder, wide = store["folder"], store["kind"] == "I"
    table = spark.createDataFrame([(k, *s) for k, s in enumerate(store["shards"])], "k int, name string, docs long, base long")

    def run(batches):
        fs, base = filesystem(folder)
        with fs.open_input_stream(f"{base}/dictionary") as f:
            dictionary = f.read()
        for b in batches:
            for name, start in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                shard = Shard(folder, name, dictionary)
                for at in range(0, len(shard.index), block_docs):
                    frames = shard.frames(at, min(at + block_docs, len(shard.index)))
                    own = shard.index[at : at + block_docs]
                    ids = [np.frombuffer(x, "<u4" if wide else "<u2").astype("<u4").tobytes() for x in frames]
                    n = np.array([len(x) // 4 for x in ids], np.int64)
                    if not (n == own["n_tokens"]).all():
                        raise ValueError(f"{name}: index and frames disagree")
                    starts = start + np.cumsum(n) - n
                    start += int(n.sum())
                    doc_ids = pa.array(own["doc_id"], pa.int64(), mask=own["doc_id"] == -(1 << 63))
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    n = max(1, len(store["shards"]))
    return table.repartition(n, "k").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of tokens as read."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def reference_crc(path: str, text: str | None, end_id: int = 2) -> tuple[int, int]:
    """What the library alone gives for a text; for tests."""
    ids = [*tokenizer(path).encode(text or "", add_special_tokens=False).ids, end_id]
    return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
