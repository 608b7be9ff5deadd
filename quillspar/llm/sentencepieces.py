"""SentencePiece encoding and decoding through tables of distinct chunks."""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, small_batches

MARK = "▁"
#: Chunks of a marked text: markers, then what follows up to the next marker.
_CHUNK = re.compile(r" *[^ ]+| +$")


@functools.lru_cache(2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_at_markers(path: str) -> bool:
    """Whether the model's pieces can't cross a white-space marker and its normaliser only marks spaces."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(processor(path).serialized_model_proto())
    n = model.normalizer_spec
    plain = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap
    usual = all(p.type in (1, 2, 3, 6) for p in model.pieces)
    return bool(plain and usual and not model.trainer_spec.treat_whitespace_as_suffix and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces))


class ChunkTable(dict):
    """Packed ids of each distinct chunk, which the library segments when it is first asked for.

    Once `most` chunks are in, the table stays as it is: the frequent ones came early.
    """

    def __init__(self, encode: Callable[[str], list[int]], most: int, kind: str):
        super().__init__()
        self.encode, self.most, self.kind = encode, most, kind

    def __missing__(self, chunk: str) -> bytes:
        packed = array(self.kind, self.encode(chunk)).tobytes()
        if len(self) < self.most:
            self[chunk] = packed
        return packed

    def join(self, chunks: list[str]) -> bytes:
        """The ids of chunks, by position."""
        return b"".join(map(self.__getitem__, chunks))


class ChunkEncoder:
    """Encodes texts exactly as the library does; `table` has the chunks that the library segmented."""

    def __init__(self, path: str, most: int = 700_000):
        self.sp = processor(path)
        self.split = splits_at_markers(path)
        self.kind = "H" if self.sp.get_piece_size() <= 1 << 16 else "i"
        self.table = ChunkTable(self.sp.EncodeAsIds if hasattr(self.sp, "EncodeAsIds") else self.sp.encode, most, self.kind)
        self.table[""] = array(self.kind, [self.sp.piece_to_id(MARK)]).tobytes()

    def __call__(self, texts: list[str]) -> list[list[int]]:
        if not self.split:
            return self.sp.encode(texts, num_threads=1) if texts else []
        # A marker that stands in the text itself, or a NUL, is left to the library.
        return [self.sp.encode(t) if not t or MARK in t or "\0" in t else memoryview(self.table.join(chunks(t))).cast(self.kind).tolist() for t in texts]


def chunks(text: str) -> list[str]:
    """The chunks of a marked text, each without its first marker."""
    if text[0] != " " and "  " not in text:
        return text.split(" ")
    return [c[1:] for c in _CHUNK.findall(" " + text)]


@functools.lru_cache(2)
def encoder(path: str, most: int) -> ChunkEncoder:
    """One for each Python worker, which many tasks use in turn."""
    return ChunkEncoder(path, most)


def encode_documents(docs: DataFrame, model_path: str, table_size: int = 700_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for each document: ids end with the model's end id; decoded is the library's decode(ids).

    Because no piece crosses a white-space marker, a text's ids are the concatenated ids of its marked words.
    Each Python worker keeps a table of the distinct marked words it has met (at most `table_size`), has the
    library segment each once, and joins the ids back by position. A table for the whole corpus would grow
    with it and would shuffle every word; a table per worker needs no shuffle.

    Null texts count as empty and give the end id alone. Every row has a row in the result: ids and rows may repeat, ids
    may be null, and an empty table gives an empty result. Other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        encode = encoder(model_path, table_size)
        end = encode.sp.eos_id()
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 100):
                ids = [x + [end] for x in encode([t or "" for t in texts[at : at + 100]])]
                back = encode.sp.decode(ids, num_threads=1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ids)), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])

    rows = need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded documents."""
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def reference_row(path: str, text: str | None) -> tuple[int, str, str]:
    """What the library alone gives for a text; for tests."""
    sp = processor(path)
    ids = sp.encode(text or "", add_eos=True)
    return len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(sp.decode(ids).encode()).hexdigest()
