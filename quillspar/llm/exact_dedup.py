"""Exact deduplication by Grace hash partitioning."""

from __future__ import annotations

import os
import shutil
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, partitions, small_batches

_WS = b" \t\n\v\f\r"


def normalised(text: bytes | None) -> bytes:
    r"""The text with each run of `[\x20\x09-\x0D]` replaced by one space; null counts as empty."""
    if not text:
        return b""
    words = text.split()
    if not words:
        return b" "
    return b" " * (text[0] in _WS) + b" ".join(words) + b" " * (text[-1] in _WS)


class OpenTable:
    """An open-addressing table of records by complete content; equal records fold into one."""

    def __init__(self):
        self.slots: list[int] = [-1] * 64
        self.rows: list[list] = []  # hash, content, smallest id, count
        self.bytes = 0

    def add(self, code: int, content: bytes, least: int, count: int, new: bool = True) -> bool:
        """Fold the record into an equal one, or put it in if it may be `new`; whether the table has it now."""
        mask = len(self.slots) - 1
        at = code & mask
        while (k := self.slots[at]) >= 0:
            row = self.rows[k]
            if row[0] == code and row[1] == content:
                row[2], row[3] = min(row[2], least), row[3] + count
                return True
            at = (at + 1) & mask
        if not new:
            return False
        self.slots[at] = len(self.rows)
        self.rows.append([code, content, least, count])
        self.bytes += len(content) + 160
        if 3 * len(self.rows) > 2 * len(self.slots):
            self._grow()
        return True

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for k, row in enumerate(self.rows):
            at = row[0] & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


_HEAD = struct.Struct("<QqqI")


def grace(records: Iterator[tuple[int, bytes, int, int]], budget: int, fan_out: int = 16, depth: int = 0) -> Iterator[list]:
    """Distinct (hash, content, smallest id, count) of records, in at most about `budget` bytes of memory.

    Records go into a table until it is full. From then on, records whose content is in the table still
    fold into it, and the others go to spill files by the next four bits of the hash; each file is then
    handled in the same way. At the depth where no bits are left, the table takes what comes.
    """
    table, files, folder = OpenTable(), None, None
    shift = 60 - 4 * depth
    try:
        for code, content, least, count in records:
            if table.add(code, content, least, count, files is None and (table.bytes < budget or shift < 0)):
                continue
            if files is None:
                folder = tempfile.mkdtemp(prefix="grace-")
                files = [open(os.path.join(folder, str(i)), "wb") for i in range(fan_out)]
            _put(files, (code, content, least, count), shift)
        yield from table.rows
        table = OpenTable()
        for f in files or []:
            f.close()
            yield from grace(_records(f.name), budget, fan_out, depth + 1)
            os.unlink(f.name)
    finally:
        for f in files or []:
            f.close()
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def _put(files: list, row, shift: int) -> None:
    code, content, least, count = row
    out = files[code >> shift & len(files) - 1]
    out.write(_HEAD.pack(code, least, count, len(content)))
    out.write(content)


def _records(path: str) -> Iterator[tuple[int, bytes, int, int]]:
    with open(path, "rb") as f:
        while head := f.read(_HEAD.size):
            code, least, count, n = _HEAD.unpack(head)
            yield code, f.read(n), least, count


_FOLDED = pa.schema([("hash", pa.int64()), ("digest", pa.binary()), ("content", pa.binary()), ("least", pa.int64()), ("n", pa.int64())])


def _batches(rows: Iterator[list], digests: bool, size: int = 500):
    from hashlib import sha256

    cols: list[list] = [[], [], [], [], []]
    held = 0
    for code, content, least, count in rows:
        signed = code - (1 << 64) if code >> 63 else code
        for c, v in zip(cols, (signed, sha256(content).digest() if digests else None, None if digests else content, least, count), strict=True):
            c.append(v)
        held += len(content)
        if len(cols[0]) >= size or held > 1 << 23:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOLDED, strict=True)], schema=_FOLDED)
            cols, held = [[], [], [], [], []], 0
    if cols[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOLDED, strict=True)], schema=_FOLDED)


def exact_dedup(docs: DataFrame, memory_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each `[\x20\x09-\x0D]+` by one space. Copies within an
    input partition fold together before anything is shuffled, so a text with a third of all rows sends one
    record per input partition; the buckets compare complete contents (`grace`). What comes back to the
    documents is one small row per distinct text, joined on the digest; adaptive execution splits hot digests.

    Null texts count as empty. Rows with the same id count one by one, and all of them are `kept` when that id
    stays. A null id is never the one that stays unless all ids of its group are null. An empty table gives an
    empty result. Other columns are not read. Each task keeps at most about `memory_bytes` in its table.
    """
    from xxhash import xxh3_64_intdigest as xxh

    small_batches(docs.sparkSession)
    rows = need(docs, id_col, text_col).toDF("doc_id", "text")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    top = (1 << 63) - 1

    def fold(batches):
        def records():
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                    content = normalised(t.as_py())
                    yield xxh(content), content, top if i is None else i, 1

        yield from _batches(grace(records(), memory_bytes // 2), False)

    def merge(batches):
        def records():
            for b in batches:
                for code, content, least, n in zip(*(b.column(c).to_pylist() for c in ("hash", "content", "least", "n")), strict=True):
                    yield code & (1 << 64) - 1, content, least, n

        yield from _batches(grace(records(), memory_bytes), True)

    kind = "hash long, digest binary, content binary, least long, n long"
    folded = rows.mapInArrow(fold, kind)
    classes = folded.repartition(partitions(docs.sparkSession), "hash").mapInArrow(merge, kind)
    classes = classes.select(F.lower(F.hex("digest")).alias("text_sha256"), F.nullif("least", F.lit(top)).alias("keep_id"), F.col("n").alias("group_size"))
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    members = rows.select("doc_id", F.sha2(clean.cast("binary"), 256).alias("text_sha256"))
    joined = members.hint("merge").join(classes, "text_sha256", "left")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
