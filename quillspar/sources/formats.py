"""Readers and writers of sparse-matrix files; Parquet is the native store."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..matrix import SCHEMA, SparseMatrix
from .scratch import Scratch, tasks


def _numbered(spark: SparkSession, path: str, items=None) -> DataFrame:
    """(n, value): lines, or with `items` what that makes of each, with their place over all files in order of name.

    The rows of a split of a file stand in order in one task, so counts by split, which are few, give the place of
    each split's first row; nothing goes through Python or one task but a row for each split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    if items is not None:
        lines = lines.select("_f", "_b", F.explode(items(F.col("value"))).alias("value"))
    lines = lines.withColumn("_r", F.monotonically_increasing_id())
    splits = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_r").alias("_least"))
    before = F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("_f", "_b", (F.coalesce(before, F.lit(0)) - F.col("_least")).alias("_first"))
    return lines.join(starts, ["_f", "_b"]).select((F.col("_first") + F.col("_r")).alias("n"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): lines with their place in the file."""
    return _numbered(spark, path)


def _words(line):
    return F.filter(F.split(line, r"\s+"), lambda t: t != "")


def _entries(df: DataFrame, line: str) -> DataFrame:
    token = F.explode(F.filter(F.split(line, r"\s+"), lambda t: t != ""))
    at = F.split(F.col("t"), ":")
    j, v = F.expr("try_cast(split(t, ':')[0] as bigint)"), F.expr("try_cast(split(t, ':')[1] as double)")
    bad = (F.size(at) != 2) | j.isNull() | v.isNull()
    error = F.raise_error(F.concat(F.lit("malformed entry: "), F.col("t")))
    return df.withColumn("t", token).select("i", F.when(bad, error.cast("long")).otherwise(j).alias("j"), v.alias("v"))


def read_text(spark: SparkSession, path: str) -> SparseMatrix:
    """A header `rows columns`, then a line of `index:value` for each row; short files and bad tokens are errors."""
    lines = numbered_lines(spark, path)
    found = lines.agg(F.max(F.when(F.col("n") == 0, F.col("value"))).alias("head"), F.count("*").alias("lines")).first()
    if found.head is None:
        raise ValueError(f"{path} is empty")
    n_rows, n_cols = map(int, found.head.split())
    if found.lines - 1 < n_rows:
        raise ValueError(f"{path} has fewer than {n_rows} rows")
    body = lines.where((F.col("n") > 0) & (F.col("n") <= n_rows)).select((F.col("n") - 1).alias("i"), "value")
    return SparseMatrix.of(_entries(body, "value"), n_rows, n_cols)


def read_keyed(spark: SparkSession, path: str, n_cols: int = -1) -> tuple[SparseMatrix, DataFrame]:
    """Lines `key<TAB>index:value ...`; also (i, key). Entries from n_cols on are dropped, -1 infers it."""
    lines = numbered_lines(spark, path).select(F.col("n").alias("i"), F.split("value", "\t", 2).alias("p"))
    body = _entries(lines.select("i", F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("value")), "value")
    m = SparseMatrix.of(body if n_cols < 0 else body.where(F.col("j") < n_cols), lines.count(), None if n_cols < 0 else n_cols)
    return m, lines.select("i", F.get("p", F.lit(0)).alias("key"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, name): one name a line."""
    return numbered_lines(spark, path).select(F.col("n").alias("id"), F.col("value").alias("name"))


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """(id, v): numbers between white space, in order."""
    return _numbered(spark, path, _words).select(F.col("n").alias("id"), F.col("value").cast("double").alias("v"))


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """(i, values): a header `rows columns`, then all numbers of a row on a line."""
    return numbered_lines(spark, path).where("n > 0").select((F.col("n") - 1).alias("i"), F.transform(_words("value"), lambda t: t.cast("double")).alias("values"))


#: The binary layout. int32 rows, int32 columns, int64 number of sizes (absent in old files),
#: int32 size of each row, then (int32, float32) pairs; or, planar, all indices and then all values.

#: Rows whose sizes are looked at together, and entries that a task reads at a time.
_STEP = 1 << 20


def _input(path: str):
    """A file that can be read from any place, on executors as on the driver."""
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    return where.open_input_file(base)


def _output(path: str):
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    return where.open_output_stream(base, buffer_size=_STEP)


def _layout(path: str, size_prefix: bool) -> tuple[int, int, list[tuple[int, int, int, int]]]:
    """Rows, columns, and runs of rows (first row, rows, first entry, entries) of about `_STEP` entries each."""
    with _input(path) as f:
        n_rows, n_cols = (int(x) for x in np.frombuffer(f.read(8), "<i4"))
        f.seek(8 + 8 * size_prefix)
        runs, at = [], 0
        for first in range(0, n_rows, _STEP):
            ends = np.cumsum(np.frombuffer(f.read(4 * min(_STEP, n_rows - first)), "<i4"), dtype=np.int64)
            a = 0
            while a < len(ends):
                before = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, before + _STEP, "right")))
                runs.append((first + a, b - a, at + before, int(ends[b - 1]) - before))
                a = b
            at += int(ends[-1])
        if f.size() < 8 + 8 * size_prefix + 4 * n_rows + 8 * at:
            raise ValueError(f"{path} is cut short")
        return n_rows, n_cols, [(*r, at) for r in runs]


def _places(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Places in a file, a task for each, as a table of which Spark doesn't know the size.

    Of a small table it would take what is read there for small as well, and send all of it to the driver and every task.
    """
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), schema)


def read_binary(spark: SparkSession, path: str, planar: bool = False, size_prefix: bool = True) -> SparseMatrix:
    """One file of any size: the driver looks at the sizes of rows, block by block, and tasks read runs of rows."""
    n_rows, n_cols, runs = _layout(path, size_prefix)
    head = 8 + 8 * size_prefix

    def run(batches):
        for b in batches:
            with _input(path) as f:
                for row, rows, entry, n, total in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    sizes = np.frombuffer(f.read_at(4 * rows, head + 4 * row), "<i4")
                    at = head + 4 * n_rows
                    if planar:
                        j, v = np.frombuffer(f.read_at(4 * n, at + 4 * entry), "<i4"), np.frombuffer(f.read_at(4 * n, at + 4 * (total + entry)), "<f4")
                    else:
                        pairs = np.frombuffer(f.read_at(8 * n, at + 8 * entry), [("j", "<i4"), ("v", "<f4")])
                        j, v = pairs["j"], pairs["v"]
                    i = np.repeat(np.arange(row, row + rows), sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in ((i, np.int64), (j, np.int64), (v, np.float64))], names=["i", "j", "v"])

    table = _places(spark, runs, "row long, rows long, entry long, n long, total long")
    return SparseMatrix(table.mapInArrow(run, SCHEMA), n_rows, n_cols)


def read_matrix(spark: SparkSession, path: str) -> SparseMatrix:
    """By suffix: .bin, .pybin (planar), .parquet, otherwise text."""
    if path.endswith(".bin"):
        return read_binary(spark, path)
    if path.endswith(".pybin"):
        return read_binary(spark, path, planar=True)
    if path.endswith(".parquet"):
        shape = spark.read.parquet(f"{path}/shape").first()
        return SparseMatrix(spark.read.parquet(f"{path}/entries"), shape.n_rows, shape.n_cols)
    return read_text(spark, path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(id, v): an int64 count, then float32 values, read in runs by tasks."""
    with _input(path) as f:
        n = int(np.frombuffer(f.read(8), "<i8")[0])

    def run(batches):
        for b in batches:
            with _input(path) as f:
                for first in b.column(0).to_pylist():
                    v = np.frombuffer(f.read_at(4 * min(_STEP, n - first), 8 + 4 * first), "<f4")
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(v))), pa.array(v.astype(float))], names=["id", "v"])

    return _places(spark, [(first,) for first in range(0, n, _STEP)], "first long").mapInArrow(run, "id long, v double")


def text_rows(m: SparseMatrix, precision: int = 5, keys: DataFrame | None = None) -> DataFrame:
    """(i, value): `index:value` lines, also of rows without entries; with keys (i, key), `key<TAB>` before."""
    token = F.concat_ws(":", F.col("j"), F.format_string(f"%.{precision}f", "v"))
    lines = m.df.select("i", F.struct("j", token.alias("t")).alias("e")).groupBy("i").agg(F.array_sort(F.collect_list("e")).alias("es"))
    out = m.rows().join(lines, "i", "left").select("i", F.coalesce(F.concat_ws(" ", F.col("es.t")), F.lit("")).alias("value"))
    return out if keys is None else out.join(keys, "i").select("i", F.concat_ws("\t", "key", "value").alias("value"))


def write_text(m: SparseMatrix, path: str, precision: int = 5, header: bool = True) -> None:
    """Lines in row order over sorted part files, the header first."""
    spark = m.df.sparkSession
    rows = text_rows(m, precision)
    if header:
        rows = rows.unionByName(spark.createDataFrame([(-1, f"{m.n_rows} {m.n_cols}")], "i long, value string"))
    rows.orderBy("i").select("value").write.mode("overwrite").text(path)


def write_keyed(m: SparseMatrix, keys: DataFrame, path: str, precision: int = 3) -> None:
    text_rows(m, precision, keys).orderBy("i").select("value").write.mode("overwrite").text(path)


def write_names(names: DataFrame, path: str) -> None:
    names.orderBy("id").select("name").write.mode("overwrite").text(path)


def write_dense(dense: DataFrame, n_cols: int, path: str) -> None:
    spark = dense.sparkSession
    rows = dense.select("i", F.concat_ws(" ", F.col("values").cast("array<string>")).alias("value"))
    rows.unionByName(spark.createDataFrame([(-1, f"{dense.count()} {n_cols}")], "i long, value string")).orderBy("i").select("value").write.mode("overwrite").text(path)


def write_parquet(m: SparseMatrix, path: str) -> None:
    m.df.write.mode("overwrite").parquet(f"{path}/entries")
    m.df.sparkSession.createDataFrame([(m.n_rows, m.n_cols)], "n_rows long, n_cols long").write.mode("overwrite").parquet(f"{path}/shape")


def _blobs(df: DataFrame, kinds: dict[str, str]):
    """A frame's columns in its order, batch by batch, as arrays of the given kinds: what reaches the driver is packed bytes."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(c).astype(k).tobytes()], pa.binary()) for c, k in zip(b.columns, kinds.values(), strict=True)], names=list(kinds))

    packed = df.select(*kinds).mapInArrow(run, ", ".join(f"{c} binary" for c in kinds))
    for r in packed.toLocalIterator(prefetchPartitions=True):
        yield [np.frombuffer(r[c], k) for c, k in kinds.items()]


def write_binary(m: SparseMatrix, path: str, planar: bool = False, size_prefix: bool = True) -> None:
    """One file for other programs, as the layout asks for: executors sort and pack, the driver appends their packed batches."""
    spark = m.df.sparkSession
    with Scratch(spark) as scratch, _output(path) as f:
        entries = scratch.stored(m.df, "entries")
        f.write(np.array([m.n_rows, m.n_cols], "<i4").tobytes() + (np.array([m.n_rows], "<i8").tobytes() if size_prefix else b""))
        at = 0
        for i, n in _blobs(entries.groupBy("i").agg(F.count("*").alias("n")).orderBy("i"), {"i": "<i8", "n": "<i4"}):
            while len(i):  # a batch may be far apart from the one before; zeros are written in steps as well
                until = min(int(i[-1]) + 1, at + _STEP)
                sizes, here = np.zeros(until - at, "<i4"), i < until
                sizes[i[here] - at] = n[here]
                f.write(sizes.tobytes())
                i, n, at = i[~here], n[~here], until
        for first in range(at, m.n_rows, _STEP):
            f.write(bytes(4 * min(_STEP, m.n_rows - first)))
        ordered = entries.orderBy("i", "j")
        if planar:
            for column, kind in (("j", "<i4"), ("v", "<f4")):
                for (x,) in _blobs(ordered, {column: kind}):
                    f.write(x.tobytes())
        else:
            for j, v in _blobs(ordered, {"j": "<i4", "v": "<f4"}):
                pairs = np.empty(len(j), [("j", "<i4"), ("v", "<f4")])
                pairs["j"], pairs["v"] = j, v
                f.write(pairs.tobytes())


def write_weights(weights: DataFrame, path: str) -> None:
    """(id, v) in order of id: an int64 count, then float32 values."""
    with _output(path) as f:
        f.write(np.array([weights.count()], "<i8").tobytes())
        for (v,) in _blobs(weights.orderBy("id"), {"v": "<f4"}):
            f.write(v.tobytes())


def write_matrix(m: SparseMatrix, path: str) -> None:
    """By suffix, as `read_matrix` reads: .bin, .pybin (planar), .parquet, otherwise text."""
    if path.endswith((".bin", ".pybin")):
        write_binary(m, path, planar=path.endswith(".pybin"))
    elif path.endswith(".parquet"):
        write_parquet(m, path)
    else:
        write_text(m, path)


def report(m: SparseMatrix, entities: DataFrame, features: DataFrame, order: str = "desc") -> DataFrame:
    """(i, entity, rank, j, feature, v): entries with both names, by value ("desc", "asc") or as stored ("index")."""
    by = {"desc": [F.col("v").desc(), F.col("j")], "asc": [F.col("v"), F.col("j")], "index": [F.col("j")]}[order]
    n = tasks(m.df, entities)  # entries and names of an entity meet in tasks of a size of their own, where they are ranked
    names = entities.select(F.col("id").alias("i"), F.col("name").alias("entity")).repartition(n, "i")
    named = m.df.join(features.select(F.col("id").alias("j"), F.col("name").alias("feature")), "j").repartition(n, "i").join(names, "i")
    return named.select("i", "entity", F.row_number().over(Window.partitionBy("i").orderBy(*by)).alias("rank"), "j", "feature", "v")
