"""Large files read in byte ranges: JSON arrays, npy and npz matrices, numbered lines.

Each range is a row of a small table, so Spark deals ranges over tasks and a
lost task reads its range again. A file is never one value. Files are opened by
Arrow's file systems (local, HDFS, object stores), lines by Spark's own reader.
"""

from __future__ import annotations

import ast
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.session import written

#: Bytes of a range; bytes that are looked at together; ranges whose first line numbers go to every task.
RANGE, PIECE, MOST_RANGES = 64 << 20, 1 << 20, 1_000_000


def opened(path: str) -> pa.NativeFile:
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(at)


def file_ranges(spark: SparkSession, path: str, pattern: str, size: int) -> DataFrame:
    """(path, start, stop): the ranges of all files below ``path`` (or of the file ``path``), as Spark lists them; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("bytes"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("long")))
    return files.select("path", "bytes", starts.alias("start")).withColumn("stop", F.least(F.col("start") + size, F.col("bytes")))


# JSON arrays: where a range begins, the text may be inside a string or not; both are tried, and what holds follows from the ranges before


def marks(data: np.ndarray, escaped: bool, inside: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Depth behind each byte (relative) and whether it lies outside strings, then whether the end is inside one and escaped.

    ``escaped``: a backslash before ``data`` escapes its first byte.
    """
    at = np.arange(len(data))
    back = data == 0x5C
    last = np.maximum.accumulate(np.where(back, -1, at)) if len(data) else at
    run = np.concatenate([[0], at - last])[: len(data)]  # backslashes right before each byte
    # those that begin the data are one more if what stands before is escaping
    run = run + (escaped & (np.concatenate([[-1], last])[: len(data)] < 0))
    quote = (data == 0x22) & (run % 2 == 0)
    within = (np.cumsum(quote) + inside) % 2 == 1
    outside = ~within & ~quote
    step = np.where(outside, np.isin(data, (0x5B, 0x7B)).astype(np.int64) - np.isin(data, (0x5D, 0x7D)), 0)
    end_run = len(data) - 1 - int(last[-1]) + (escaped and int(last[-1]) < 0) if len(data) else int(escaped)
    return np.cumsum(step), outside, bool(within[-1]) if len(data) else inside, end_run % 2 == 1


def escapes_next(file: pa.NativeFile, at: int) -> bool:
    """Whether an odd number of backslashes ends at ``at``."""
    n = 0
    while n < at:
        size = min(PIECE, at - n)
        file.seek(at - n - size)
        raw = file.read(size)
        more = len(raw) - len(raw.rstrip(b"\\"))
        n += more
        if more < size:
            break
    return n % 2 == 1


def scan_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each range and both ways it may begin: whether it ends inside a string, its change of depth, and the commas outside strings by relative depth."""
    for pdf in batches:
        for path, start, stop in zip(pdf["path"], pdf["start"], pdf["stop"], strict=True):
            with opened(path) as file:
                first = escapes_next(file, start)
                for inside in (False, True):
                    within, escaped, depth, commas, at = inside, first and inside, 0, {}, start
                    file.seek(start)
                    while at < stop:
                        data = np.frombuffer(file.read(min(PIECE, stop - at)), np.uint8)
                        deep, outside, within, escaped = marks(data, escaped, within)
                        for d, n in zip(*np.unique(depth + deep[outside & (data == 0x2C)], return_counts=True), strict=True):
                            commas[int(d)] = commas.get(int(d), 0) + int(n)
                        depth += int(deep[-1])
                        at += len(data)
                    yield pd.DataFrame({"path": [path], "start": [start], "inside": [inside], "ends_inside": [within], "change": [depth], "commas": [[{"depth": d, "n": n} for d, n in sorted(commas.items())]]})


def elements_from(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, start, stop, inside, depth, seen) to (path, pos, raw): the elements of the outer array that begin in a range; the last is read on beyond it."""
    for pdf in batches:
        for path, start, stop, within, depth, seen in pdf.itertuples(index=False):
            with opened(path) as file:
                escaped = escapes_next(file, start) and within
                file.seek(start)
                at, held, pos, done = start, [], seen, False
                begun = False  # what stands before the first cut belongs to the range before
                while not done:
                    raw = file.read(PIECE)
                    if not raw:
                        break
                    data = np.frombuffer(raw, np.uint8)
                    deep, outside, within, escaped = marks(data, escaped, within)
                    deep = deep + depth
                    depth = int(deep[-1])
                    cuts = np.flatnonzero(outside & (((data == 0x2C) & (deep == 1)) | ((data == 0x5B) & (deep == 1)) | ((data == 0x5D) & (deep == 0))))
                    out, from_ = [], 0
                    for c in cuts.tolist():
                        if begun:
                            held.append(raw[from_:c])
                            out.append((pos - 1, b"".join(held).strip()))
                        held, from_ = [], c + 1
                        begun = True
                        if data[c] == 0x5D or at + c >= stop:
                            done = True
                            break
                        pos += 1
                    if not done and begun:
                        held.append(raw[from_:])
                    at += len(raw)
                    out = [(p, x) for p, x in out if x]
                    if out:
                        yield pd.DataFrame({"path": path, "pos": [p for p, _ in out], "raw": [x.decode() for _, x in out]})


def read_json_arrays(spark: SparkSession, path: str, size: int | None = None, pattern: str = "*") -> DataFrame:
    """(file, pos, raw): the elements of the JSON array that each file holds, as they are written, with their places.

    Files are read in ranges of ``size`` bytes. A first job notes how each
    range would end; the driver, with a few numbers for each range, follows how
    each begins; a second job reads the elements. Elements may be of any kind
    and length, strings may hold brackets, quotes and line ends.
    """
    ranges = written(file_ranges(spark, path, pattern, size or RANGE).select("path", "start", "stop"))
    scanned = ranges.repartition("path", "start").mapInPandas(scan_ranges, "path string, start long, inside boolean, ends_inside boolean, change long, commas array<struct<depth: int, n: long>>").collect()  # two rows for each range
    by = {(r.path, r.start, r.inside): r for r in scanned}
    begins, state, before = [], (False, 0, 0), None
    for at, start in sorted({(r.path, r.start) for r in scanned}):
        inside, depth, seen = state if at == before else (False, 0, 0)
        begins.append((at, start, inside, depth, seen))
        r = by[at, start, inside]
        opens = depth == 0 and r.change + depth > 0
        seen += sum(c.n for c in r.commas if c.depth + depth == 1) + bool(opens)
        state, before = (r.ends_inside, depth + r.change, seen), at
    known = spark.createDataFrame(begins, "path string, start long, inside boolean, depth long, seen long")
    out = ranges.join(known, ["path", "start"]).select("path", "start", "stop", "inside", "depth", "seen").repartition("path", "start").mapInPandas(elements_from, "path string, pos long, raw string")
    return out.select(F.element_at(F.split("path", "/"), -1).alias("file"), "pos", "raw")


# Matrices


def header(file: pa.NativeFile, offset: int) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    """Type, whether columns come first, shape, and where the numbers begin, of the npy data at ``offset``."""
    file.seek(offset)
    magic = file.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not an npy file")
    width = 2 if magic[6] == 1 else 4
    n = int.from_bytes(file.read(width), "little")
    d = ast.literal_eval(file.read(n).decode("latin-1" if magic[6] < 3 else "utf-8").strip())
    return np.dtype(d["descr"]), d["fortran_order"], d["shape"], offset + 8 + width + n


def plan_matrix(size: int):
    """(path) to ranges of rows (path, offset, first, n): of the sole array of an npy or npz file; offset -1: packed, to be read from its beginning."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                with opened(path) as file:
                    offset, packed = 0, False
                    if file.read(2) == b"PK":
                        with zipfile.ZipFile(file) as z:
                            entry = z.infolist()[0]
                            packed = entry.compress_type != zipfile.ZIP_STORED
                            file.seek(entry.header_offset + 26)
                            offset = entry.header_offset + 30 + int.from_bytes(file.read(2), "little") + int.from_bytes(file.read(2), "little")
                    if packed:
                        yield pd.DataFrame({"path": [path], "offset": [-1], "first": [0], "n": [-1]})
                        continue
                    kind, columns, shape, _ = header(file, offset)
                    rows, width = shape[0] if shape else 0, kind.itemsize * int(np.prod(shape[1:]))
                    step = rows if columns and len(shape) > 1 else max(1, size // max(width, 1))
                    for first in range(0, rows, max(step, 1)):
                        yield pd.DataFrame({"path": [path], "offset": [offset], "first": [first], "n": [min(step, rows - first)]})

    return run


def matrix_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, offset, first, n) to (path, row, features), about ``PIECE`` bytes at a time."""
    for pdf in batches:
        for path, offset, first, n in pdf.itertuples(index=False):
            with opened(path) as file:
                if offset < 0:
                    with zipfile.ZipFile(file) as z, z.open(z.infolist()[0]) as packed:
                        yield from numbers(path, packed, *unpack(packed), 0)
                    continue
                kind, columns, shape, at = header(file, offset)
                width = kind.itemsize * int(np.prod(shape[1:]))
                file.seek(at + (0 if columns and len(shape) > 1 else first * width))
                yield from numbers(path, file, kind, columns, (n, *shape[1:]), first)


def unpack(packed) -> tuple[np.dtype, bool, tuple[int, ...]]:
    version = np.lib.format.read_magic(packed)
    shape, columns, kind = np.lib.format.read_array_header_1_0(packed) if version == (1, 0) else np.lib.format.read_array_header_2_0(packed)
    return kind, columns, shape


def numbers(path: str, file, kind: np.dtype, columns: bool, shape: tuple[int, ...], first: int) -> Iterator[pd.DataFrame]:
    rows, cells = shape[0], int(np.prod(shape[1:]))
    if columns and len(shape) > 1:  # columns come first, so a row needs them all
        whole = np.frombuffer(file.read(rows * cells * kind.itemsize), kind).reshape(shape, order="F").reshape(rows, -1)
        parts = ((i, whole[i : i + 8192]) for i in range(0, rows, 8192))
    else:
        step = max(1, PIECE // max(1, cells * kind.itemsize))
        parts = ((i, np.frombuffer(file.read(min(step, rows - i) * cells * kind.itemsize), kind).reshape(-1, max(cells, 1) if cells else 0)) for i in range(0, rows, step))
    for i, part in parts:
        yield pd.DataFrame({"path": path, "row": range(first + i, first + i + len(part)), "features": list(part.astype(float))})


def read_matrices(spark: SparkSession, path: str, pattern: str = "*", size: int | None = None) -> DataFrame:
    """(path, row, features) of the sole array of each npy or npz file at ``path``, read in ranges of about ``size`` bytes.

    A packed npz file and an array whose columns come first are read by one task.
    """
    files = file_ranges(spark, path, pattern, 1 << 62).select("path")
    plan = written(files.mapInPandas(plan_matrix(size or RANGE), "path string, offset long, first long, n long"))
    return plan.repartition("path", "first").mapInPandas(matrix_rows, "path string, row long, features array<double>")


# Lines


def numbered_lines(spark: SparkSession, paths: str | list[str], pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, line_no, text): lines with their numbers in the file, from 0, an end of line at the end of a file beginning no other.

    Spark's reader splits files; a line's number is its place in its split and
    the number of lines in the splits before, one row each.
    """
    reader = spark.read.option("lineSep", "\n")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    lines = written(reader.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text")))
    splits = lines.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = splits.select("path", "start", (before - F.col("first")).alias("shift"))
    if placed.count() <= MOST_RANGES:
        placed = F.broadcast(placed)
    return lines.join(placed, ["path", "start"]).select("path", (F.col("id") + F.col("shift")).alias("line_no"), "text")
