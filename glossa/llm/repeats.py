"""Suffix-array removal of long strings that occur more than once.

Equal strings of ``length`` bytes have the same least hash over their inner
``K``-byte strings. Start positions are therefore dealt by that hash: a run of
neighbouring starts with one hash is one row (a start costs about 1/65 row).
A hash seen once, in one run and place, is no repeat. Of those seen more often, runs that are equal as
a whole are repeats; the different runs of one hash are sorted as suffixes by
grouping (``suffixes``), those of many hashes side by side, and neighbours in
that order that share ``length`` bytes are repeats. So suffix arrays are built
over just the text that may hold repeats, in many tasks, each over a bounded
buffer.

A hash with very many different runs (a common passage in unlike surroundings)
would be one large buffer. It is dealt once more by hashes of all ``length`` bytes
(128 bits, counted before they are joined), so that no task holds it whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm import scan
from glossa.llm.store import discard, doc_id_back, keep, keyed
from glossa.llm.suffixes import suffix_array, suffix_arrays

LENGTH = 200
K = 72
#: Bytes of runs that are sorted at once, each hash by itself; different runs of a hash beyond which it is dealt anew.
BUFFER, CROWD = 1 << 19, 512
#: Suffixes that are sorted one by one in the time that a step of texts side by side takes at least.
SIDE = 20
#: Starts whose bytes are compared at once; bytes of texts that are scanned at once (small enough for a processor cache).
COMPARED, SCANNED = 4096, 1 << 18


def string_hashes(data: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The hash of the k bytes from each position on, where they fit."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    sums = scan.prefix(data, seed)
    n = len(data) - k + 1
    return scan.mix((sums[k:] - sums[:n]) * scan.powers(len(sums))[1][:n])


def start_runs(length: int, k: int):
    """Rows (m, seg, did, th, pos): starts that share the least hash m; seg is a hash of all their bytes; pos packs what ``scan.pack`` takes."""

    def pieces(offs: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, int]]:
        if len(offs) > 2 or offs[-1] <= scan.PIECE + length:
            yield offs, 0, 0, int(offs[-1])
        else:
            for a in range(0, int(offs[-1]) - length + 1, scan.PIECE):
                b = min(a + scan.PIECE + length - 1, int(offs[-1]))
                yield np.array([0, b - a]), a, a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, all_offs, all_data in scan.chunks(batch, 2, SCANNED):
                for offs, base, lo, hi in pieces(all_offs):
                    data = all_data[lo:hi]
                    hashes, w = string_hashes(data, k, 7), length - k + 1
                    mins = scan.window_min(hashes, w)
                    if not len(mins):
                        continue
                    own = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(mins)]
                    ok = np.arange(len(mins)) <= offs[own + 1] - length
                    where = np.flatnonzero(ok)
                    at, n = scan.runs(mins[where], own[where], scan.LONGEST)
                    start = where[at]
                    twice = np.isin(mins[start], scan.least_twice(hashes, mins, w, length))
                    raw = memoryview(np.ascontiguousarray(data))
                    seg = np.fromiter((xxhash.xxh3_64_intdigest(raw[s : s + c + length - 1]) for s, c in zip(start.tolist(), n.tolist(), strict=True)), np.uint64, len(start))
                    rows = pa.array(a + own[start])
                    yield pa.RecordBatch.from_arrays(
                        [scan.signed(mins[start]), scan.signed(seg), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(scan.pack(start - offs[own[start]] + base, n, twice))],
                        ["m", "seg", "did", "th", "pos"],
                    )

    return run


def contents(length: int):
    """Rows (m, seg, did, th, start, n, bytes) from documents with a list of runs each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                did, th, text, wanted = (batch.column(c)[i].as_py() for c in range(4))
                raw = text.encode()
                for at in range(0, len(wanted), 4096):
                    some = wanted[at : at + 4096]
                    yield pa.RecordBatch.from_pydict(
                        {"m": [w["m"] for w in some], "seg": [w["seg"] for w in some], "did": [did] * len(some), "th": pa.array([th] * len(some), pa.int64()), "start": [w["start"] for w in some], "n": pa.array([w["n"] for w in some], pa.int32()), "bytes": pa.array([raw[w["start"] : w["start"] + w["n"] + length - 1] for w in some], pa.binary())}
                    )

    return run


def suffix_orders(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Suffixes of each text ``data[offs[i] : offs[i + 1]]`` in ascending order, one text after the other, as positions in ``data``.

    Texts go side by side but for the longest ones, which would go on when the others have ended.
    """
    lengths = np.diff(offs)
    falling = np.argsort(-lengths, kind="stable")
    each = lengths[falling]
    alone = int(np.argmin(np.concatenate([[0], np.cumsum(each)]) + SIDE * np.append(each, 0)))
    order = np.empty(len(data), np.int64)
    for i in falling[:alone].tolist():
        order[offs[i] : offs[i + 1]] = np.array(suffix_array(data[offs[i] : offs[i + 1]]), np.int64) + offs[i]
    if alone < len(lengths):
        rest = np.ones(len(lengths), bool)
        rest[falling[:alone]] = False
        where = np.flatnonzero(np.repeat(rest, lengths))
        order[where] = where[suffix_arrays(data[where], np.concatenate([[0], np.cumsum(lengths[rest])]))]
    return order


def same_as_next(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from each start but the last equal those from the next one."""
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    same = np.empty(max(len(starts) - 1, 0), bool)
    for i in range(0, len(same), COMPARED):
        some = windows[starts[i : i + COMPARED + 1]]
        same[i : i + COMPARED] = (some[1:] == some[:-1]).all(1)
    return same


def repeated_starts(pieces: list[bytes], keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, first start and number of starts of the runs in ``pieces`` whose ``length`` bytes start elsewhere in pieces of one key too; equal keys are neighbours."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(pieces)), sizes)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    order = suffix_orders(data, np.append((ends - sizes)[first], len(data)))
    order = order[order + length <= ends[own[order]]]
    same = same_as_next(data, order, length) & (keys[own[order[1:]]] == keys[own[order[:-1]]]) if len(order) else np.zeros(0, bool)
    hit = np.zeros(len(data), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    where = np.flatnonzero(hit)
    new = np.ones(len(where), bool)
    new[1:] = (np.diff(where) > 1) | (own[where[1:]] != own[where[:-1]])
    at = np.flatnonzero(new)
    piece = own[where[at]]
    return piece, where[at] - (ends - sizes)[piece], np.diff(np.append(at, len(where)))


def sorted_groups(length: int):
    """Reads rows (m, did, th, start, bytes) that are sorted by m; gives (did, th, start, n) of repeated starts."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        m, did, th, start = (np.array([r[c] for r in rows], np.int64) for c in range(4))
        piece, first, n = repeated_starts([r[4] for r in rows], m, length)
        return pa.RecordBatch.from_arrays([pa.array(did[piece]), pa.array(th[piece]), pa.array(start[piece] + first), pa.array(n.astype(np.int32))], ["did", "th", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if size >= BUFFER and held[-1][0] != row[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    return run


def single_starts(length: int):
    """The starts of a run by what they hold: (m, x, did, th, starts), m and x hashes of ``length`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                did, th, start, raw = (batch.column(c)[i].as_py() for c in (2, 3, 4, 6))
                h = string_hashes(np.frombuffer(raw, np.uint8), length, 11)
                m, first, n = np.unique(h, return_index=True, return_counts=True)
                places = np.argsort(h, kind="stable") + start
                cuts = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                x = np.array([xxhash.xxh3_64_intdigest(raw[j : j + length]) for j in first.tolist()], np.uint64)
                yield pa.RecordBatch.from_arrays([scan.signed(m), scan.signed(x), pa.array([did] * len(m)), pa.array([th] * len(m), pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(places))], ["m", "x", "did", "th", "starts"])

    return run


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their spans (start, end), in any order and overlapping, to what is left of them."""
    for batch in batches:
        out: dict[str, list] = {"did": [], "n_bytes": [], "n_removed": [], "spans": [], "kept": []}
        for i in range(batch.num_rows):
            did, text, spans = batch.column(0)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
            raw, merged = text.encode(), []
            for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            left, at = [], 0
            for a, b in merged:
                left.append(raw[at:a])
                at = b
            left.append(raw[at:])
            out["did"].append(did)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(sum(b - a for a, b in merged))
            out["spans"].append([{"start": a, "end": b} for a, b in merged])
            out["kept"].append(b"".join(left))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema({"did": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})), "kept": pa.binary()}))


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(did, th, start, end) of byte spans that strings of ``length`` bytes cover which start anywhere else too; spans may overlap."""
    d = keyed(docs)
    by_m, by_seg = Window.partitionBy("m"), Window.partitionBy("m", "seg")
    rows = d.mapInArrow(start_runs(length, k), "m long, seg long, did long, th long, pos long")
    seen = rows.select("*", F.count("*").over(by_m).alias("of_m"), (F.min("seg").over(by_m) != F.max("seg").over(by_m)).alias("unlike"))
    start, n, twice = scan.unpack("pos")
    shared = seen.where((F.col("of_m") > 1) | twice).select("m", "seg", "did", "th", start.alias("start"), n.alias("n"), (F.col("unlike") | twice).alias("mixed"), F.count("*").over(by_seg).alias("of_seg"))
    shared = keep(shared, "shared-runs")
    whole = shared.where("of_seg > 1").select("did", "th", "start", "n")
    first = shared.where("mixed").groupBy("m", "seg").agg(F.min(F.struct("did", "th", "start", "n")).alias("r"))
    per_doc = first.groupBy("r.did", "r.th").agg(F.collect_list(F.struct("m", "seg", F.col("r.start").alias("start"), F.col("r.n").alias("n"))).alias("wanted"))
    once = d.join(per_doc, ["did", "th"]).dropDuplicates(["did", "th"])
    unlike = keep(once.select("did", "th", "text", "wanted").mapInArrow(contents(length), "m long, seg long, did long, th long, start long, n int, bytes binary"), "unlike-runs")
    crowd = unlike.groupBy("m").agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select("m")
    few = unlike.join(crowd, "m", "left_anti").select("m", "did", "th", "start", "bytes")
    many = unlike.join(crowd, "m", "left_semi").mapInArrow(single_starts(length), "m long, x long, did long, th long, starts array<long>")
    again = many.groupBy("m", "x").agg(F.sum(F.size("starts")).alias("c")).where("c > 1").select("m", "x")
    again = many.join(again, ["m", "x"]).select("did", "th", F.explode("starts").alias("start"), F.lit(1).alias("n"))
    sort = few.repartition("m").sortWithinPartitions("m").mapInArrow(sorted_groups(length), "did long, th long, start long, n int")
    found = whole.unionByName(sort).unionByName(again)
    spans = keep(found.select("did", "th", "start", (F.col("start") + F.col("n") + F.lit(length - 1)).alias("end")), "spans")
    discard(shared, unlike)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, spans (removed runs, merged), kept (bytes).

    Every byte goes that is covered by a string of ``length`` bytes which also
    starts anywhere else, in the same text (overlaps count) or another one, as
    the input stands: no copy stays. Strings do not cross texts. Null text:
    empty. Rows may share a doc_id; rows equal in doc_id and text are copies of
    each other. Texts below ``length`` bytes stay as they are. Empty table: no
    rows. Other columns are ignored.
    """
    spans = repeated_spans(docs, length, k)
    lists = spans.distinct().groupBy("did", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = keyed(docs).join(lists, ["did", "th"], "left").select("did", "th", "text", "spans")
    out = joined.mapInArrow(cut_out, "did long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
    return out.select(doc_id_back().alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
