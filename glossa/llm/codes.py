"""Token ids in directly addressable codes (DACs), as binary files of segments.

A segment holds the ids of neighbouring documents. Ids are cut into 8-bit
chunks, least first. Level l holds chunk l of every id that has one, and a
bitmap with a bit for each of them: 1 if the id goes on. A rank directory holds
the number of ones before every 512th bit, so the place of an id in the next
level is one directory entry and at most 8 words of bits away: any id is read
without decoding others.

Layout of a segment (little-endian): magic ``DAC1``; uint32 levels, documents;
uint64 ids; documents x int64 doc_id; (documents + 1) x uint64 first id; then
for each level uint64 n, n chunk bytes, ceil(n / 64) x uint64 bits,
(ceil(n / 512) + 1) x uint32 ranks.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm import scan
from glossa.llm.store import NO_ID, keep, keyed

MAGIC = b"DAC1"
SEGMENT = 1 << 18
#: Distinct words whose ids a worker remembers.
REMEMBER = 1 << 22
#: What keeps a word from standing in a text with others: letters that normalisation may move, special tokens.
OTHER = re.compile(r"[^\x00-\xff]|<\|")
_coders: dict[tuple[str, int], WordEncoder] = {}


def encode(ids: np.ndarray, doc_ids: np.ndarray, firsts: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        n = len(rest)
        padded = np.zeros(-(-n // 64) * 64, np.uint8)
        padded[:n] = more
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(more)])[: n + 1]
        ranks = ones[np.minimum(np.arange(-(-n // 512) + 1) * 512, n)].astype(np.uint32)
        levels.append(struct.pack("<Q", n) + (rest & 255).astype(np.uint8).tobytes() + words.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = MAGIC + struct.pack("<IIQ", len(levels), len(doc_ids), len(ids))
    return head + doc_ids.astype("<i8").tobytes() + firsts.astype("<u8").tobytes() + b"".join(levels)


class Segment:
    """Reads ids of an encoded segment by their place."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        n_levels, n_docs, self.n = struct.unpack_from("<IIQ", raw, 4)
        at = 20
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
        at += 8 * n_docs
        self.firsts = np.frombuffer(raw, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            chunk = np.frombuffer(raw, np.uint8, n, at + 8)
            at += 8 + n
            bits = np.frombuffer(raw, np.uint8, -(-n // 64) * 8, at)
            at += len(bits)
            ranks = np.frombuffer(raw, "<u4", -(-n // 512) + 1, at)
            at += 4 * len(ranks)
            self.levels.append((chunk, bits, ranks))

    def token(self, i: int) -> int:
        value = 0
        for shift, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * shift)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i >> 9
            before = int.from_bytes(bits[block * 64 : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - block * 512)) - 1)
            i = int(ranks[block]) + before.bit_count()
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1: on every level one stretch, which begins where the rank of its first id says."""
        out, where = np.zeros(b - a, np.uint32), np.arange(b - a)
        for shift, (chunk, bits, ranks) in enumerate(self.levels):
            out[where] |= chunk[a:b].astype(np.uint32) << np.uint32(8 * shift)
            first = a >> 9 << 9
            flags = np.unpackbits(bits[first >> 3 : -(-b // 8)], bitorder="little")[: b - first].astype(bool)
            start = int(ranks[first >> 9]) + int(flags[: a - first].sum())
            where = where[flags[a - first :]]
            a, b = start, start + len(where)
            if a == b:
                break
        return out


class WordEncoder:
    """Encodes texts with a tokenizer of which no token spans white space, so each distinct word is encoded once and remembered."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end_id
        self.clear()

    def clear(self) -> None:
        """Words are remembered by their 64-bit hash: sorted ``keys``, each with the place and number of its ids in ``pool``."""
        self.keys = np.zeros(0, np.uint64)
        self.begins, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Latin-1 words stand in one text with a blank between them, and offsets tell whose an id is; others are encoded each."""
        begins, lengths = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        plain, others = [], []
        for k, raw in enumerate(words):
            word = raw.decode()
            (plain if OTHER.search(word) is None else others).append((k, word))
        for some in [plain[at : at + 500] for at in range(0, len(plain), 500)] + [[x] for x in others]:
            e = self.tokenizer.encode(" ".join(w for _, w in some), add_special_tokens=False)
            if len(some) > 1:
                ends = np.cumsum([len(w) + 1 for _, w in some])
                n = np.bincount(np.searchsorted(ends, np.array([o[0] for o in e.offsets], np.int64), "right"), minlength=len(some))
            else:
                n = np.array([len(e.ids)])
            if self.used + len(e.ids) > len(self.pool):
                self.pool = np.append(self.pool, np.zeros(len(self.pool) + len(e.ids), np.uint32))
            self.pool[self.used : self.used + len(e.ids)] = e.ids
            at = [k for k, _ in some]
            begins[at], lengths[at] = self.used + np.cumsum(n) - n, n
            self.used += len(e.ids)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.begins, self.lengths = np.insert(self.keys, place, keys), np.insert(self.begins, place, begins), np.insert(self.lengths, place, lengths)

    def texts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and the number of ids of each."""
        if len(self.keys) > REMEMBER:
            self.clear()
        starts, ends, h, own = scan.words(data, offs)
        names, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, names)
        new = np.ones(len(names), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] != names
        if new.any():
            raw = data.tobytes()
            self.learn(names[new], [raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, names)
        code = at[which]
        n = self.lengths[code].astype(np.int64)
        m = len(offs) - 1
        sizes = np.bincount(own, weights=n, minlength=m).astype(np.int64) + 1
        total = int(n.sum())
        ids = self.pool[np.repeat(self.begins[code] - (np.cumsum(n) - n), n) + np.arange(total)] if total else np.zeros(0, np.uint32)
        out = np.full(total + m, self.end, np.uint32)
        out[np.arange(total) + np.repeat(np.arange(m), sizes - 1)] = ids
        return out, sizes


def coder_of(path: str, end_id: int) -> WordEncoder:
    """One encoder for each worker process, so that its tasks share what it remembers."""
    if (path, end_id) not in _coders:
        _coders[path, end_id] = WordEncoder(path, end_id)
    return _coders[path, end_id]


def segments(path: Callable[[], str], end_id: int):
    """(did, th, text), sorted, to (part, seq, n_docs, n_ids, segment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = coder_of(path(), end_id), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal held, seq
            ids, sizes, names = (np.concatenate([h[k] for h in held]) for k in range(3))
            blob = encode(ids, names, np.concatenate([[0], np.cumsum(sizes)]))
            held, seq = [], seq + 1
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([len(sizes)]), pa.array([len(ids)]), pa.array([blob], pa.binary())], ["part", "seq", "n_docs", "n_ids", "segment"])

        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, offs, data in scan.chunks(batch, 2):
                held.append((*coder.texts(data, offs), names[a:b]))
                if sum(len(h[0]) for h in held) >= SEGMENT:
                    yield flush()
        if held:
            yield flush()

    return run


def write_codes(docs: DataFrame, path: Callable[[], str], end_id: int = 1, to: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) as segments in ascending doc_id order; the table (part, seq, n_docs, n_ids, segment) as written.

    Null text: the end id only. Null doc_id: first. Rows that share a doc_id
    follow each other by text hash. Empty table: no segments. ``path`` gives
    the tokenizer file's place on the machine that runs a task. The table goes
    to the folder ``to`` (which must not exist), or to one of its own among the
    intermediate tables; segments aren't compressed in it, so they can be
    addressed there.
    """
    ordered = keyed(docs).repartitionByRange("did", "th").sortWithinPartitions("did", "th")
    return keep(ordered.mapInArrow(segments(path, end_id), "part long, seq long, n_docs long, n_ids long, segment binary"), "codes", row_group=16 << 20, compression="uncompressed", to=to)


def read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, segment) to (did, start, n_tokens, ids_crc32), ids read from the segment."""
    for batch in batches:
        for first, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = Segment(raw.as_buffer().to_pybytes())
            bounds = s.firsts.tolist()
            crc = [zlib.crc32(s.slice(a, b).astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids.astype(np.int64)), pa.array(s.firsts[:-1] + first), pa.array(np.diff(s.firsts)), pa.array(crc, pa.int64())], ["did", "start", "n_tokens", "ids_crc32"])


def located(table: DataFrame) -> DataFrame:
    """The segments with ``first``, the number of ids before each; one row per part is summed in one task."""
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = table.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("own")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("own")).alias("first"))
    return table.join(places, ["part", "seq"])


def read_codes(table: DataFrame) -> DataFrame:
    """One row per document of the segments in ``table``: doc_id, start, n_tokens, ids_crc32."""
    rows = located(table).select("first", "segment").mapInArrow(read_documents, "did long, start long, n_tokens long, ids_crc32 long")
    return rows.select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def read_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, positions, segment) to (position, token): each id by its own codes, none of the others."""
    for batch in batches:
        for first, positions, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            s = Segment(raw.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(positions, pa.int64()), pa.array([s.token(p - first) for p in positions], pa.int64())], ["position", "token"])


def tokens_at(table: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, token) for the distinct values of ``position`` in ``positions``: the places of ids among all ids of ``table``, from 0.

    Null, negative and too large positions give no row. Segments without a
    wanted id are not read by Python; positions meet the segments in bins of
    ``SEGMENT`` ids, and a segment takes at most as many as it has ids.
    """
    places = located(table.select("part", "seq", "n_ids")).where("n_ids > 0")
    bins = F.sequence(F.col("first").bitwiseAND(F.lit(-SEGMENT)), F.col("first") + F.col("n_ids") - 1, F.lit(SEGMENT).cast("long"))
    places = places.select("part", "seq", "first", "n_ids", F.explode(bins).alias("bin"))
    wanted = positions.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct()
    wanted = wanted.withColumn("bin", F.col("position").bitwiseAND(F.lit(-SEGMENT)))
    met = wanted.join(places, "bin").where("position >= first and position < first + n_ids")
    lists = met.groupBy("part", "seq", "first").agg(F.collect_list("position").alias("positions"))
    return table.join(lists, ["part", "seq"]).select("first", "positions", "segment").mapInArrow(read_tokens, "position long, token long")
