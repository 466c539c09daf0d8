"""Resampling of documents towards a target's distribution of hashed word features.

Every feature falls into a bucket; a bucket's gain is the log ratio of its
smoothed shares in the target and in all documents. A document's weight is the
sum of the gains of its features, read from one array. With Gumbel noise from a
hash of the id added, the highest scores are a draw without replacement in
proportion to exp(weight).

Drawing sorts in two steps. Each task sorts its eligible rows into runs, which
are stored as blocks of packed columns, cut at quantiles of all scores into
bands. A band's blocks of all runs then meet in one task, which merges them by
a tournament tree. Bands are counted before, so each knows its first rank, the
band that holds the last draw stops there, and bands below are not merged.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import scan
from glossa.llm.store import NO_ID, keep

#: Bytes of words: digits, small letters (large ones are folded before), and all of characters beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of a feature beyond which its checksum is taken by itself.
LONG = 64
#: Rows of a run; least rows of a band; most bands.
RUN, BAND, BANDS = 1 << 20, 1 << 12, 1 << 16
#: Thousandths of the logarithm in gains, weights and scores.
SCALE = 1000

COLUMNS = ("score", "id", "has_id", "n_words", "n_features", "weight")
BLOCKS = pa.schema([("band", pa.int64()), ("run", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in COLUMNS)])
BLOCKS_SQL = "band long, run long, n long, " + ", ".join(f"{c} binary" for c in COLUMNS)
RANKED = "doc_id long, n_words long, n_features long, weight long, score long, rank long"


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = crc_table()


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every span: a byte of all spans at a time, the longest spans first."""
    n = ends - starts
    order = np.argsort(-n, kind="stable")
    s, n = starts[order], n[order]
    crc = np.full(len(s), 0xFFFFFFFF, np.uint32)
    first = int(np.searchsorted(-n, -LONG))  # longer than LONG before
    for k in range(min(LONG, int(n[first]) if first < len(n) else 0)):
        m = int(np.searchsorted(-n, -k))
        crc[first:m] = CRC[(crc[first:m] ^ data[s[first:m] + k]) & 255] ^ (crc[first:m] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(first):
        crc[i] = zlib.crc32(data[s[i] : s[i] + n[i]])
    out = np.empty(len(s), np.uint32)
    out[order] = crc
    return out


def features(data: np.ndarray, offs: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; the bucket and text of every run of up to ``longest`` words."""
    m, data = len(offs) - 1, FOLD[data]
    inside = WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offs[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    stop = np.append(np.flatnonzero(~inside), len(data))
    ends = stop[np.searchsorted(stop, starts)]
    own = np.searchsorted(offs, starts, "right") - 1
    ends = np.minimum(ends, offs[own + 1])
    if longest > 1:  # one blank after each word, so that runs of words are spans
        held = inside.copy()
        held[ends[ends < len(data)]] = True
        place = np.cumsum(held) - 1
        width = ends - starts
        data = np.where(inside, data, 32).astype(np.uint8)[held]
        starts = place[starts]
        ends = starts + width
    got, whose = [], []
    for k in range(longest):
        a = np.flatnonzero(own[: len(own) - k] == own[k:])
        got.append(crc32_spans(data, starts[a], ends[a + k]) % np.uint32(buckets))
        whose.append(own[a])
    return np.bincount(own, minlength=m), np.concatenate(got).astype(np.int64), np.concatenate(whose)


def count_buckets(longest: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(text) to the counts of a task: (bucket, n)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, offs, data in scan.chunks(batch, 0):
                n += np.bincount(features(data, offs, longest, buckets)[1], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    return rows


def bucket_counts(docs: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket: one array of ``buckets`` numbers."""
    parts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(count_buckets(longest, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s_all, t_all, k = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(SCALE * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 2**32)))


def score_texts(gain: np.ndarray, longest: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) to (doc_id, n_words, n_features, weight, score)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offs, data in scan.chunks(batch, 1):
                n_words, bucket, own = features(data, offs, longest, len(gain))
                n, weight = np.bincount(own, minlength=b - a), np.zeros(b - a, np.int64)
                np.add.at(weight, own, gain[bucket])
                ids = batch.column(0)[a:b]
                score = weight + np.array([noise(seed, d) for d in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n), pa.array(weight), pa.array(score)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return rows


class Tournament:
    """A tree of losers over sorted sources: its root is the least of their heads; each taking replays one path."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources, self.k = sources, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.losers = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.wins(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def wins(self, a: int, b: int) -> bool:
        """Whether source a's head comes before source b's; sources that have ended come last, ties go to the earlier source."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        while self.k and (head := self.heads[self.winner]) is not None:
            w = self.winner
            yield w, head
            self.heads[w] = next(self.sources[w], None)
            node = (w + self.k) // 2
            while node:
                if self.wins(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def sorted_runs(cuts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (doc_id, n_words, n_features, weight, score) to blocks of runs, highest scores first, then least ids; a block lies in one band."""

    def blocks(rows: list[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        ids = t.column("doc_id").combine_chunks()
        c = {"score": t.column("score").to_numpy(), "id": ids.fill_null(NO_ID).to_numpy(), "has_id": ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)}
        c |= {k: t.column(k).to_numpy() for k in ("n_words", "n_features", "weight")}
        order = np.lexsort((c["n_features"], c["n_words"], c["id"], -c["score"]))
        band = np.searchsorted(cuts, c["score"][order], "right")
        ends = np.append(np.flatnonzero(np.diff(band)) + 1, len(band))
        for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            yield pa.RecordBatch.from_pylist([{"band": int(band[a]), "run": run, "n": b - a, **{k: v[order[a:b]].astype(np.int64).tobytes() for k, v in c.items()}}], BLOCKS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held = TaskContext.get().partitionId() << 33, []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= RUN:
                yield from blocks(held, run)
                run, held = run + 1, []
        if held:
            yield from blocks(held, run)

    return rows


def unpacked(block: dict) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(block[c], np.int64) for c in COLUMNS}


def ranked(c: dict[str, np.ndarray], rank: np.ndarray) -> pa.RecordBatch:
    """Rows of a block; rank 0: none."""
    arrays = [pa.array(c["id"], mask=c["has_id"] == 0), *(pa.array(c[k]) for k in ("n_words", "n_features", "weight", "score")), pa.array(rank, mask=rank == 0)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight", "score", "rank"])


def merge_band(before: dict[int, int], draw: int) -> Callable[[pa.Table], pa.Table]:
    """The rows of a band's blocks with ranks from ``before`` the band on, none beyond ``draw``."""

    def one(table: pa.Table) -> pa.Table:
        blocks = sorted(table.to_pylist(), key=lambda b: b["run"])
        rank, runs = before[blocks[0]["band"]], [unpacked(b) for b in blocks]
        ranks = [np.zeros(b["n"], np.int64) for b in blocks]
        taken = [0] * len(runs)
        keys = [zip((-c["score"]).tolist(), c["id"].tolist(), c["n_words"].tolist(), c["n_features"].tolist(), strict=True) for c in runs]
        if rank < draw:
            for source, _ in Tournament(keys):
                rank += 1
                ranks[source][taken[source]] = rank
                taken[source] += 1
                if rank == draw:
                    break
        return pa.Table.from_batches([ranked(c, r) for c, r in zip(runs, ranks, strict=True)])

    return one


def unranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.to_pylist():
            yield ranked(unpacked(block), np.zeros(block["n"], np.int64))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_features, weight, score, rank.

    Of the documents with ``least_words`` words and more, floor(percent / 100)
    of their number are drawn; rank counts them from 1 by falling score, ties
    by doc_id (null: least), then by words and features; others have a null
    rank. Null text: no words, weight 0, never drawn unless ``least_words`` is
    0. Null doc_id: hashed as an empty string. Rows that share a doc_id are
    weighed each, and equal rows have ranks each. Empty ``docs``: no rows; empty
    ``target``: all its counts are 0. Other columns are ignored. ``buckets``
    numbers come to the driver and go to every task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scores = keep(rows.mapInArrow(score_texts(gain, longest, seed), "doc_id long, n_words long, n_features long, weight long, score long"), "scores")
    able = F.col("n_words") >= least_words
    n = scores.where(able).count()
    draw = n * percent // 100
    bands = min(BANDS, -(-n // BAND))
    cuts = scores.where(able).select(F.percentile_approx("score", [i / bands for i in range(1, bands)], max(10_000, 10 * bands))).first()[0] if bands > 1 else []
    runs = keep(scores.where(able).mapInArrow(sorted_runs(np.unique(np.array(cuts, np.int64))), BLOCKS_SQL), "runs")
    before, start = {}, 0
    for band, size in sorted(runs.groupBy("band").agg(F.sum("n")).collect(), reverse=True):
        before[band] = start
        start += size
    lowest = min((b for b, s in before.items() if s < draw), default=len(cuts) + 1)
    drawn = runs.where(F.col("band") >= lowest).groupBy("band").applyInArrow(merge_band(before, draw), RANKED)
    rest = runs.where(F.col("band") < lowest).mapInArrow(unranked, RANKED)
    return drawn.unionByName(rest).unionByName(scores.where(~able).withColumn("rank", F.lit(None).cast("long")))
