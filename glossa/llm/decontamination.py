"""Benchmark decontamination: edit distance by CGK embedding and bit-sampling LSH, then exact verification.

Texts and items are lower-cased (A-Z) words. An item of n words counts as found
where some part of a text is at most n // 5 word edits away. With so many edits
the embedding of a whole long item keeps hardly any places, so the windows that
are embedded have the size of short items: up to ``WINDOW`` words. An item
within its edits has windows with few of them, and windows start at every word
of a text. A random walk embeds a window (Chakraborty, Goldenberg, Koucky,
2016): at each step the current word is put out and a shared random bit of step
and word decides whether to go on to the next, which turns few edits into few
unequal places. In each of ``REPEATS`` walks a sample of places gives a bucket.
Windows of text and item that meet in any bucket place the item in the text;
there, where enough words are the item's, the edits are counted exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import scan
from glossa.llm.store import doc_id_back, keyed, row_key

EDITS = 5
#: Words of a window of items from ``LONG`` words on; shorter items have windows of half their words, those that must stand unchanged of all.
WINDOW, LONG = 8, 12
REPEATS, SAMPLE = 6, 4
#: Items from so many words on have a window at every second word.
SPARSE = 64
#: Bytes of benchmark text that go to each task at once; more items take further passes.
BLOCK = 4 << 20
#: Windows that are compared at once: a bucket may hold many items and stand often in a text.
MOST_HITS = 1 << 18
#: Words of windows that are counted at once, and of a text that are embedded at once.
MOST_WORDS, STRETCH = 1 << 21, 1 << 15
#: Places of an item in a text are rounded down to a multiple of this.
GRID = 8


def walk(h: np.ndarray, stop: np.ndarray, w: int, r: int, places: np.ndarray) -> np.ndarray:
    """The bucket in walk r of the window of w words at each place of ``h``, cut at the end ``stop`` of its text."""
    moves = scan.mix(h ^ scan.mix(np.array([r + 1], np.uint64)))  # a bit for each step
    at = np.arange(len(h))
    end = np.minimum(at + w, stop)
    bucket = np.full(len(h), scan.U(r << 8 | w))
    for step in range(int(places[-1]) + 1):
        inside = at < end
        here = np.minimum(at, len(h) - 1)
        if step in places:
            bucket = (bucket ^ np.where(inside, h[here], scan.U(0))) * scan.U(0xD6E8FEB86659FD93)
            bucket ^= bucket >> scan.U(32)
        at = at + (inside & (moves[here] >> scan.U(step) & scan.U(1)).astype(bool))
    return scan.mix(bucket)


def window_of(n: int) -> int:
    return n if n < EDITS else WINDOW if n >= LONG else n // 2


class Items:
    """The items of one block, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str | None]]):
        raw = [(i, (t or "").encode()) for i, t in items]
        self.ids, self.words = [], []
        for i, text in raw:
            _, _, h, _ = scan.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), fold_case=True)
            if len(h):
                self.ids.append(i)
                self.words.append(h)
        self.lengths = np.array([len(h) for h in self.words], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *self.words])
        owner = np.repeat(np.arange(len(self.words)), self.lengths)
        self.own_words = np.zeros(1 << (16 * len(flat) + 1).bit_length(), bool)
        self.own_words[self.slots(flat, owner)] = True
        #: For each window size the sampled places of each walk, and buckets (sorted) with item and place in it.
        self.sizes = {w: self.buckets(w) for w in sorted({window_of(n) for n in self.lengths.tolist()})}

    def buckets(self, w: int) -> tuple[list[np.ndarray], list[tuple[np.ndarray, ...]]]:
        draw = np.random.Generator(np.random.PCG64(w))
        places = [np.sort(draw.choice(max(1, 3 * w // 2), min(SAMPLE, w), replace=False)) for _ in range(REPEATS if w > 1 else 1)]
        mine = [k for k, n in enumerate(self.lengths.tolist()) if window_of(n) == w]
        h, n = np.concatenate([self.words[k] for k in mine]), self.lengths[mine]
        stop = np.repeat(np.cumsum(n), n)
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        use = np.flatnonzero((place + w <= np.repeat(n, n)) & ((place % 2 == 0) | (np.repeat(n, n) < SPARSE)))
        item = np.repeat(np.array(mine), n)[use].astype(np.int32)
        table = []
        for r, p in enumerate(places):
            key = walk(h, stop, w, r, p)[use]
            order = np.argsort(key, kind="stable")
            bits = max(12, (16 * len(key)).bit_length())
            may = np.zeros(1 << bits, bool)
            may[key >> scan.U(64 - bits)] = True
            table.append((key[order], item[order], place[use][order].astype(np.int32), may, np.uint64(64 - bits)))
        return places, table

    def slots(self, words: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The places of words of items in ``own_words``; words of other items may share them, so counts are never too small."""
        return (scan.mix(words ^ scan.mix(item.astype(np.uint64) + scan.U(1))) & scan.U(len(self.own_words) - 1)).astype(np.int64)

    def may_hold(self, item: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether h[lo:hi] has enough words of the item, one for each that at most a fifth of edits leaves."""
        out, upto, a = np.zeros(len(item), bool), np.cumsum(hi - lo), 0
        while a < len(item):
            size = (hi - lo)[a]
            b = max(a + 1, int(np.searchsorted(upto, upto[a] - size + MOST_WORDS, "right")))
            sizes = (hi - lo)[a:b]
            first = np.cumsum(sizes) - sizes
            at = np.arange(sizes.sum()) + np.repeat(lo[a:b] - first, sizes)
            found = np.add.reduceat(self.own_words[self.slots(h[at], np.repeat(item[a:b], sizes))], first, dtype=np.int64)
            out[a:b] = found >= self.lengths[item[a:b]] - self.lengths[item[a:b]] // EDITS
            a = b
        return out


def least_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least number of word edits between ``item`` and any part of ``text``, and where that part ends."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (text != word), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


_ready: dict[str, Items] = {}


def items_of(name: str, items: list[tuple[int, str | None]]) -> Items:
    """The items of a block, made ready once in each worker process, which holds one block at a time."""
    if name not in _ready:
        _ready.clear()
        _ready[name] = Items(items)
    return _ready[name]


def search(name: str, raw: list[tuple[int, str | None]]):
    """(did, th, text) to (did, th, item_id, start, n_words, edits): a row for each item of the block ``raw`` in a text, at its best place."""

    def compare(items: Items, hits: np.ndarray, slack: int, h: np.ndarray, begins: np.ndarray, ends: np.ndarray, best: dict[tuple[int, int], tuple[int, int]]) -> None:
        for a in range(0, len(hits), 16384):
            doc, item, start = hits[a : a + 16384].T
            n = items.lengths[item]
            lo, hi = np.maximum(begins[doc], start - n // EDITS - slack), np.minimum(ends[doc], start + GRID + n + n // EDITS + slack)
            likely = items.may_hold(item, h, lo, hi)
            # overlapping windows of one text and item are one stretch
            stretches: list[list[int]] = []
            for d, k, x, y in zip(*(c[likely].tolist() for c in (doc, item, lo, hi)), strict=True):
                if stretches and stretches[-1][:2] == [d, k] and x <= stretches[-1][3]:
                    stretches[-1][3] = max(y, stretches[-1][3])
                else:
                    stretches.append([d, k, x, y])
            for d, k, x, y in stretches:
                if best.get((d, k), (1, 0))[0] == 0:
                    continue
                most = int(items.lengths[k]) // EDITS
                edits, end = least_edits(items.words[k], h[x:y])
                if edits <= most and edits < best.get((d, k), (most + 1, 0))[0]:
                    _, size = least_edits(items.words[k][::-1], h[x : x + end][::-1])
                    best[(d, k)] = (edits, x + end - size - int(begins[d]))

    def hits_of(items: Items, w: int, h: np.ndarray, own: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """(text, item, start) where windows meet in a bucket, in bounded parts."""
        places, table = items.sizes[w]
        longest = int(items.lengths.max()) // GRID * GRID + GRID
        span = (STRETCH + longest) // GRID + 1
        for a in range(0, len(h), STRETCH):
            part = h[a : a + STRETCH + w]
            stop, new = ends[own[a : a + STRETCH + w]] - a, min(STRETCH, len(h) - a)
            held, size = [], 0
            for r, p in enumerate(places):
                keys, item, place, may, shift = table[r]
                key = walk(part, stop, w, r, p)[:new]
                at = np.flatnonzero(may[key >> shift])
                lo = np.searchsorted(keys, key[at])
                n = np.searchsorted(keys, key[at], "right") - lo
                upto, b = np.cumsum(n), 0
                while b < len(at):
                    c = max(b + 1, int(np.searchsorted(upto, upto[b] - n[b] + MOST_HITS, "right")))
                    m = n[b:c]
                    which = np.repeat(lo[b:c], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    pos = a + np.repeat(at[b:c], m)
                    held.append(((own[pos] - own[a]) * len(items.ids) + item[which]) * span + (pos - a - place[which] + longest) // GRID)
                    size += len(which)
                    if size >= MOST_HITS:
                        yield unpacked(held, span, a, own[a], longest, len(items.ids))
                        held, size = [], 0
                    b = c
            if size:
                yield unpacked(held, span, a, own[a], longest, len(items.ids))

    def unpacked(held: list[np.ndarray], span: int, a: int, first: int, longest: int, n_items: int) -> np.ndarray:
        names, start = np.divmod(np.unique(np.concatenate(held)), span)
        text, item = np.divmod(names, n_items)
        return np.stack([text + first, item, start * GRID - longest + a], axis=1)

    def in_chunk(items: Items, offs: np.ndarray, data: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        _, _, h, own = scan.words(data, offs, fold_case=True)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        begins = np.searchsorted(own, np.arange(len(offs) - 1))
        ends = np.searchsorted(own, np.arange(len(offs) - 1), "right")
        for w in items.sizes:
            for hits in hits_of(items, w, h, own, ends):
                compare(items, hits, w, h, begins, ends, best)
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = items_of(name, raw)
        for batch in batches:
            for a, _, offs, data in scan.chunks(batch, 2):
                best = in_chunk(items, offs, data)
                rows = pa.array([a + d for d, _ in best], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([items.ids[k] for _, k in best], pa.int64()), pa.array([s for _, s in best.values()], pa.int64()), pa.array([int(items.lengths[k]) for _, k in best], pa.int64()), pa.array([e for e, _ in best.values()], pa.int64())],
                    ["did", "th", "item_id", "start", "n_words", "edits"],
                )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(did, th, item_id, start, n_words, edits) for each row of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) it holds.

    edits: word edits to the best part of the text, at most a fifth of the
    item's n_words; start: the word where that part begins. An item that stands
    unchanged is always found; of those with edits some may be missed (the
    README has the measured share). Items without words (null, empty) are found
    nowhere; items shorter than 5 words must stand unchanged. The benchmark
    goes to the tasks in blocks of bounded size; repeated items count once.
    Null text: no rows. Empty tables: no rows. Other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long"), "text").distinct()
    n_blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // BLOCK))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    d, out = keyed(docs), None
    for b in range(n_blocks):
        part = [tuple(r) for r in items.where(block == b).collect()]  # about BLOCK bytes
        rows = d.mapInArrow(search(uuid.uuid4().hex, part), "did long, th long, item_id long, start long, n_words long, edits long")
        out = rows if out is None else out.unionByName(rows)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    bad = leaks(docs, benchmark).select("did", "th").distinct()
    rows = docs.select(row_key()[0], row_key()[1], F.struct("*").alias("row"))
    return rows.join(bad, ["did", "th"], "left_anti").select("row.*")


def found_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``leaks`` by doc_id."""
    return leaks(docs, benchmark).select(doc_id_back().alias("doc_id"), "item_id", "start", "n_words", "edits")
