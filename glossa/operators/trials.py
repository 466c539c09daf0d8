"""The decoder's random trials over numbers, and the filter of bigrams that rules most of them out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each bigram, at most in all, and in a slice that one task makes.
EACH, MOST, SLICE = 16, 1 << 29, 1 << 23
#: Bigrams of a trial that are looked up before the trials that have lost are left out; sentences of a batch that comes out.
AHEAD, SENTENCES = 4, 64

A, B, C, D = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def mixed(before: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The hash ``before`` carried on over whole numbers of 32 bits, as ``xxhash64`` does along its columns."""
    h = before + D + np.uint64(4)
    h = h ^ number.astype(np.uint64) * A
    h = (h << np.uint64(23) | h >> np.uint64(41)) * B + C
    for shift, by in ((33, B), (29, C)):
        h = (h ^ h >> np.uint64(shift)) * by
    return h ^ h >> np.uint64(32)


def places(first: np.ndarray, second: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of bigrams whose words have these hashes; ``bits`` is a power of 2."""
    h = mixed(first ^ second << np.uint64(1), second >> np.uint64(32))
    return h & np.uint64(bits - 1), h >> np.uint64(32) & np.uint64(bits - 1)


def bigram_filter(bi: DataFrame, n: int) -> np.ndarray:
    """Bytes whose bits stand for the ``n`` bigrams of ``bi`` (w1, w2): two a bigram, so that one without both isn't among them."""
    bits = min(MOST, max(8, 1 << max(n * EACH - 1, 0).bit_length()))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(places(*(b.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // SLICE).astype(np.int32)), pa.array((at % SLICE).astype(np.int32))], ["slice", "bit"])

    def joined(t: pa.Table) -> pa.Table:
        here = np.zeros(min(SLICE, bits), bool)
        here[t.column("bit").to_numpy()] = True
        return pa.Table.from_arrays([t.column("slice").slice(0, 1), pa.array([np.packbits(here, bitorder="little").tobytes()])], ["slice", "bits"])

    hashes = bi.where("w1 is not null and w2 is not null").select(F.xxhash64("w1").alias("h1"), F.xxhash64("w2").alias("h2"))
    out = np.zeros(bits // 8, np.uint8)
    for r in hashes.mapInArrow(numbered, "slice int, bit int").groupBy("slice").applyInArrow(joined, "slice int, bits binary").collect():  # at most ``MOST`` bits
        out[r.slice * SLICE // 8 :][: len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def passing(known: np.ndarray, pick: int, key: int, pos: np.ndarray, sizes: np.ndarray, h: np.ndarray, trials: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(trials, candidates of each in order, whether trial 0 passes): trial 0 and those whose bigrams may all be known, one of equal ones."""
    begin, all_trials = np.cumsum(sizes) - sizes, np.arange(trials + 1)
    of_pick = mixed(np.full(trials + 1, pick, np.int64).view(np.uint64), all_trials)
    lo, hi = np.searchsorted(pos, 0, side="right"), np.searchsorted(pos, pos[-1])
    hi = max(lo, hi)
    keys = mixed(mixed(np.full(trials + 1, key, np.int64).view(np.uint64), all_trials)[:, None], pos[None, lo:hi]).view(np.int64)
    keys[0] = np.arange(hi - lo)

    def order(some: np.ndarray) -> np.ndarray:
        ends = [np.broadcast_to(np.arange(a, b), (len(some), b - a)) for a, b in ((0, lo), (hi, len(pos)))]
        return np.concatenate([ends[0], np.argsort(keys[some], axis=1, kind="stable") + lo, ends[1]], axis=1)

    def chosen(some: np.ndarray, seq: np.ndarray) -> np.ndarray:
        which = mixed(of_pick[some][:, None], pos[seq]).view(np.int64) % sizes[seq]
        which[some == 0] = 0
        return begin[seq] + which

    def seen(at: np.ndarray) -> np.ndarray:
        both = places(h[at[:, :-1]], h[at[:, 1:]], 8 * len(known))
        return np.logical_and(*(known[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1 for b in both)).all(axis=1)

    alive = all_trials if len(pos) > 1 else all_trials[:1]  # one word alone scores 0 in all of them
    if lo == 1 and hi > 2:  # most lose at once, before their words are sorted
        first = np.stack([np.zeros(len(alive), np.int64), keys.argmin(axis=1) + lo], axis=1)
        alive = alive[seen(chosen(alive, first))]
    seq = order(alive)
    for a in range(0, len(pos) - 1, AHEAD):
        if not len(alive):
            break
        ok = seen(chosen(alive, seq[:, a : a + AHEAD + 1]))
        alive, seq = alive[ok], seq[ok]
    at = chosen(alive, seq)
    if len(alive) > 1:
        one = np.sort(np.unique(at, axis=0, return_index=True)[1])
        alive, at = alive[one], at[one]
    won = bool(len(alive)) and alive[0] == 0
    if not won:
        alive, at = np.append(0, alive), np.concatenate([begin[None, :], at])
    return alive, at, won


def tried(known, trials: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sentences (sid, pick, key, pos, sizes, h, e, p) as their passing trials (sid, trial, alive, words, p)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SENTENCES):
                b = whole.slice(start, SENTENCES)
                lists = {c: b.column(c) for c in ("pos", "sizes", "h", "e", "p")}
                flat = {c: x.flatten() for c, x in lists.items()}
                pos, sizes, h = (flat[c].to_numpy(zero_copy_only=False) for c in ("pos", "sizes", "h"))
                ends, until = (np.cumsum(lists[c].value_lengths().to_numpy(zero_copy_only=False)) for c in ("pos", "h"))
                row, trial, alive, taken = [], [], [], []
                for i, (pick, key) in enumerate(zip(b.column("pick").to_pylist(), b.column("key").to_pylist(), strict=True)):
                    here, there = slice(ends[i - 1] if i else 0, ends[i]), slice(until[i - 1] if i else 0, until[i])
                    of, at, won = passing(known.value, pick, key, pos[here], sizes[here], h[there].view(np.uint64), trials)
                    row.append(np.full(len(of), i))
                    trial.append(of)
                    alive.append((of > 0) | won)
                    taken.extend(at + there.start)
                offsets = pa.array(np.cumsum([0, *map(len, taken)]).astype(np.int32))
                taken = pa.array(np.concatenate(taken))
                out = [b.column("sid").take(pa.array(np.concatenate(row))), pa.array(np.concatenate(trial).astype(np.int32)), pa.array(np.concatenate(alive)), *(pa.ListArray.from_arrays(offsets, flat[c].take(taken)) for c in ("e", "p"))]
                yield pa.RecordBatch.from_arrays(out, ["sid", "trial", "alive", "words", "p"])

    return run
