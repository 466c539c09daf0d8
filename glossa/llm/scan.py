"""Vectorised scans of Arrow text batches: words, rolling hashes, minimizer runs.

Texts are handled as UTF-8 bytes. A word is a maximal run of bytes other than
0x20 and 0x09-0x0D. Hashes are 64-bit polynomials over a table of random byte
codes, finished by a mixing step; work on a batch is cut into pieces of a few
megabytes so that memory does not follow the size of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 2 << 20
#: Most starts in one row of runs; a row's place, length and a flag share one long.
LONGEST = 2048
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


@lru_cache(8)
def codes(seed: int, fold_case: bool) -> np.ndarray:
    t = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
    if fold_case:
        t[65:91] = t[97:123]
    return t


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, U(b))
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def prefix(data: np.ndarray, seed: int, fold_case: bool = False) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes(seed, fold_case)[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def chunks(batch: pa.RecordBatch, text: int, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, offsets from 0, bytes) of pieces of about ``limit`` bytes, whole texts each."""
    col = batch.column(text).cast(pa.large_string()).fill_null("")
    if not len(col):
        return
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, offs[a : b + 1] - offs[a], data[offs[a] : offs[b]]
        a = b


def words(data: np.ndarray, offs: np.ndarray, seed: int = 1, fold_case: bool = False) -> tuple[np.ndarray, ...]:
    """Starts, ends (byte positions), hashes and texts (indexes) of all words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, span_hashes(data, starts, ends, seed, fold_case), np.searchsorted(offs, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, fold_case: bool = False) -> np.ndarray:
    """Hashes of the bytes of ascending spans that do not overlap."""
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        a = starts[i]
        sums = prefix(data[a : ends[j - 1]], seed, fold_case)
        s = starts[i:j] - a
        hashes[i:j] = (sums[ends[i:j] - a] - sums[s]) * powers(len(sums))[1][s]
        i = j
    return mix(hashes + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of the k-grams of ``h`` at every position where one fits, whatever text it starts in."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, U(seed * 0x632BE59BD9B4E019 & MASK))
    for j in range(k):
        out *= U(0xD6E8FEB86659FD93)
        out += h[j : j + n]
        out ^= out >> U(32)
    return mix(out)


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """min(h[i : i + w]) for each i where the window fits."""
    if len(h) < w:
        return h[:0]
    done = 1
    while done * 2 <= w:
        h = np.minimum(h[: len(h) - done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (w - done)], h[w - done :]) if done < w else h


def runs(mins: np.ndarray, text_of: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal ``mins`` within a text, cut at ``longest``."""
    if not len(mins):
        z = np.zeros(0, np.int64)
        return z, z
    new = np.ones(len(mins), bool)
    new[1:] = (mins[1:] != mins[:-1]) | (text_of[1:] != text_of[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(mins)))
    if n.max() > longest:
        parts = -(-n // longest)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at2 = np.repeat(at, parts) + step * longest
        n = np.minimum(longest, np.repeat(at + n, parts) - at2)
        at = at2
    return at, n


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def pack(start: np.ndarray, n: np.ndarray, flag: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) * 4096 + (n.astype(np.int64) - 1) * 2 + flag


def unpack(col: str) -> tuple[Column, Column, Column]:
    """Start, length and flag of ``pack``."""
    c = F.col(col)
    return F.shiftright(c, 12), (F.shiftright(c, 1).bitwiseAND(F.lit(2047)) + 1).cast("int"), c.bitwiseAND(F.lit(1)) == 1


def least_twice(hashes: np.ndarray, mins: np.ndarray, w: int, near: int) -> np.ndarray:
    """Hashes that are least in a window and come again less than ``near`` further on: their runs can hold repeats of their own."""
    top = np.full(len(hashes) + w - 1, U(0))
    top[w - 1 : w - 1 + len(mins)] = mins
    at = np.flatnonzero(~window_min(~top, w) == hashes)
    again = (hashes[at[1:]] == hashes[at[:-1]]) & (np.diff(at) < near)
    return np.unique(hashes[at[1:][again]])
