"""Fast similarity sketches of sets of 64-bit hashes (Dahlgaard, Knudsen, Thorup, 2017).

Round i < t throws every element into one random bin with value i + h; rounds
t <= i < 2t throw every element into bin i - t, so that each coordinate fills.
A bin keeps its least value. A set needs no further round once its bins are
full, so n elements cost about max(n, t ln t) hashes.
"""

from __future__ import annotations

import numpy as np

from glossa.llm.scan import U, mix

SEED = 0x51ED270B7F4A7C15
EMPTY = U(2**64 - 1)


def fast_sketches(x: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """A row of t coordinates for each of the sets that lie one after another in ``x``.

    The share of equal coordinates of two rows estimates the Jaccard
    similarity of their sets. The row of an empty set holds ``EMPTY`` only.
    """
    out = np.full((len(sizes), t), EMPTY)
    flat = out.reshape(-1)
    active = np.flatnonzero(sizes > 0)
    ends = np.cumsum(sizes)
    part, own = x, np.repeat(np.arange(len(sizes)), sizes)
    for i in range(2 * t):
        h = mix(part ^ mix(np.array([SEED + i], np.uint64)))
        value = (mix(h + U(i)) >> U(16)) | (U(i) << U(48))
        bins = (h % U(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, own * t + bins, value)
        open_ = active[(out[active] == EMPTY).any(axis=1)]
        if not len(open_):
            break
        if len(open_) < len(active):
            active = open_
            at = np.concatenate([np.arange(ends[s] - sizes[s], ends[s]) for s in active])
            part, own = x[at], np.repeat(active, sizes[active])
    return out


def bands(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each ``rows`` coordinates; the place of the band counts."""
    n, t = sketches.shape
    cut = sketches.reshape(n, t // rows, rows)
    out = np.broadcast_to(np.arange(t // rows, dtype=np.uint64) + U(1), cut.shape[:2]).copy()
    for j in range(rows):
        out = mix(out * U(0xD6E8FEB86659FD93) + cut[:, :, j])
    return out


def short(sketches: np.ndarray) -> np.ndarray:
    """The coordinates as one byte each, to estimate similarities from."""
    return (mix(sketches) >> U(56)).astype(np.uint8)
