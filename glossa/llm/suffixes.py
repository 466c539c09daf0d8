"""Linear suffix sorting by grouping (Baier, 2016), in two phases.

Phase 1 holds suffixes in groups by their Lyndon prefix as far as known and
takes the groups in descending order. For each suffix of a group it finds the
previous smaller one, by pointers that earlier steps left; the suffixes so
found grow their prefix by the group's, as often as they were found, and move
into new groups behind their old ones. Phase 2 takes suffixes in ascending
order and puts every suffix whose prefix ends there at the next place of its
group. No ranks are renamed again and again, nothing recurses.

``suffix_array`` takes one text, ``suffix_arrays`` many short ones side by
side: each step takes the next group of every text at once, in numpy.
"""

from __future__ import annotations

import numpy as np


def suffix_array(data: bytes | np.ndarray) -> list[int]:
    """Starts of all suffixes of ``data`` in ascending order; a suffix comes before those it is a prefix of."""
    symbols = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else np.asarray(data)
    m = len(symbols)
    if not m:
        return []
    n = m + 1
    order = np.concatenate([[m], np.argsort(symbols, kind="stable")])
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    ranked = symbols[order[1:]]
    firsts = np.concatenate([[0, 1], np.flatnonzero(ranked[1:] != ranked[:-1]) + 2])
    counts = np.diff(np.append(firsts, n))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(firsts, counts)
    size = np.zeros(n + 1, np.int64)
    size[firsts] = counts
    place, pos, start_of, size = order.tolist(), at.tolist(), group.tolist(), size.tolist()
    before = [-1] * n

    end = n - 1
    while end > 0:
        start = start_of[place[end]]
        if start == end:  # most groups: one suffix, which moves one other
            s = place[end]
            p = s - 1
            while p >= 0 and start_of[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0 and size[g := start_of[p]] > 1:
                size[g] = last = size[g] - 1
                last += g
                q, here = place[last], pos[p]
                place[here] = q
                pos[q] = here
                place[last] = p
                pos[p] = start_of[p] = last
                size[last] = 1
            end -= 1
            continue
        members = sorted(place[start : end + 1])
        found: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and start_of[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        if len(found) == 1:
            steps = [list(found)]
        else:
            by_count: dict[int, list[int]] = {}
            for p, k in found.items():
                by_count.setdefault(k, []).append(p)
            steps = [by_count[k] for k in sorted(by_count, reverse=True)] if len(by_count) > 1 else list(by_count.values())
        for step in steps:
            moving: dict[int, list[int]] = {}
            for p in step:
                moving.setdefault(start_of[p], []).append(p)
            for g, some in moving.items():
                if len(some) == size[g]:
                    continue
                size[g] -= len(some)
                new = g + size[g]
                size[new] = len(some)
                for last, p in enumerate(some, new):
                    q, here = place[last], pos[p]
                    place[here], pos[q] = q, here
                    place[last], pos[p] = p, last
                    start_of[p] = new
        end = start - 1

    free = list(range(n))
    for g in set(start_of):
        free[g] = g
    done = bytearray(n)
    place[0] = m
    for i in range(n):
        p = place[i] - 1
        while p >= 0 and not done[p]:
            done[p] = 1
            g = start_of[p]
            place[free[g]] = p
            free[g] += 1
            p = before[p]
    return place[1:]


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of equal neighbours; there is at least one value."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return first, np.diff(np.append(first, len(values)))


def suffix_arrays(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The suffix arrays of the texts ``data[offs[i] : offs[i + 1]]``, one after the other, as positions in ``data``.

    Each text stands behind a guard, a place and position of its own that is in no group and stops the search for smaller suffixes.
    """
    lengths = np.diff(offs)
    text = np.repeat(np.arange(len(lengths)), lengths + 1)
    guards = np.cumsum(lengths + 1) - lengths - 1
    real = np.ones(len(text), bool)
    real[guards] = False
    key = text * 257
    key[real] += data[offs[0] : offs[-1]].astype(np.int64) + 1
    place = np.argsort(key, kind="stable")
    pos = np.empty_like(place)
    pos[place] = np.arange(len(place))
    size, start_of = np.zeros_like(place), np.empty_like(place)
    if len(place):
        firsts, counts = runs_of(key[place])
        size[firsts] = counts
        start_of[place] = np.repeat(firsts, counts)
    start_of[guards] = -1
    before = np.arange(-1, len(place) - 1)
    lyndon_groups(guards + lengths, place, pos, start_of, size, before)
    ascending(guards, guards + lengths, place, start_of, before)
    return place[real] - text[real] - 1 + offs[0]


def lyndon_groups(end: np.ndarray, place: np.ndarray, pos: np.ndarray, start_of: np.ndarray, size: np.ndarray, before: np.ndarray) -> None:
    """Phase 1 of all texts; ``end`` holds their last places."""
    moves = np.zeros(len(place), bool)
    while True:
        start = start_of[place[end]]
        if len(start) and start.min() < 0:
            end, start = end[start >= 0], start[start >= 0]
        if not len(end):
            return
        count = end - start + 1
        if count.max() == 1:
            s, own = place[end], start
        else:
            own = np.repeat(start, count)
            s = place[own + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)]
            s.sort()
        end = start - 1
        p = before[s]
        todo = np.flatnonzero(start_of[p] >= own)
        while len(todo):
            q = before[p[todo]]
            p[todo] = before[s[todo]] = q
            todo = todo[start_of[q] >= own[todo]]
        first, times = runs_of(p)  # p ascends as s does
        p = p[first]
        group = start_of[p]
        some = np.flatnonzero((group >= 0) & (size[group] > 1))
        if len(some):
            move(p[some], group[some], times[some], place, pos, start_of, size, moves)


def move(p: np.ndarray, group: np.ndarray, times: np.ndarray, place: np.ndarray, pos: np.ndarray, start_of: np.ndarray, size: np.ndarray, moves: np.ndarray) -> None:
    """Takes suffixes to the ends of their groups, those found more often further on; such as were found as often are a new group."""
    key = group * (int(times.max()) + 1) + times
    by = np.argsort(key, kind="stable")
    p, group, key = p[by], group[by], key[by]
    first, n = runs_of(group)
    g = group[first]
    low = g + size[g] - n
    to = np.repeat(low - first, n) + np.arange(len(p))
    size[g] -= n
    new, n_new = runs_of(key)
    size[to[new]] = n_new
    start_of[p] = np.repeat(to[new], n_new)
    moves[p] = True
    held, here = place[to], pos[p]
    held, here = held[~moves[held]], here[here < np.repeat(low, n)]
    place[here], pos[held] = held, here
    place[to], pos[p] = p, to
    moves[p] = False


def ascending(guards: np.ndarray, last: np.ndarray, place: np.ndarray, start_of: np.ndarray, before: np.ndarray) -> None:
    """Phase 2 of all texts, from the empty suffixes on."""
    free = np.arange(len(place))
    done = np.zeros(len(place), bool)
    done[guards] = True
    at, p = guards, last
    while len(at):
        p = p[~done[p]]
        while len(p):
            done[p] = True
            g = start_of[p]
            f = free[g]
            place[f] = p
            free[g] = f + 1
            p = before[p]
            p = p[~done[p]]
        at = at + 1
        if (at > last).any():
            at, last = at[at <= last], last[at <= last]
        p = place[at] - 1
