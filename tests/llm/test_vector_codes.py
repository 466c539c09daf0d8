"""Vector codes against plain Python."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from glossa.llm import vector_codes as vc
from glossa.llm.vector_codes import Tree, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, vec string, salt int, error string"


def brute(rows, parts, entries, rounds):
    good = [(i, label, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    length = next((len(v) for _, _, v in good if v and len(v) % parts == 0), None)
    good = [r for r in good if len(r[2]) == length]
    cut = lambda v: [v[p * length // parts : (p + 1) * length // parts] for p in range(parts)]
    books = [[cut(v)[p] for _, _, v in good[:entries]] for p in range(parts)]

    def near(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(e, x, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups: dict[int, list] = {}
            for _, _, v in good:
                groups.setdefault(near(books[p], cut(v)[p])[1], []).append(cut(v)[p])
            for i, g in groups.items():
                books[p][i] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    found = [(i, label, [near(books[p], cut(v)[p]) for p in range(parts)]) for i, label, v in good]
    total = Counter()
    for _, label, n in found:
        total[label] += sum(d for d, _ in n)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, label, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), total[label], sha) for i, label, n in found)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", "v", 1, "e") for i, v, label in rows], SCHEMA).repartition(3)


def odd_vectors(seed, n=150, d=8):
    r = random.Random(seed)
    rows = [(i if i % 3 else i * 7, [r.choice([0.0, 0.25, -0.5, r.gauss(0, 1)]) for _ in range(d)], r.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [(900, None, 1), (901, [None] * d, 1), (902, [0.5, float("nan")] * (d // 2), 2), (903, [float("inf")] + [0.0] * (d - 1), 2), (904, [float("-inf")] + [0.0] * (d - 1), 2)]
    rows += [(None, [0.125] * d, 5), (None, [0.125] * d, 5), (0, [0.25] * d, None), (-5, [0.1] * (d + 1), 3), (-6, [], 3), (905, [0.1] * (2 * d), 3), (906, [0.1] * d, 9)]
    return rows + [(2000 + i, [0.5] * d, 4) for i in range(60)]


@pytest.mark.parametrize(("parts", "entries", "rounds", "most"), [(4, 32, 4, 100_000), (2, 256, 3, 1), (4, 1, 2, 100_000), (1, 50, 0, 1)])
def test_equals_plain_python(spark, monkeypatch, parts, entries, rounds, most):
    monkeypatch.setattr(vc, "MOST_LABELS", most)
    rows = odd_vectors(entries)
    out = vector_codes(table(spark, rows), parts=parts, entries=entries, rounds=rounds)
    assert Counter(map(tuple, out.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect())) == brute(rows, parts, entries, rounds)


def test_nearest_takes_the_lower_of_equal_entries():
    r = np.random.default_rng(0)
    for d in (1, 2, 5, 16):
        for span in (2, 4, 1000):
            entries, x = r.integers(-span, span, (256, d)), r.integers(-span, span, (700, d))
            dist = ((x[:, None] - entries[None]) ** 2).sum(2)
            at, best = Tree(entries).nearest(x)
            assert at.tolist() == dist.argmin(1).tolist() and best.tolist() == dist.min(1).tolist()
    same = Tree(np.full((256, 3), 7))
    assert same.nearest(np.zeros((4, 3), np.int64))[0].tolist() == [0] * 4


def test_search_leaves_nodes_out():
    r, seen = np.random.default_rng(1), []
    tree = Tree(r.integers(0, 10_000, (256, 2)))
    take = Tree.take

    def counted(self, x, idx, best, at):
        seen.append(len(idx) * len(self.entries))
        take(self, x, idx, best, at)

    Tree.take = counted
    try:
        tree.nearest(r.integers(0, 10_000, (1000, 2)))
    finally:
        Tree.take = take
    assert sum(seen) < 1000 * 256 / 5


def test_large_values_and_empty_tables(spark):
    out = vector_codes(table(spark, [(1, [3e38, -3e38, 1.0, 2.0], 1), (2, [0.0] * 4, 1)]), parts=2, entries=1, rounds=1).collect()
    assert len(out) == 2 and all(x.error >= 0 and x.label_error >= 0 for x in out)
    assert vector_codes(table(spark, [])).count() == 0
    assert vector_codes(table(spark, [(1, None, 1), (2, [1.0] * 3, None)])).count() == 0
    with pytest.raises(ValueError, match="entries"):
        vector_codes(table(spark, []), entries=257)
