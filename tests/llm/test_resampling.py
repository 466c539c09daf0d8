"""Resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from glossa.llm import resampling
from glossa.llm.resampling import Tournament, crc32_spans, resample
from tests.llm.fixtures import frame, odd_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(text, longest):
    w = WORD.findall((text or "").translate(FOLD))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent, least, longest, buckets, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, x in docs for f in parts(x, longest)[1])
    t = Counter(bucket(f) for x in target for f in parts(x, longest)[1])
    sa, ta = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sa + buckets) / ((s[b] + 1) * (ta + buckets)))) for b in range(buckets)]
    rows = []
    for d, x in docs:
        n, f = parts(x, longest)
        w = sum(gain[bucket(y)] for y in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[1], r[2]))
    draw = len(able) * percent // 100
    ranked = [(*r, i + 1 if i < draw else None) for i, r in enumerate(able)] + [(*r, None) for r in rows if r[1] < least]
    return Counter(ranked)


@pytest.mark.parametrize(("percent", "least", "longest", "buckets"), [(10, 20, 1, 10_000), (50, 0, 1, 97), (100, 5, 3, 1000), (0, 1, 2, 50)])
def test_equals_plain_python(spark, monkeypatch, percent, least, longest, buckets):
    monkeypatch.setattr(resampling, "BAND", 16)
    rows = odd_documents(percent)
    rows += [(9000 + i // 3, "Tied words, tied WORDS tied." * 5, *[None] * 11) for i in range(60)]
    target = [x[1] for x in odd_documents(77)[:9]]
    out = resample(frame(spark, rows), spark.createDataFrame([(x,) for x in target], "text string"), percent, least, longest, buckets, 7)
    assert Counter(tuple(r) for r in out.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == brute([r[:2] for r in rows], target, percent, least, longest, buckets, 7)


def test_many_runs_and_bands(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BAND", 50)
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(15, 40)))) for i in range(3000)]
    docs, target = spark.createDataFrame(rows, "doc_id long, text string").repartition(23), spark.createDataFrame([("aa bb cc",)], "text string")
    out = resample(docs, target, 37)
    assert Counter(tuple(x) for x in out.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == brute(rows, ["aa bb cc"], 37, 20, 1, 10_000, 2024)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resample(frame(spark, []), none).count() == 0
    out = resample(spark.createDataFrame([(1, None), (2, ""), (3, "a " * 30)], "doc_id long, text string"), none, 100).orderBy("doc_id").collect()
    assert [(x.doc_id, x.n_features, x.rank) for x in out] == [(1, 0, None), (2, 0, None), (3, 30, 1)]


def test_tournament_merges_sources():
    r = random.Random(3)
    for k in (0, 1, 2, 3, 7, 64):
        sources = [sorted((r.randint(0, 9), r.randint(0, 3)) for _ in range(r.randint(0, 20))) for _ in range(k)]
        merged = list(Tournament([iter(s) for s in sources]))
        assert [x for _, x in merged] == sorted(x for s in sources for x in s)
        for i, s in enumerate(sources):
            assert [x for w, x in merged if w == i] == s


def test_checksums_of_spans():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 5000, dtype=np.uint8)
    starts = np.sort(r.choice(4000, 300, replace=False))
    ends = starts + r.choice([0, 1, 5, 63, 64, 65, 700], 300)
    assert crc32_spans(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert crc32_spans(data, starts[:0], ends[:0]).tolist() == []
