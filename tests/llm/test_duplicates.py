"""Near-duplicates, repeats and substrings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.llm import repeats, scan
from glossa.llm.components import components
from glossa.llm.near_duplicates import cell_blocks, near_duplicates, refusal
from glossa.llm.sketches import fast_sketches
from glossa.llm.substrings import FingerprintIndex, batches_of, remove_earlier_windows
from glossa.llm.suffixes import suffix_array, suffix_arrays
from tests.llm.fixtures import frame, odd_documents

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").encode().translate(LOW).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    """Vertices are doc_ids; rows that share one are one vertex."""
    ids = sorted({d for d, _ in rows}, key=lambda d: (d is not None, d or 0))
    parent = {d: d for d in ids}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    sets = [(d, shingles(t)) for d, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            common = len(x & y)
            if x and y and 100 * common >= percent * (len(x) + len(y) - common):
                u, v = sorted((find(a), find(b)), key=ids.index)
                parent[v] = u
    return Counter((d, len(s), find(d)) for d, s in sets)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    rows = [(r[0], r[1]) for r in odd_documents(1)]
    out = near_duplicates(frame(spark, seed=1), percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_components(rows, percent)


def test_near_duplicates_of_one_large_group(spark):
    """A chain of copies: neighbours are linked, far ones are not."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words[(i * 7) % 200] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_components(rows, 85)
    assert sum(r.kept for r in out) == len({r.component_id for r in out})


def test_unlike_members_of_a_bucket_leave_no_rows():
    """2,000 unlike members of one bucket are refused by their sketches; only pairs that are close give rows."""
    r = np.random.default_rng(5)
    n, t = 2000, 252
    sketch = r.integers(0, 4, (n, t)).astype(np.uint8)
    sketch[1700] = np.where(r.random(t) < 0.95, sketch[3], 9)
    side = np.arange(n) % 2 == 0
    side[[3, 1700]] = True, False
    bands = np.tile(np.arange(42), (n, 1))
    columns = {"cell": np.zeros(n, np.int64), "bucket": np.zeros(n, np.int64), "left": side, "did": np.arange(n), "th": np.arange(n), "label_did": np.arange(n), "label_th": np.arange(n), "n": np.full(n, 200)}
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), pa.array([s.tobytes() for s in sketch]), pa.array(bands.tolist())], [*columns, "sketch", "bands"])
    rows = [x for b in cell_blocks(80, refusal(80, t))(iter([batch])) for x in b.to_pylist()]
    assert [(x["left"], x["did"], len(x["partners"])) for x in rows] == [(True, 3, 1), (False, 1700, 0)]
    assert rows[0]["partners"] == [rows[1]["place"]] and rows[0]["fine"] == rows[1]["fine"]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert near_duplicates(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert remove_earlier_windows(none).count() == 0


def test_sketch_estimates():
    r = np.random.default_rng(1)
    for n in (1, 3, 40, 2000):
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: int(len(x) * 0.8)], r.integers(0, 2**63, len(x) - int(len(x) * 0.8), dtype=np.uint64)]))
        s = fast_sketches(np.concatenate([x, x[:0], y]), np.array([len(x), 0, len(y)]), 256)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((s[0] == s[2]).mean() - true) < 0.13
        assert (s[1] == 2**64 - 1).all() and (s[0] != 2**64 - 1).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(50, 90)] + [(r.randrange(50), r.randrange(50)) for _ in range(35)] + [(200, x) for x in range(201, 260)] + [(7, 7)]
    parent = list(range(300))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        u, v = sorted((find(a), find(b)))
        parent[v] = u
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(i, i) == find(i) for i in range(300))


def test_suffix_array():
    r = random.Random(3)
    for t in range(800):
        s = bytes(r.choice(b"ab" if t % 3 else b"abcd") for _ in range(r.randint(0, 40))) * (3 if t % 5 == 0 else 1)
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_arrays_side_by_side():
    r = random.Random(6)
    odd = [b"", b"a", b"a" * 700, b"ab" * 200, b"", bytes(range(256)) * 2, b"\xff\x00" * 90, b""]
    for t in range(40):
        texts = [bytes(r.choice(b"ab" if i % 3 else b"abcd") for _ in range(r.randint(0, 40))) * (3 if i % 5 == 0 else 1) for i in range(r.randint(0, 60))] + odd * (t % 4 == 0)
        offs = 5 + np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        found = suffix_arrays(np.frombuffer(b"#####" + b"".join(texts) + b"##", np.uint8), offs)
        assert [[p - a for p in found[a - 5 : b - 5].tolist()] for a, b in zip(offs.tolist(), offs[1:].tolist(), strict=False)] == [suffix_array(x) for x in texts]


@pytest.mark.parametrize("compared", [4096, 3])
def test_groups_of_runs_are_sorted_side_by_side(monkeypatch, compared):
    """Many small groups and a large one: the small ones take no sort of their own, one suffix after the other; groups hold repeats apart."""
    r = random.Random(7)
    alone, kinds = [], []
    monkeypatch.setattr(repeats, "COMPARED", compared, raising=False)
    monkeypatch.setattr(repeats, "suffix_array", lambda x: alone.append(len(x)) or suffix_array(x))
    common = r.randbytes(40)
    for m in range(120):
        for _ in range(60 if m == 50 else 2):
            kinds.append((m, r.randbytes(r.randint(1, 15)) + common[: r.randint(10, 40)] + r.choice([b"", b"x", common])))
    rows = [(m, i % 7, i, 100 * i, x) for i, (m, x) in enumerate(kinds)]
    schema = pa.schema({"m": pa.int64(), "did": pa.int64(), "th": pa.int64(), "start": pa.int64(), "bytes": pa.binary()})
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in part], schema) for part in (rows[:100], rows[100:103], rows[103:])]
    found = Counter((x["did"], x["th"], s) for b in repeats.sorted_groups(30)(iter(batches)) for x in b.to_pylist() for s in range(x["start"], x["start"] + x["n"]))
    seen = Counter((m, x[i : i + 30]) for m, x in kinds for i in range(len(x) - 29))
    assert found == Counter((d, th, start + i) for m, d, th, start, x in rows for i in range(len(x) - 29) if seen[m, x[i : i + 30]] > 1)
    assert found and sum(alone) <= sum(len(x) for m, x in kinds if m == 50)


def brute_repeats(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(x[i : i + length] for _, x in texts for i in range(len(x) - length + 1))
    out = Counter()
    for d, x in texts:
        keep = bytearray(b"\1") * len(x)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                keep[i : i + length] = bytes(length)
        runs = sum(not keep[i] and (i == 0 or keep[i - 1]) for i in range(len(x)))
        left = bytes(b for b, k in zip(x, keep, strict=True) if k)
        out[(d, len(x), len(x) - sum(keep), runs, hashlib.sha256(left).hexdigest())] += 1
    return out


@pytest.mark.parametrize("crowd", [512, 2])
def test_repeats(spark, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "BUFFER", 2000)
    rows = [(r[0], r[1]) for r in odd_documents(4)]
    out = repeats.remove_repeats(frame(spark, seed=4)).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, out)) == brute_repeats(rows, 200)


def test_repeats_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(scan, "PIECE", 1500)
    rows = [(r[0], r[1]) for r in odd_documents(5, 20)]
    runs = repeats.start_runs(60, 20)
    batch = pa.RecordBatch.from_pydict({"did": [r[0] or 0 for r in rows], "th": list(range(len(rows))), "text": [r[1] for r in rows]})
    starts = defaultdict(set)
    for b in runs(iter([batch])):
        for th, pos in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            s, n = pos >> 12, (pos >> 1 & 2047) + 1
            assert not starts[th] & set(range(s, s + n))
            starts[th] |= set(range(s, s + n))
    assert all(starts[i] == set(range(max(0, len((t or "").encode()) - 59))) for i, (_, t) in enumerate(rows))


def brute_windows(rows, window):
    """Rows equal in id and text are one document; of other rows with one id, the hash of the text tells the order."""
    seen, out = set(), {}
    for key, text in rows:
        w = (text or "").encode().split()
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in seen:
                keep[i : i + window] = [False] * window
            seen.add(x)
        left = b" ".join(a for a, k in zip(w, keep, strict=True) if k)
        out[key] = (len(w), len(w) - sum(keep), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("n_batches", [1, 2, 5])
def test_substrings(spark, n_batches):
    docs = frame(spark, seed=6)
    rows = docs.select("doc_id", "text", F.hash("text")).distinct().collect()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    want = brute_windows([((d, t), t) for d, t, _ in rows], 20)
    texts = Counter((d, t) for d, t, *_ in odd_documents(6))
    out = remove_earlier_windows(docs, n_batches=n_batches, fanout=2).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, out)) == Counter({(k[0], *want[k]): 0 for k in texts}) + sum((Counter({(k[0], *want[k]): n}) for k, n in texts.items()), Counter())


def test_index_compacts(spark):
    index = FingerprintIndex(fanout=2)
    for part in batches_of(frame(spark, seed=6), 5):
        index.add(part)
    assert len(index.runs) < 5
    assert len({level for level, _ in index.runs}) == len(index.runs)
    index.close()


LATER = """
import sys
from pyspark.sql import SparkSession
from glossa.llm.substrings import remove_earlier_windows
shared, docs, index, out = sys.argv[1:]
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "7").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", shared).getOrCreate()
remove_earlier_windows(spark.read.parquet(docs), n_batches=2, path=index).write.parquet(out)
"""


def test_a_later_session_goes_on(spark, tmp_path):
    """The index lasts: a second program, with other settings, finds what the first one added."""
    import subprocess
    import sys
    from pathlib import Path

    docs = frame(spark, seed=6).where("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    cut = sorted(r.doc_id for r in docs.collect())[docs.count() * 2 // 3]
    index = f"file://{tmp_path}/index"
    first = remove_earlier_windows(docs.where(F.col("doc_id") < cut), n_batches=2, path=index).collect()
    docs.where(F.col("doc_id") >= cut).write.parquet(str(tmp_path / "later"))
    program = tmp_path / "later.py"
    program.write_text(LATER)
    root = str(Path(__file__).resolve().parents[2])
    subprocess.run([sys.executable, str(program), f"file://{tmp_path}/shared", str(tmp_path / "later"), index, str(tmp_path / "out")], check=True, cwd=tmp_path, env={**__import__("os").environ, "PYTHONPATH": root}, timeout=300)
    got = [*first, *spark.read.parquet(str(tmp_path / "out")).collect()]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = brute_windows(rows, 20)
    assert {(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got} == {(k, *v) for k, v in want.items()} and len(got) == len(want)
    again = FingerprintIndex(path=index, spark=spark)
    assert again.version == 4 and {level for level, _ in again.runs} == {2}
    again.close()


def test_a_batch_reads_no_earlier_texts_and_shuffles_no_run(spark):
    import contextlib
    import io

    index, plans = FingerprintIndex(fanout=9, spark=spark), []
    parts = batches_of(frame(spark, seed=6), 3)
    index.add(parts[0])
    index.add(parts[1])
    real = index.table

    def seen(path, rows=None, deal=False):
        if rows is not None and not deal:
            out = io.StringIO()
            with contextlib.redirect_stdout(out):
                rows.explain("simple")
            plans.append(out.getvalue())
        return real(path, rows, deal)

    index.table, index.fanout = seen, 2
    index.compact()
    assert plans and all("Exchange" not in p for p in plans)
    index.close()
