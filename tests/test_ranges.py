"""Files read in ranges equal files read as a whole."""

import json
import random

import numpy as np
import pytest

from glossa.sources import ranges
from glossa.sources.ranges import escapes_next, marks, numbered_lines, opened, read_json_arrays, read_matrices

PARTS = ["a", '"', "\\", "[", "]", "{", "}", ",", "\n", "é", "\U0001f600", " ", ":", "\\\\", '\\"', "0"]


def element(r, depth=0):
    kind = r.randrange(6 if depth < 3 else 3)
    if kind < 2:
        return "".join(r.choice(PARTS) for _ in range(r.randint(0, 12)))
    if kind == 2:
        return r.choice([1, -2.5, None, True])
    if kind == 3:
        return [element(r, depth + 1) for _ in range(r.randint(0, 3))]
    if kind == 4:
        return {element(random.Random(i), 3) if False else f"k{i}\"[": element(r, depth + 1) for i in range(r.randint(0, 3))}
    return json.dumps({"id": "x", "body": element(r, 3)})


@pytest.mark.parametrize("size", [1 << 20, 64, 7])
def test_arrays_in_ranges_equal_whole_files(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(ranges, "PIECE", 50)  # also on the workers, which get the module's functions by reference
    r, want = random.Random(size), []
    for name, n in (("Left", 60), ("Right", 25), ("one", 1), ("none", 0)):
        rows = [element(r) for _ in range(n)]
        (tmp_path / name).write_text(json.dumps(rows, ensure_ascii=bool(r.randrange(2)), indent=r.choice([None, 1])) + r.choice(["", "\n "]), encoding="utf-8")
        want += [(name, i, x) for i, x in enumerate(rows)]
    (tmp_path / "empty").write_text("")
    out = sorted((x.file, x.pos, x.raw) for x in read_json_arrays(spark, str(tmp_path), size).collect())
    assert [(f, i, json.loads(x)) for f, i, x in out] == sorted(want, key=lambda x: x[:2])


def test_marks_continue_over_any_cut():
    r = random.Random(3)
    for _ in range(300):
        raw = json.dumps([element(r) for _ in range(3)]).encode()
        whole = marks(np.frombuffer(raw, np.uint8), False, False)
        cut = r.randrange(len(raw) + 1)
        a = marks(np.frombuffer(raw[:cut], np.uint8), False, False)
        b = marks(np.frombuffer(raw[cut:], np.uint8), a[3], a[2])
        depth = int(a[0][-1]) if cut else 0
        assert np.array_equal(np.concatenate([a[0], b[0] + depth]), whole[0]) and np.array_equal(np.concatenate([a[1], b[1]]), whole[1])
        assert b[2:] == whole[2:] == (False, False)


def test_backslashes_before_a_range(tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "PIECE", 3)
    (tmp_path / "f").write_bytes(b"ab" + b"\\" * 9 + b"c" + b"\\" * 2)
    with opened(str(tmp_path / "f")) as file:
        assert [escapes_next(file, at) for at in range(15)] == [False] * 3 + [True, False] * 4 + [True, False, True, False]


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_matrices_in_ranges(spark, tmp_path, size):
    r, want = np.random.default_rng(0), {}
    arrays = {"a": r.normal(size=(50, 3)), "b": np.asfortranarray(r.normal(size=(9, 4))), "c": np.arange(12), "d": r.integers(0, 9, (6, 2, 2)).astype(np.float32), "e": np.zeros((0, 3)), "f": r.normal(size=(5, 2)).astype(">f8")}
    for name, x in arrays.items():
        np.save(tmp_path / f"{name}.npy", x)
        np.savez(tmp_path / f"{name}.npz", x)
        np.savez_compressed(tmp_path / f"{name}z.npz", x)
        for file in (f"{name}.npy", f"{name}.npz", f"{name}z.npz"):
            want |= {(file, i): row for i, row in enumerate(x.reshape(len(x), int(np.prod(x.shape[1:]))).astype(float).tolist())}
    rows = read_matrices(spark, str(tmp_path), size=size).collect()
    assert {(x.path.rsplit("/", 1)[-1], x.row): x.features for x in rows} == want and len(rows) == len(want)


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(4000.0).reshape(1000, 4))
    plan = spark.createDataFrame([(str(tmp_path / "m.npy"),)], "path string").mapInPandas(ranges.plan_matrix(8000), "path string, offset long, first long, n long").collect()
    assert [(x["first"], x.n) for x in plan] == [(0, 250), (250, 250), (500, 250), (750, 250)]


@pytest.mark.parametrize("size", ["128m", "64", "16"])
def test_line_numbers(spark, tmp_path, size):
    r, want = random.Random(5), []
    for name in ("b c.e", "a.e", "d.f"):
        lines = ["".join(r.choice("ab \r\té") for _ in range(r.randint(0, 20))) for _ in range(40)]
        (tmp_path / name).write_bytes(("\n".join(lines) + r.choice(["", "\n"])).encode())
        lines = lines[:-1] if lines[-1] == "" and not (tmp_path / name).read_bytes().endswith(b"\n\n") else lines
        want += [(name, i, x) for i, x in enumerate(lines)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        out = numbered_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((x.path.rsplit("/", 1)[-1].replace("%20", " "), x.line_no, x.text) for x in out) == sorted(want)
