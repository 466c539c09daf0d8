"""Utterances against very many models, in blocks, give what a broadcast gives."""

import contextlib
import io
import random

from glossa.operators import mixtures
from glossa.operators.mixtures import identify


def data(spark, models, utterances=7):
    r = random.Random(models)
    model = [(f"s{i}", m, 0.5, [r.gauss(i % 5, 1) for _ in range(3)], [0.5 + r.random()] * 3) for i in range(models) for m in range(2)]
    model += [("odd", m, 0.0, [0.0] * 3, [0.0] * 3) for m in range(2)]
    tests = [(f"s{u}", u, [r.gauss(u % 5, 1) for _ in range(3)]) for u in range(utterances) for _ in range(5)]
    return spark.createDataFrame(tests, "truth string, utt int, x array<double>"), spark.createDataFrame(model, "speaker string, m int, w double, mu array<double>, var array<double>")


def test_blocks_equal_the_broadcast(spark, monkeypatch):
    for k in (1, 3, 100):
        tests, model = data(spark, 40)
        whole = {(r.truth, r.utt, r.speaker, round(r.loglik, 9), r["rank"], r.correct) for r in identify(tests, model, k).collect()}
        monkeypatch.setattr(mixtures, "BLOCK_BYTES", 600)
        assert {(r.truth, r.utt, r.speaker, round(r.loglik, 9), r["rank"], r.correct) for r in identify(tests, model, k).collect()} == whole
        monkeypatch.undo()


def test_ten_thousand_models(spark, monkeypatch):
    tests, model = data(spark, 10_000)
    whole = {(r.truth, r.utt, r.speaker) for r in identify(tests, model).collect()}
    monkeypatch.setattr(mixtures, "BLOCK_BYTES", 200_000)
    out = identify(tests, model)
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        out.explain("simple")
    assert "Broadcast" not in said.getvalue() and "SortMergeJoin" in said.getvalue()
    assert {(r.truth, r.utt, r.speaker) for r in out.collect()} == whole and len(whole) == 7
