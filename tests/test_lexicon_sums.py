"""Lexicon statistics: words aren't shuffled, a lexicon of any size gives the same."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from glossa.operators import features


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(2)
    toks = [(r.choice([1, 2, 3, None]), r.choice(["Cat", "cat", "dog", "Dog", "x", None])) for _ in range(400)] + [(9, "none")]
    lex = [("cat", "130", "x"), ("dog", "100000001", "2"), ("Dog", "7", None), ("dog", "4", "3"), (None, "5", "5"), ("x", "n/a", "")]
    return spark.createDataFrame(toks, "id long, word string").repartition(3), spark.createDataFrame(lex, "word string, v string, a string"), toks, lex


@pytest.mark.parametrize("most", [0, 64 << 20])
def test_stats_of_two_lexicons(tables, monkeypatch, most):
    monkeypatch.setattr(features, "LEXICON_BYTES", most)
    toks, lex, rows, entries = tables
    other = lex.select("word", F.col("v").alias("u"))
    got = {r.id: r.asDict() for r in features.lexicons_stats(toks, [(lex, ("v", "a"), True), (other, ("u",), False)]).collect()}
    assert got.keys() == {1, 2, 3, None}
    for id_, g in got.items():
        for c, at, fold in (("v", 1, True), ("a", 2, True), ("u", 1, False)):
            values = [float(e[at]) for i, w in rows if i == id_ and w for e in entries if e[0] == (w.lower() if fold else w) and e[at] and e[at].isdigit()]
            assert math.isclose(g[f"mean_{c}"], statistics.fmean(values), rel_tol=1e-12) and math.isclose(g[f"std_{c}"], statistics.pstdev(values), rel_tol=1e-12)


def test_words_are_not_shuffled(tables):
    toks, lex, *_ = tables
    plan = features.lexicon_stats(toks, lex, ("v", "a"))._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(keys) == 1 and "hashpartitioning(id" in keys[0]  # before: one of (id, w), another of id
