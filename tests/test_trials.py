"""The decoder's trials against the plain search over all of them."""

import random

import numpy as np
import pytest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators import alignment, em_blocks, language_model, trials

EXACT = 1e-9


def plain_decode(source: DataFrame, model: DataFrame, uni: DataFrame, bi: DataFrame, n: int, k: int = 5, seed: int = 0) -> DataFrame:
    """Every trial as rows, each scored by joins."""
    per_pos = alignment.candidates(source, model, k).groupBy("sid", "pos", "f").agg(F.sort_array(F.collect_list(F.struct("rank", "e", "p"))).alias("c"))
    tried = per_pos.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n))))
    pick = F.when(F.col("trial") == 0, 0).otherwise(F.pmod(F.xxhash64(F.lit(seed), "sid", "trial", "pos"), F.size("c")))
    tried = tried.select("sid", "trial", "pos", F.get("c", pick.cast("int")).alias("x"))
    tried = tried.withColumn("inner", (F.col("pos") > 0) & (F.col("pos") < F.max("pos").over(Window.partitionBy("sid", "trial"))))
    key = F.when(F.col("trial") == 0, F.col("pos").cast("long")).otherwise(F.xxhash64(F.lit(seed + 1), "sid", "trial", "pos"))
    order = Window.partitionBy("sid", "trial").orderBy(F.when(F.col("inner"), 1).when(F.col("pos") == 0, 0).otherwise(2), F.when(F.col("inner"), key).otherwise(F.col("pos").cast("long")))
    seq = tried.withColumn("at", F.row_number().over(order) - 1).select("sid", "trial", "at", F.col("x.e").alias("w"), F.col("x.p").alias("p"))
    return alignment.sequence_scores(seq, uni, bi, ["sid", "trial"])


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    model = spark.createDataFrame([(f"e{i}", f"f{j}", r.random()) for i in range(8) for j in range(6) if r.random() < 0.8], "e string, f string, p double")
    sents = spark.createDataFrame([([r.choice("eee") + str(r.randrange(8)) for _ in range(r.randint(0, 7))],) for _ in range(40)], "toks array<string>")
    items = [(f"s{i}", pos, r.choice(["f0", "f1", "f2", "f3", "f4", "f5", "new"] if i % 3 else ["f0", "f1"])) for i in range(40) for pos in range(1 + i % 9)]
    return spark.createDataFrame([*items, (None, 0, "f1"), (None, 1, "f2"), ("later", 3, "f1"), ("later", 7, "f2"), ("later", 5, "f3")], "sid string, pos int, f string"), model, language_model.unigrams(sents), language_model.bigrams(sents)


@pytest.mark.parametrize(("n", "seed"), [(128, 0), (9, 4), (0, 0)])
def test_decode_equals_the_plain_search(tables, n, seed):
    rows = {(r.sid, r.trial): r for r in plain_decode(*tables, n, seed=seed).collect()}
    best = {}
    for (sid, trial), r in sorted(rows.items(), key=lambda x: x[0][1]):
        if sid not in best or r.score > best[sid] + EXACT:
            best[sid] = r.score
    got = alignment.decode(*tables, trials=n, seed=seed).collect()
    assert len(got) == len(best) == len({r.sid for r in got})
    for r in got:
        same = rows[r.sid, r.trial]
        assert r.words == same.words and (r.score == same.score or abs(r.score - same.score) < EXACT) and (r.score == best[r.sid] or abs(r.score - best[r.sid]) < EXACT)
        assert r.score > float("-inf") or r.trial == 0
    if n > 100:
        assert any(r.trial > 0 for r in got) and any(r.score == float("-inf") and r.trial == 0 for r in got)


def test_trials_with_unknown_bigrams_are_not_scored(spark, tables, monkeypatch):
    seen = []
    monkeypatch.setattr(alignment, "sequence_scores", lambda words, *more, real=alignment.sequence_scores: seen.append(words.count()) or real(words, *more))
    _, model, uni, bi = tables
    long = spark.createDataFrame([(s, pos, "f0") for s in range(5) for pos in range(60)], "sid long, pos int, f string")
    out = alignment.decode(long, model, uni, bi.where("w1 = 'e1' and w2 = 'e2'")).collect()
    assert [(r.trial, r.score, len(r.words)) for r in out] == [(0, float("-inf"), 60)] * 5
    assert seen[0] < 60  # 38,700 when every trial is rows


def test_hashes_are_those_of_the_columns(spark):
    rows = spark.range(50).select(F.xxhash64(F.lit(7), F.col("id").cast("string")).alias("h"), F.xxhash64(F.lit(7), F.col("id").cast("string"), (F.col("id") * 3).cast("int"), F.lit(128)).alias("all")).toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    assert (trials.mixed(trials.mixed(h, np.arange(50) * 3), np.array(128)).view(np.int64) == rows.column("all").to_numpy()).all()


@pytest.mark.parametrize("n", [3, 700_000])
def test_filter_knows_every_bigram(spark, monkeypatch, n):
    monkeypatch.setattr(trials, "SLICE", 1 << 10 if n < 10 else 1 << 23)
    bi = spark.range(n).select(F.concat(F.lit("a"), "id").alias("w1"), F.lit("b").alias("w2"))
    known = trials.bigram_filter(bi, n)

    def share(word: str) -> float:
        h = [c.to_numpy().view(np.uint64) for c in spark.range(2000).select(F.xxhash64(F.concat(F.lit(word), "id")).alias("x"), F.xxhash64(F.lit("b")).alias("y")).toArrow().columns]
        bits = [known[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1 for b in trials.places(*h, 8 * len(known))]
        return (bits[0] & bits[1])[:n].mean()

    assert share("a") == 1.0 and (n < 10 or share("z") < 0.05)


@pytest.mark.parametrize("part", [1 << 20, 1])
def test_strongest_are_those_of_the_whole_model(spark, monkeypatch, part):
    monkeypatch.setattr(em_blocks, "PART", part)
    r = random.Random(8)
    pairs = spark.createDataFrame([(str(i), [r.choice("abcdefgh") for _ in range(r.randint(0, 5))], [r.choice("uvwxyz") for _ in range(r.randint(0, 5))]) for i in range(12)], "pid string, e_toks array<string>, f_toks array<string>")
    for steps, whole in ((0, alignment.initial(alignment.cooccurrence(pairs))), (1, alignment.train(pairs, 1, markers=False))):
        want = {(x.f, x.e): x.p for x in alignment.best_of(whole.withColumn("p", F.round("p", 9)), 3).collect()}
        got = {(x.f, x.e): x.p for x in alignment.strongest(pairs, steps, 3).collect()}
        assert sorted(f for f, _ in got) == sorted(f for f, _ in want)
        assert steps or got.keys() == want.keys()
        for f in {f for f, _ in got}:
            assert np.allclose(*(sorted(p for (g, _), p in x.items() if g == f) for x in (got, want)), atol=2e-9)
