"""Literal fixtures, brute force and properties of the text and speech operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.functions import comments, guards, text
from glossa.operators import alignment, classifiers, evaluation, features, language_model, mixtures, statistics
from glossa.plans import registry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Hello, world... what?!ok don't ('quote')", "Hello ,  world ...  what ?! ok don't  ('quote')"), ("a-b", "a - b"), ("x!''y", "x !''y"), ("", "")],
)
def test_punctuation(spark, raw, want):
    assert one(spark, text.split_punctuation(F.lit(raw))) == want


def test_punctuation_with_abbreviations(spark):
    cases = {
        "see e.g. this, or etc. and more.": "see e.g. this ,  or etc. and more .",
        "ok e.g.": "ok e.g.",
        "a,b e.g.x y": "a , b e.g.x y",
        "no abbreviations; here!": "no abbreviations ;  here !",
        "e.g., so etc.e.g.!": "e.g.,  so etc.e.g.!",
        "(e.g.)": " (e.g.)",
        "": "",
    }
    rows = spark.createDataFrame([(c,) for c in cases], "s string").select(text.split_punctuation(F.col("s"), ("e.g.", "etc.")).alias("x")).collect()
    assert [r.x for r in rows] == list(cases.values())


def test_normalisers(spark):
    assert one(spark, text.remove_newlines(F.lit("  a\nb\t "))) == "a b"
    assert one(spark, text.remove_urls(F.lit("x http://a.b/c?d=%20 y www.z.com"))) == "x   y www.z.com"
    for raw, want in (("dogs' bark", "dogs 'bark"), ("I can't go, they've left", "I ca n't go, they 've left"), ("cats'd x 't was", "cats 'd x 't was"), ("and t'other y'all", "and t' other y' all"), ("DOGS'  RAN WE'LL\x1cGO", "DOGS 'RAN WE 'LL GO")):
        assert one(spark, comments.split_clitics(F.lit(raw))) == want
    assert one(spark, text.remove_newlines(F.lit("\x1c a\nb \x1f"))) == "a b" and one(spark, text.tokens(F.lit("a\x1cb\x1d c"))) == ["a", "b", "c"]
    assert comments.ascii_text("caf&eacute; über &lt;b&gt;") == "cafe uber <b>"
    assert one(spark, text.split_french_contractions(F.lit("l'homme qu'il"))) == " l' homme  qu' il"
    assert one(spark, text.split_french_contractions(F.lit("aujourd'hui d'abord lorsqu'on él'a"))) == "aujourd'hui d'abord  lorsqu' on él'a"
    assert one(spark, text.normalise_sentence(F.lit("  The cat, sat! "))) == "SENTSTART the cat ,  sat !  SENTEND"
    assert one(spark, text.normalise_transcript(F.lit("Hello, [noise] World's"))) == ["hello", "[noise]", "world", "s"]
    assert one(spark, text.single_space_tokens(F.lit(""))) == [""]
    assert one(spark, text.tokens(F.lit(" a b\t"))) == ["a", "b"]
    assert one(spark, text.ngrams(F.array(F.lit("a")), 2)) == []
    assert one(spark, text.ngrams(F.array(*map(F.lit, "abc")), 2)) == [["a", "b"], ["b", "c"]]
    assert one(spark, text.without_markers(F.array(*map(F.lit, "abc")))) == ["b"]
    assert tuple(one(spark, text.tagged_token(F.lit("and/or/CC")))) == ("and/or", "CC")
    assert tuple(one(spark, text.tagged_token(F.lit("x")))) == ("x", None)


def test_preprocess_steps(spark):
    df = spark.createDataFrame([("The dogs were barking loudly. I\nwill go!",), ("",), (None,)], "s string")
    out = [r.x for r in df.select(comments.preprocess(F.col("s"), stopwords=("the",), abbreviations=("e.g.",)).alias("x")).collect()]
    assert out[0] == "dog/NNS be/VBD barking/VBG loudly/RB ./.\ni/PRP will/MD go/NN !/.\n" and out[1] == "" and out[2] is None
    assert [r.x for r in df.select(comments.preprocess(F.col("s"), ()).alias("x")).collect()] == ["", "", None]
    assert df.select(comments.preprocess(F.col("s"), (10,)).alias("x")).first().x == "the dogs were barking loudly. i will go!"


def test_guards(spark):
    assert one(spark, guards.safe_log2(F.lit(0.0))) == -math.inf and one(spark, guards.safe_log2(F.lit(8.0))) == 3
    assert one(spark, guards.nan_low(F.lit(float("nan")))) == -math.inf
    assert math.isnan(one(spark, guards.ratio_or_nan(F.lit(0), F.lit(0)))) and one(spark, guards.safe_div(F.lit(1), F.lit(0))) is None
    assert one(spark, guards.log_sum_exp(F.array(F.lit(-math.inf), F.lit(-math.inf)))) == -math.inf
    assert abs(one(spark, guards.log_sum_exp(F.array(F.lit(-1000.0), F.lit(-1000.0)))) - (-1000 + math.log(2))) < 1e-9


def test_language_model(spark):
    def sents(rows):
        return spark.createDataFrame(list(enumerate(rows)), "sid long, s string").select("sid", text.tokens(text.normalise_sentence(F.col("s"))).alias("toks"))

    train, test = sents(["The cat sat.", "The dog sat.", "A cat ran, fast!"]), sents(["The cat ran.", "The cat sat.", "Zebra sat."])
    assert language_model.unigrams(train).count() == 12 and language_model.bigrams(train).count() == 14
    s = language_model.sentence_scores(test, train, (0.0, 0.1, 1.0))
    got = {(r.delta, r.sid): r.logprob for r in s.collect()}
    assert got[0.0, 0] == got[0.0, 2] == -math.inf
    want = {(0.0, 1): -2.584963, (0.1, 0): -9.148251, (0.1, 1): -5.296502, (0.1, 2): -10.192645, (1.0, 0): -13.859470, (1.0, 1): -12.381423, (1.0, 2): -11.936638}
    assert all(abs(got[k] - v) < 1e-5 for k, v in want.items())
    p = {r.delta: (r.tokens, r.perplexity) for r in language_model.perplexity(s).collect()}
    assert all(p[d][0] == n and abs(p[d][1] - x) < 1e-5 for d, n, x in ((0.0, 6, 1.348006), (0.1, 17, 2.730677), (1.0, 17, 4.742794)))
    nothing = language_model.perplexity(language_model.sentence_scores(test.where("sid = 0"), train, (0.0,))).first()
    assert nothing.tokens == 0 and nothing.perplexity == 0


def test_ibm1(spark):
    rows = [("1", "the house", "la maison"), ("2", "the the blue house", "la maison bleue bleue"), ("3", "blue", "bleue")]
    pairs = spark.createDataFrame(rows, "pid string, e string, f string").select("pid", F.split("e", " ").alias("e_toks"), F.split("f", " ").alias("f_toks"))
    cooc = alignment.cooccurrence(pairs)
    first = alignment.initial(cooc)
    assert {round(r.p, 6) for r in first.collect()} == {0.333333}
    want = {"blue": (0.666667, 0.166667, 0.166667), "house": (0.166667, 0.416667, 0.416667), "the": (0.222222, 0.388889, 0.388889)}
    got = {(r.e, r.f): round(r.p, 6) for r in alignment.em_step(cooc, first).collect()}
    assert all(got[e, f] == p for e, ps in want.items() for f, p in zip(("bleue", "la", "maison"), ps, strict=True))
    model = alignment.train(pairs, 2)
    assert model.where("e = 'SENTSTART' and p = 1").count() == 1 and model.count() == 11
    source = spark.createDataFrame([(1, 0, "la"), (1, 1, "maison"), (1, 2, "zzz")], "sid long, pos int, f string")
    c = {(r.pos, r["rank"]): (r.e, round(r.p, 3)) for r in alignment.candidates(source, model).collect()}
    assert c[2, 1] == ("UNK", 0.01) and c[1, 1][0] == "house"
    sents = pairs.select(F.col("e_toks").alias("toks"))
    best = alignment.decode(source.where("pos < 2"), model, language_model.unigrams(sents), language_model.bigrams(sents)).first()
    assert best.words[0] == "the" and math.isfinite(best.score)


def test_bleu(spark):
    c, r1, r2 = (F.array(*map(F.lit, s.split())) for s in ("SENTSTART the the cat sat SENTEND", "SENTSTART the cat sat down SENTEND", "SENTSTART a cat sat SENTEND"))
    assert [one(spark, evaluation.ngram_precision(c, [r1, r2], n)) for n in (1, 2, 3)] == [1.0, 0.8, 0.5]
    assert one(spark, evaluation.brevity_penalty(c, [r1, r2])) == 1.0
    assert [round(one(spark, evaluation.bleu(c, [r1, r2], n)), 6) for n in (1, 2, 3)] == [1.0, 0.894427, 0.736806]
    assert one(spark, evaluation.bleu(F.array(F.lit("x")), [r1], 2)) is None and one(spark, evaluation.bleu(F.array(F.lit("x"), F.lit("y")), [r1], 1)) == 0


def brute_edit(r, h):
    best = {(0, 0): (0, 0, 0, 0)}
    for i in range(len(r) + 1):
        for j in range(len(h) + 1):
            if i or j:
                c = []
                if i:
                    n, s, a, d = best[i - 1, j]
                    c.append((n + 1, 0, (s, a, d + 1)))
                if j:
                    n, s, a, d = best[i, j - 1]
                    c.append((n + 1, 1, (s, a + 1, d)))
                if i and j:
                    n, s, a, d = best[i - 1, j - 1]
                    w = r[i - 1] != h[j - 1]
                    c.append((n + w, 2, (s + w, a, d)))
                n, _, x = min(c)
                best[i, j] = (n, *x)
    return best[len(r), len(h)][1:]


def test_word_errors(spark):
    cases = [("who is there", "is there", 1 / 3, 0, 0, 1), ("who is there", "", 1.0, 0, 0, 3), ("", "who is there", math.inf, 0, 3, 0), ("", "", math.inf, 0, 0, 0), ("a b c d", "a x c d e", 0.5, 1, 1, 0), ("a b", "b a", 1.0, 0, 1, 1), ("a b a", "b a b", 2 / 3, 0, 1, 1)]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "k long, r string, h string").select("k", text.tokens(F.col("r")).alias("ref"), text.tokens(F.col("h")).alias("hyp"))
    for r in evaluation.word_errors(df, ["k"]).collect():
        *_, wer, s, i, d = cases[r.k]
        assert (r.s, r.i, r.d) == (s, i, d) and (r.wer == wer or abs(r.wer - wer) < 1e-9)
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        assert evaluation.edit_counts(a, b) == brute_edit(a, b)
    x, y = (F.array(*map(F.lit, s.split())) for s in ("a b c d", "a x c d e"))
    assert one(spark, evaluation.edit_distance_expression(x, y)) == 2


def test_features(spark):
    body = "I/PRP am/VBP going/VBG to/TO go/VB ,/, lol/NN !!/. ABC/NNP\nsmh/NN you/PRP they/PRP will/MD\n"
    row = spark.createDataFrame([(body,)], "body string").select(features.native_features().alias("f")).select("f.*").first()
    assert (row.f01_first_person, row.f02_second_person, row.f03_third_person, row.f06_future_verbs, row.f07_commas, row.f08_multi_punctuation, row.f13_slang, row.f14_upper_case, row.f17_sentences) == (1, 1, 1, 1, 1, 1, 1, 1, 3)
    loose = spark.createDataFrame([(body,)], "body string").select(features.native_features(strict=False).alias("f")).select("f.*").first()
    assert loose.f06_future_verbs == 2
    toks = spark.createDataFrame([(1, "Cat"), (1, "dog"), (1, "cat"), (2, "zzz")], "id long, word string")
    lex = spark.createDataFrame([("cat", "1", ""), ("dog", "4", "2")], "word string, v string, a string")
    got = {r.id: r.asDict() for r in features.lexicon_stats(toks, lex, ("v", "a")).collect()}
    assert got[1]["mean_v"] == 2 and abs(got[1]["std_v"] - math.sqrt(2)) < 1e-12 and got[1]["mean_a"] == 2 and 2 not in got
    assert features.lexicon_stats(toks, lex, ("v",), fold=False).first().mean_v == 2.5
    comments_ = spark.createDataFrame([(1, body, "Alt")], "id long, body string, cat string")
    rows = features.feature_rows(comments_, lex.select("word", F.col("v").alias("aoa"), F.col("a").alias("img"), F.col("a").alias("fam")), lex.select("word", "v", "a", F.col("a").alias("d")))
    full = features.with_external(rows, spark.createDataFrame([(1, [0.5] * 144)], "id long, feats array<double>")).first()
    assert len(full.features) == 173 and full.label == 3
    with pytest.raises(Exception, match="no external features"):
        features.with_external(rows, spark.createDataFrame([], "id long, feats array<double>")).collect()


def test_statistics(spark):
    rows = spark.createDataFrame([(i,) for i in range(3)], "id long")
    assert [r.id for r in statistics.circular_sample(rows, ["id"], 5, 5).orderBy("place").collect()] == [2, 0, 1, 2, 0]
    assert statistics.circular_sample(rows.limit(0), ["id"], 5, 5).count() == 0
    with pytest.raises(ValueError):
        statistics.check_sample_size(200_273)
    f, t = statistics.f_tail(F.lit(4.0), F.lit(2.0), F.lit(20.0)), statistics.t_tails(F.lit(2.776445), F.lit(4.0))
    tails = spark.range(1).select(f.alias("f"), t.alias("t")).first()
    assert abs(tails.f - 1.4**-10) < 1e-12 and abs(tails.t - 0.05) < 1e-6
    data = spark.createDataFrame([(i, i % 2, [float(i % 2) + i * 0.01, 1.0]) for i in range(20)], "id long, label int, features array<double>")
    a = {r.feature: (r.f, r.p) for r in statistics.anova(data).collect()}
    assert a[0][1] < 1e-10 and math.isnan(a[1][0]) and math.isnan(a[1][1])
    scores = spark.createDataFrame([("m", 0.5, 0.6), ("m", 0.52, 0.61), ("m", 0.49, 0.6)], "g string, a double, b double")
    t = statistics.paired_t(scores, "g", "a", "b").first()
    assert t.df == 2 and abs(t.t + 17.32) < 0.01 and 0.003 < t.p < 0.0035
    f = statistics.folds(spark.range(1000), "id")
    assert sorted(map(tuple, f.collect())) == sorted(map(tuple, statistics.folds(spark.range(1000).repartition(7), "id").collect()))
    m = evaluation.class_metrics(evaluation.confusion(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, pred int")))
    got = {r.label: (r.recall, r.precision, r.accuracy) for r in m.collect()}
    assert got[0] == (0.5, 1.0, 0.5) and got[1] == (1.0, 1 / 3, 0.5) and got[2][0] == 0 and math.isnan(got[2][1])


def test_classifiers(spark):
    r = np.random.default_rng(1)
    rows = [(i, i % 3, [float(x) for x in r.normal(0, 0.4, 4) + (i % 3)]) for i in range(150)]
    data = spark.createDataFrame(rows, "id long, label int, features array<double>")
    train, test = data.where("id < 110"), data.where("id >= 110")
    fits = {"linear_svm": classifiers.linear_svm(3), "rbf_svm": classifiers.rbf_svm(0.3, 64, rounds=3), "random_forest": classifiers.random_forest(), "perceptron": classifiers.perceptron(8, max_iter=40), "ada_boost": classifiers.ada_boost(6)}
    assert set(fits) == set(classifiers.CLASSIFIERS)
    for name, fit in fits.items():
        assert classifiers.accuracy(fit(train)(test)) > (0.85 if "svm" in name else 0.6), name
    again = [sorted(map(tuple, classifiers.linear_svm(2)(part)(test).collect())) for part in (train, train.repartition(7))]
    assert again[0] == again[1]
    assert classifiers.top_features(train, 2) and len(classifiers.with_features(train, [1, 3]).first().features) == 2


def test_experiments(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, i % 2, [float(x) for x in r.normal(0, 0.5, 3) + (i % 2)]) for i in range(90)]
    data = spark.createDataFrame(rows, "id long, label int, features array<double>")
    monkeypatch.setattr(classifiers, "CLASSIFIERS", {"linear_svm": lambda: classifiers.linear_svm(1), "random_forest": lambda: classifiers.random_forest(2, 2)})
    out = classifiers.experiments(data.where("id < 60"), data.where("id >= 60"), sizes=(20, 60), ks=(1, 2), k=2)
    first = out["classifiers"].orderBy("idx").collect()
    assert [(x.idx, x.classifier) for x in first] == [(1, "linear_svm"), (2, "random_forest")]
    assert all(len(x.recall) == len(x.precision) == 2 and sum(x.confusion) == 30 and abs(x.accuracy - (x.confusion[0] + x.confusion[3]) / 30) < 1e-12 for x in first)
    curve = out["learning_curve"].orderBy("size").collect()
    assert [x.size for x in curve] == [20, 60] and curve[0].gain is None and curve[1].gain == curve[1].accuracy - curve[0].accuracy
    chosen = out["feature_selection"].collect()
    assert [(x.size, x.k, len(x.chosen)) for x in chosen] == [(1000, 1, 1), (1000, 2, 2), (None, 1, 1), (None, 2, 2)] and all(0 <= x.mean_p <= 1 for x in chosen)
    assert out["folds"].count() == 4 and out["paired_tests"].count() == 1
    ties = spark.createDataFrame([(1, "b", 0.5), (2, "a", 0.5)], "idx int, classifier string, accuracy double")
    assert classifiers.best_classifier(ties) == "b"


def test_statistics_at_any_scale(spark):
    r = np.random.default_rng(3)
    x = [float(v) for v in r.normal(0, 1, 40)]
    data = spark.createDataFrame([(i % 2, [v + i % 2, (v + i % 2) * 1e-8, (v + i % 2) * 1e8, 3e-9]) for i, v in enumerate(x)], "label int, features array<double>")
    f = {a.feature: a.f for a in statistics.anova(data).collect()}
    assert all(abs(f[k] / f[0] - 1) < 1e-6 for k in (1, 2)) and math.isnan(f[3])
    t = {a.g: (a.t, a.p) for a in statistics.paired_t(spark.createDataFrame([("up", 1.0, 0.75), ("up", 2.0, 1.75), ("none", 1.0, 1.0), ("none", 2.0, 2.0), ("down", 0.0, 1.0), ("down", 1.0, 2.0)], "g string, a double, b double"), "g", "a", "b").collect()}
    assert t["up"] == (math.inf, 0.0) and t["down"] == (-math.inf, 0.0) and all(map(math.isnan, t["none"]))


def test_mixtures(spark):
    rows = [(1, "s", [0.0, 0.0]), (2, "s", [1.0, 0.0]), (3, "s", [2.0, 1.0])]
    frames = spark.createDataFrame(rows, "id long, speaker string, x array<double>")
    model = spark.createDataFrame([("s", 0, 0.4, [0.0, 0.0], [1.0, 1.0]), ("s", 1, 0.6, [1.0, 1.0], [0.5, 2.0])], mixtures.MODEL)
    resp = mixtures.responsibilities(frames, model)
    b = {(r.id, r.m): r.logb for r in resp.collect()}
    want = [[-1.837877, -3.087877], [-2.337877, -2.087877], [-4.337877, -2.837877]]
    assert all(abs(b[i + 1, m] - v) < 1e-5 for i, row in enumerate(want) for m, v in enumerate(row))
    assert abs(sum({r.id: r.loglik for r in resp.collect()}.values()) + 7.787207) < 1e-5
    new = {r.m: r for r in mixtures.m_step(resp).collect()}
    assert abs(new[0].w - 0.390223) < 1e-5 and abs(new[1].mu[0] - 1.311550) < 1e-5 and abs(new[0]["var"][1] - 0.098378) < 1e-5
    empty = spark.createDataFrame(mixtures.empty_models(iter(["z"]), 2, 2), mixtures.MODEL)
    tests = frames.select(F.col("speaker").alias("truth"), F.col("id").alias("utt"), "x")
    out = mixtures.identify(tests, model.unionByName(empty), 2).orderBy("utt", "rank").collect()
    assert [r.speaker for r in out] == ["s", "z"] * 3 and all(r.loglik == -math.inf for r in out if r.speaker == "z")
    r = np.random.default_rng(2)
    many = spark.createDataFrame([(f"s{i % 2}", [float(v) for v in r.normal(4 * (i % 2), 1, 3)]) for i in range(200)], "speaker string, x array<double>")
    trained = mixtures.train(many, m=2, max_iter=5, var_floor=1e-3)
    assert {round(x.w, 6) for x in trained.groupBy("speaker").agg(F.sum("w").alias("w")).collect()} == {1.0}
    got = mixtures.identify(many.select(F.col("speaker").alias("truth"), F.monotonically_increasing_id().alias("utt"), "x"), trained, 1)
    assert got.agg(F.avg(F.col("correct").cast("double"))).first()[0] > 0.95
    whole = mixtures.open_set(trained, many.select("speaker"), 1)
    assert {(x.speaker, x.w > 0) for x in whole.collect()} == {("s0", True), ("s1", False)}
    swept = mixtures.sweep(many.withColumn("utt", F.monotonically_increasing_id() % 5), "utt", (1,), (), (1,), m=1, max_iter=1, var_floor=1e-3).collect()
    assert [(x.m, x.max_iter, x.trained, x.utterances) for x in swept] == [(1, 1, None, 2), (1, 1, 1, 2)] and swept[0].accuracy == 1 and swept[1].accuracy == 0.5
    assert mixtures.hold_out(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "speaker string, id long"), "id").where("test").count() == 2


def test_mixtures_of_equal_frames(spark):
    """Equal frames of an utterance count each; no key is needed to tell frames apart."""
    model = spark.createDataFrame([("s", 0, 0.4, [0.0], [1.0]), ("s", 1, 0.6, [1.0], [0.5])], mixtures.MODEL)
    tests = spark.createDataFrame([("s", 1, [0.5])] * 3 + [("s", 2, [0.5])], "truth string, utt long, x array<double>")
    ll = {r.utt: r.loglik for r in mixtures.identify(tests, model).collect()}
    assert abs(ll[1] - 3 * ll[2]) < 1e-9
    resp = mixtures.responsibilities(tests.select(F.col("truth").alias("speaker"), "x"), model).collect()
    assert len(resp) == 8 and all(abs(r.loglik - ll[2]) < 1e-9 for r in resp)


def test_mixtures_in_steps(spark):
    r = np.random.default_rng(4)
    data = {s: r.normal(3 * (np.arange(60) % 2)[:, None] + s, 1, (60, 2)) for s in range(2)}
    rows = [(i, str(s), [float(v) for v in x]) for s, xs in data.items() for i, x in enumerate(xs)]
    frames = spark.createDataFrame(rows, "id long, speaker string, x array<double>")
    first = mixtures.initial_model(frames, "id", 2)
    start = {(x.speaker, x.m): x for x in first.collect()}
    assert {round(sum(start[s, m].w for m in range(2)), 9) for s in "01"} == {1.0} and all(0 < v <= 1 for x in start.values() for v in x["var"])
    got = {(x.speaker, x.m): x for x in mixtures.train_in_steps(frames, first, 3, var_floor=1e-3).collect()}
    for s, x in data.items():
        w, mu, var = (np.array([start[str(s), m][c] for m in range(2)]) for c in ("w", "mu", "var"))
        for _ in range(4):
            joint = np.log(w) + mixtures.log_b(x, mu, var)
            p = np.exp(joint - np.logaddexp.reduce(joint, axis=1, keepdims=True))
            w, mu = p.mean(axis=0), (p.T @ x) / p.sum(axis=0)[:, None]
            var = np.maximum((p.T @ x**2) / p.sum(axis=0)[:, None] - mu**2, 1e-3)
        for m in range(2):
            assert np.allclose([got[str(s), m].w, *got[str(s), m].mu, *got[str(s), m]["var"]], [w[m], *mu[m], *var[m]])
    once = mixtures.train_in_steps(frames, first, 9, epsilon=math.inf).collect()
    assert len(once) == 4 and all(x.w == x.w for x in once)
    assert mixtures.train_in_steps(frames.limit(0), first.limit(0), 2).count() == 0
