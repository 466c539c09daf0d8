"""Texts are held as Python objects a slice at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from glossa.functions import comments, text
from glossa.operators import tagging
from glossa.operators.tagging import Lemmatiser, learn_scripts


def test_a_batch_goes_in_slices(monkeypatch):
    monkeypatch.setattr(text, "SLICE_BYTES", 1000)
    column = pa.array(["x" * 300] * 50 + [None] + ["y" * 5000] + ["z"] * 200)
    seen = []
    out = text.by_slices(column, lambda some: seen.append(sum(len(x or "") for x in some)) or some, pa.string())
    assert out.equals(column) and max(seen) <= 5000 and len(seen) > 15
    assert text.by_slices(pa.array([], pa.string()), list, pa.string()).equals(pa.array([], pa.string()))


def test_a_tagger_meets_few_texts_at_once(spark):
    def tagger(texts):
        assert sum(map(len, texts)) < 500_000, "more than a slice"
        return comments.default_tagger(texts)

    rows = spark.range(4000).coalesce(1).select(F.when(F.col("id") != 7, F.repeat(F.lit("all cats "), 200)).alias("t"))
    out = rows.select(comments.preprocess(F.col("t"), tagger=tagger).alias("b"))
    assert out.agg(F.count("*"), F.count("b"), F.count_distinct("b")).first()[:] == (4000, 3999, 1)


def test_training_takes_slices():
    batch = pa.RecordBatch.from_pydict({"words": [["ab"] * 1000] * 2000, "tags": [["N"] * 1000] * 2000})
    sizes = [(len(w), len(t)) for w, t in tagging.sliced([batch])]
    assert all(a == b <= 400 for a, b in sizes) and sum(a for a, _ in sizes) == 2000


def test_lemmas_are_held_compactly(spark):
    rows = spark.range(3000).selectExpr("concat('w', id, 'xs') word", "'NNS' tag", "if(id % 2 = 0, concat('w', id, 'x'), concat('v', id)) lemma")
    scripts = learn_scripts(rows)
    lemma, kept = Lemmatiser(scripts), scripts.count()
    size = sum(c.nbytes for c in (lemma.hashes, lemma.keys, lemma.cuts, lemma.adds))
    assert kept > 3000 and size < 60 * kept
    assert lemma("W4xs", "NNS") == "w4x" and lemma("w5xs", "NNS") == "v5" and lemma("w5xs", None) == "v5"
