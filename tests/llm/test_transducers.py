"""Counts of the compiled transducer against the model's own library."""

import random

import pytest
from pyspark.sql import functions as F

from glossa.llm import transducers
from glossa.llm.queries import piece_model
from glossa.llm.transducers import BLANK, SAME, START, compiled, count_tokens
from tests.llm.fixtures import frame, odd_documents

PARTS = ["a", "b", "th", "the ", " ", "  ", BLANK, "é", "\n", "①", "𝄞", "=", "-", "--", "0", "12", "ing", "ation", "他", "的", " " * 17, "\t", "<s>", "</s>", "<0x41>", "aaaa", "\x00", "ﬁ", "Á"]


def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_model())


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_counts_equal_the_library():
    t, texts = compiled(piece_model()), [*random_texts(3000), *(x[1] or "" for x in odd_documents(3))]
    assert t.text_counts(texts).tolist() == [len(x) for x in library().encode(texts)]
    assert t.text_counts([]).tolist() == [] and t.text_counts(["", ""]).tolist() == [0, 0]


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_chunks_compose(monkeypatch, chunk):
    monkeypatch.setattr(transducers, "CHUNK", chunk)
    t, texts = compiled(piece_model()), [x for x in [*random_texts(300, chunk), "=" * 300, " " * 99 + "x", "他" * 50] if x]
    assert [t.long_count(x) for x in texts] == [len(x) for x in library().encode(texts)]


def test_composition_is_associative():
    t, r = compiled(piece_model()), random.Random(5)
    for text in random_texts(200, 9):
        cuts = sorted({0, len(text), *(r.randrange(len(text) + 1) for _ in range(4))})
        maps = [t.chunk_map(text[a:b], a == 0) for a, b in zip(cuts, cuts[1:], strict=False)] or [SAME]
        left = maps[0]
        for m in maps[1:]:
            left = t.compose(left, m)
        right = maps[-1]
        for m in reversed(maps[:-1]):
            right = t.compose(m, right)
        assert t.total(left) == t.total(right) == t.total(t.prefix_scan(maps)[-1])
        assert t.compose(SAME, maps[0])[:3] == t.compose(maps[0], SAME)[:3] == maps[0][:3]


def test_states_are_few_where_a_letter_repeats():
    t = compiled(piece_model())
    states, state = set(), START
    for _ in range(5000):
        state, _ = t.step(state, "=")
        states.add(state)
    assert len(states) < 600  # counts grow, states come again


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(transducers, "REMEMBER", 50)
    t = transducers.Transducer(compiled(piece_model()).scores)
    texts = random_texts(400, 4)
    assert t.text_counts(texts).tolist() == [len(x) for x in library().encode(texts)]
    assert len(t.keys) <= 400 and len(t.steps) <= 60 and len(t.fits) <= 60


def test_other_models_are_refused(tmp_path, monkeypatch):
    import sentencepiece

    with pytest.raises(RuntimeError):
        compiled(str(tmp_path / "none.model"))

    class Unigram(sentencepiece.SentencePieceProcessor):
        def encode(self, text, **others):
            return [0] * len(text)

    (tmp_path / "m.model").symlink_to(piece_model())
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Unigram)
    with pytest.raises(ValueError, match="kind"):
        compiled(str(tmp_path / "m.model"))


@pytest.mark.parametrize(("long", "fan"), [(1 << 20, 64), (40, 2), (40, 5)])
def test_table(spark, monkeypatch, long, fan):
    monkeypatch.setattr(transducers, "FAN", fan)
    rows = [*odd_documents(11), (7000, "=" * 3000, *[None] * 11), (7001, "word " * 4000, *[None] * 11), (7001, "word " * 4000, *[None] * 11)]

    def model():
        transducers.LONG, transducers.CHUNK = long, min(long, 1 << 16)  # on the workers
        return piece_model()

    out = count_tokens(frame(spark, rows), model, 1000).collect()
    sp = library()
    want = [(r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 1000) for r in rows]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)

    def reset():
        transducers.LONG, transducers.CHUNK = 1 << 20, 1 << 16
        return piece_model()

    assert count_tokens(frame(spark, []), reset).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in count_tokens(nothing, reset).orderBy(F.col("doc_id").asc_nulls_last()).collect()] == [(1, 0, 0, False), (2, 0, 0, False), (None, 0, 0, False)]
