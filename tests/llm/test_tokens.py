import zlib

import numpy as np
import pytest

from glossa.llm import codes
from glossa.llm.codes import Segment, encode, read_codes, tokens_at, write_codes
from glossa.llm.queries import tokenizer
from tests.llm.fixtures import frame, odd_documents


def test_segment_gives_any_token():
    r = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 511, 512, 513, 5000):
        ids = r.choice([1, 200, 255, 256, 40_000, 65_535, 65_536, 2**24, 2**32 - 1], n).astype(np.uint32)
        s = Segment(encode(ids, np.array([7, 9]), np.array([0, n // 2, n])))
        assert [s.token(i) for i in range(n)] == ids.tolist()
        for a, b in ((0, n), (n // 3, n // 2), (n // 2, n)):
            assert s.slice(a, b).tolist() == ids[a:b].tolist()
        assert s.doc_ids.tolist() == [7, 9] and s.firsts.tolist() == [0, n // 2, n]
    with pytest.raises(ValueError):
        Segment(b"something else")


def test_codes_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    rows = [(r[0], r[1]) for r in odd_documents(7)] + [(9000, "<|endoftext|>a <|startoftext|> b<|endoftext|>"), (9001, "Ǻ Σ ΟΔΟΣ ΟΔΟΣ. İ it's we'LL 12345 ́x")]
    out = read_codes(write_codes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizer)).collect()
    want, at = [], 0
    import operator
    from collections import Counter

    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    single = {d for d, n in Counter(d for d, _ in rows).items() if n == 1}
    assert {tuple(r) for r in out if r.doc_id in single} == {w for w in want if w[0] in single}
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((w[0], w[2], w[3]) for w in want)
    ends = sorted(out, key=operator.attrgetter("start"))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ends, ends[1:], strict=False))


def test_empty_table(spark):
    assert read_codes(write_codes(frame(spark, []), tokenizer)).count() == 0
    none = spark.createDataFrame([(0,), (None,)], "position long")
    assert tokens_at(write_codes(frame(spark, []), tokenizer), none).count() == 0


@pytest.mark.parametrize("segment", [1 << 18, 256])
def test_tokens_by_place(spark, tmp_path, monkeypatch, segment):
    from tokenizers import Tokenizer

    monkeypatch.setattr(codes, "SEGMENT", segment)
    monkeypatch.setattr(codes.scan, "PIECE", 1 << 12)
    t = Tokenizer.from_file(tokenizer())
    rows = [(d, r[1]) for d, r in enumerate(odd_documents(3))]
    ids = [x for _, text in rows for x in (*t.encode(text or "", add_special_tokens=False).ids, 1)]
    to = f"file://{tmp_path}/codes"
    write_codes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizer, to=to)
    table = spark.read.parquet(to)
    wanted = [0, 1, 1, len(ids) - 1, len(ids), -1, None, 2**40, *range(5, len(ids), 97)]
    out = tokens_at(table, spark.createDataFrame([(w,) for w in wanted], "position long")).collect()
    assert sorted(tuple(r) for r in out) == [(w, ids[w]) for w in sorted({w for w in wanted if w is not None and 0 <= w < len(ids)})]
