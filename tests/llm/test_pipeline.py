"""The pipeline's stages, one after another, against plain Python on what each gets."""

from collections import Counter, defaultdict

from glossa.llm import pipeline as corpus_pipeline
from glossa.llm.quality import quality
from tests.llm.fixtures import SCHEMA, frame, odd_documents
from tests.llm.test_duplicates import brute_components
from tests.llm.test_records import brute_edits


def test_stages(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [*odd_documents(12), (7000, odd_documents(12)[1][1] + " " + item, "en", "a", *odd_documents(12)[1][4:])]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = (before, docs.collect())
        assert name == "shard" or docs.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
    before, after = seen["quality"]
    judged = quality(frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in judged if r.kept)
    before, after = seen["near_dedup"]
    groups = brute_components([(r.doc_id, r.text) for r in before], 80)
    assert Counter(r.doc_id for r in after) == Counter({d: 1 for d, _, c in groups if d == c})
    before, after = seen["decontaminate"]
    clean = [r.doc_id for r in before if brute_edits(item.split(), (r.text or "").lower().split()) > 2]
    assert Counter(r.doc_id for r in after) == Counter(clean) and 7000 not in clean
    before, after = seen["mix"]
    assert max(Counter(r.doc_id for r in after).values()) <= 2 and {r.doc_id for r in after} <= {r.doc_id for r in before}
    before, after = seen["shard"]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    places = defaultdict(list)
    for r in after:
        places[r.shard].append(int(r.slot))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)


def test_near_dedup_keeps_unlike_texts_of_one_id(spark):
    def words(a, n=40):
        return " ".join(f"{a}{i}" for i in range(n))

    near = words("b").replace("b39", "other")
    rows = [(None, words("a")), (None, words("b")), (None, words("c")), (None, words("c")), (7, words("d")), (7, words("e")), (7, words("e")), (3, near), (9, words("d") + " more"), (11, words("f")), (12, words("f")), (None, None), (7, None), (7, ""), (8, "")]
    docs = frame(spark, [(d, t, "en", "a", *odd_documents()[0][4:]) for d, t in rows])
    out = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    gone = {(3, near), (9, words("d") + " more"), (12, words("f"))}
    assert out == Counter(set(rows) - gone)
