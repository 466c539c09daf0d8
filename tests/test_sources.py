import json

import numpy as np
from pyspark.sql import functions as F

from glossa import cli
from glossa.sources import readers, reports
from glossa.streaming.stateless import normalised_stream


def test_readers(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "Left").write_text(json.dumps([json.dumps({"id": "a", "body": "x"}), json.dumps({"id": "b", "body": "y"})]))
    assert sorted((r.id, r.body, r.cat) for r in readers.read_comments(spark, str(tmp_path / "c")).collect()) == [("a", "x", "Left"), ("b", "y", "Left")]
    (tmp_path / "lex.csv").write_text("WORD,v\na,1\nb,2\na,3\n")
    assert {r.WORD: r.v for r in readers.read_lexicon(spark, str(tmp_path / "lex.csv"), "WORD").collect()} == {"a": "3", "b": "2"}
    (tmp_path / "p").mkdir()
    for name, lines in (("d1.e", "a\nb\nc"), ("d1.f", "x\ny"), ("d2.e", "q")):
        (tmp_path / "p" / name).write_text(lines + "\n")
    assert sorted(map(tuple, readers.read_pairs(spark, str(tmp_path / "p")).collect())) == [("d1", 0, "a", "x"), ("d1", 1, "b", "y")]
    (tmp_path / "t").mkdir()
    for n in ("s", "h", "m"):
        (tmp_path / "t" / n).write_text(f"{n}0\n{n}1\n")
    assert readers.read_test_triples(spark, *(str(tmp_path / "t" / n) for n in ("s", "h", "m"))).count() == 2
    (tmp_path / "n" / "sp").mkdir(parents=True)
    np.save(tmp_path / "n" / "sp" / "u.mfcc.npy", np.arange(6.0).reshape(2, 3))
    assert [(r.speaker, r.t, r.x) for r in readers.read_frames(spark, str(tmp_path / "n")).orderBy("t").collect()] == [("sp", 0, [0, 1, 2]), ("sp", 1, [3, 4, 5])]
    for sp, names in (("A", ("transcripts.txt", "t.G.txt")), ("B", ("transcripts.txt",))):
        (tmp_path / "w" / sp).mkdir(parents=True)
        for x in names:
            (tmp_path / "w" / sp / x).write_text("one\ntwo\n")
    got = readers.read_transcripts(spark, str(tmp_path / "w"), {"ref": "transcripts.txt", "g": "t.G.txt"})
    assert {r.speaker for r in got.collect()} == {"A"} and got.count() == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k long, v string")
    readers.write_report(df, str(tmp_path / "r"), ["k"])
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["1,a", "2,b"]
    readers.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    built = []
    for n in (5, 5, 6):
        readers.cached_model(spark, str(tmp_path / "m"), "lm", {"n": n}, lambda n=n: built.append(n) or df)
    assert built == [5, 6]
    words = tmp_path / "w.txt"
    words.write_text(" the \nof\n")
    assert [r.entry for r in readers.read_words(spark, str(words)).collect()] == ["the", "of"]


def test_matrices_and_external_features(spark, tmp_path):
    np.savez(tmp_path / "m.npz", np.arange(6.0).reshape(3, 2))
    assert [(r.row, r.features) for r in readers.read_matrix(spark, str(tmp_path / "m.npz")).orderBy("row").collect()] == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5])]
    for i, c in enumerate(("Alt", "Center", "Left", "Right")):
        (tmp_path / f"{c}_IDs.txt").write_text(f"{c}1\nboth\n")
        np.save(tmp_path / f"{c}_feats.dat.npy", np.array([[i, 0.5], [i, 1.5]]))
    got = {r.id: r.feats for r in readers.read_external_features(spark, str(tmp_path)).collect()}
    assert got == {"Alt1": [0, 0.5], "Center1": [1, 0.5], "Left1": [2, 0.5], "Right1": [3, 0.5], "both": [3, 1.5]}


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(2, ["x"]), (1, ["a,b", 'say "c"', None]), (3, [])], "k int, cells array<string>")
    readers.write_ragged(rows, str(tmp_path / "csv"), ["k"])
    assert [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()] == ['"a,b","say ""c""",', "x", ""]
    errors = spark.createDataFrame([("sp", "Kaldi", 0, 0.5, 1, 0, 0)], "speaker string, system string, line_no long, wer double, s long, i long, d long")
    summary = spark.createDataFrame([("Kaldi", 0.5, 0.0)], "system string, mean_wer double, std_wer double")
    readers.write_lines(reports.error_lines(errors, summary), str(tmp_path / "wer"), ["at"])
    assert [r.value for r in spark.read.text(str(tmp_path / "wer")).collect()] == ["[sp] Kaldi 0 0.500 S:1, I:0, D:0", "Kaldi WER Avg: 0.5000 Kaldi WER StD: 0.0000"]
    p = reports.perplexity_lines(spark.createDataFrame([("e", 0.1, 12.34567)], "lang string, delta double, perplexity double"))
    assert [r.value for r in p.orderBy("at").collect()] == ["Language, Delta, Perplexity", "E, 0.1, 12.3457"]


def test_command_lines(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "Left").write_text(json.dumps([json.dumps({"id": str(i), "body": f"The dogs bark, {i}."}) for i in range(3)]))
    cli.main(["preprocess", "4", "-i", str(tmp_path / "c"), "-o", str(tmp_path / "out"), "--max", "2"])
    assert sorted((r.id, r.body, r.cat) for r in spark.read.json(str(tmp_path / "out" / "Left")).collect()) == [("1", "the/DT dog/NNS bark/NN ,/, 1/CD ./.\n", "Left"), ("2", "the/DT dog/NNS bark/NN ,/, 2/CD ./.\n", "Left")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "d.e").write_text("the house\nthe cat\n")
    (tmp_path / "p" / "d.f").write_text("la maison\nle chat\n")
    for n, t in (("s", "la maison"), ("h", "the house"), ("m", "a house")):
        (tmp_path / n).write_text(t + "\n")
    cli.main(["evaluate", "-i", str(tmp_path / "p"), "-o", str(tmp_path / "bleu"), "--source", str(tmp_path / "s"), "--human", str(tmp_path / "h"), "--machine", str(tmp_path / "m"), "--sizes", "1", "2", "--iterations", "1"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "bleu")).collect()]
    assert len(lines) == 12 and lines[0].startswith("1: BLEU scores with 1-gram: (Average ")
    assert set(cli.COMMANDS) == {"preprocess", "extract", "classify", "align", "evaluate", "identify"}


def test_stream_matches_batch(spark, tmp_path):
    rows = spark.createDataFrame([("The cat, sat.",), ("A dog",)], "text string")
    rows.write.parquet(str(tmp_path / "in"))
    q = normalised_stream(spark.readStream.schema("text string").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("normalised").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    key = F.to_json("toks").alias("k")
    assert sorted(r.k for r in spark.table("normalised").select(key).collect()) == sorted(r.k for r in normalised_stream(rows).select(key).collect())


def test_ordered_reports(spark, tmp_path):
    from glossa.sources.ordered import write_ordered

    rows = spark.range(5000).repartition(7).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id").cast("string")).alias("value"))
    readers.write_lines(rows, str(tmp_path / "r"), ["k"])
    text = "".join(f"{'' if i % 10 == 0 else i}\n" for i in range(5000))
    assert [f.name for f in (tmp_path / "r").iterdir()] == ["part-00000.txt"] and (tmp_path / "r" / "part-00000.txt").read_text() == text
    bad = rows.select(F.when(F.col("k") == 4000, F.raise_error(F.lit("lost"))).otherwise(F.col("value")).alias("value"))
    for folder in ("r", "new"):
        try:
            write_ordered(bad, str(tmp_path / folder))
            raise AssertionError("no error")
        except Exception as e:
            assert "lost" in str(e)
    assert (tmp_path / "r" / "part-00000.txt").read_text() == text
    assert not list((tmp_path / "new").glob("part-*"))
    readers.write_lines(rows.limit(0), str(tmp_path / "r"), ["k"])
    assert (tmp_path / "r" / "part-00000.txt").read_text() == ""
