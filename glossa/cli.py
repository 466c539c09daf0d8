"""Command lines: python -m glossa.cli preprocess | extract | classify | align | evaluate | identify."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import comments, text
from glossa.operators import alignment, classifiers, evaluation, features, language_model, mixtures, statistics
from glossa.session import session
from glossa.sources import readers, reports


def preprocess(spark: SparkSession, a: argparse.Namespace) -> None:
    """Comments of each class, a circular sample of them, normalised and written as JSON."""
    most = statistics.check_sample_size(a.max)
    rows = readers.read_comments(spark, a.input)
    stops = [r.entry for r in readers.read_words(spark, a.stopwords).collect()] if a.stopwords else []
    short = tuple(r.entry for r in readers.read_words(spark, a.abbreviations).collect()) if a.abbreviations else ()
    for (cat,) in rows.select("cat").distinct().orderBy("cat").collect():
        part = statistics.circular_sample(rows.where(F.col("cat") == cat), ["file_pos"], a.id, most)
        out = part.select("id", comments.preprocess(F.col("body"), stopwords=stops, abbreviations=short).alias("body"), "cat")
        readers.write_json(out, f"{a.output}/{cat}")


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    """Preprocessed comments to a table of 173 features and label."""
    rows = spark.read.option("recursiveFileLookup", "true").schema("id string, body string, cat string").json(a.input)
    first = readers.read_lexicon(spark, a.lexicon_a, "WORD").select(F.col("WORD").alias("word"), *(F.col(f"`{c}`").alias(n) for c, n in (("AoA (100-700)", "aoa"), ("IMG", "img"), ("FAM", "fam"))))
    second = readers.read_lexicon(spark, a.lexicon_b, "Word").select(F.col("Word").alias("word"), *(F.col(f"`{c}.Mean.Sum`").alias(c.lower()) for c in "VAD"))
    table = features.with_external(features.feature_rows(rows, first, second), readers.read_external_features(spark, a.external))
    readers.write_model(table, a.output)


def classify(spark: SparkSession, a: argparse.Namespace) -> None:
    """The four experiments, a comma-separated report each."""
    rows = statistics.train_test(spark.read.parquet(a.input), "id")
    out = classifiers.experiments(rows.where("not test").drop("test"), rows.where("test").drop("test"))
    for name, table in out.items():
        flat = table.select(*(F.col(c).cast("string") if "array" not in t else F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c, t in table.dtypes))
        readers.write_report(flat, f"{a.output}/{name}", flat.columns[:2])


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    pairs = readers.read_pairs(spark, folder)
    toks = {s: text.without_markers(text.tokens(text.normalise_sentence(F.col(s), s))) for s in "ef"}
    return pairs.select(F.concat_ws(":", "doc", "line_no").alias("pid"), "doc", "line_no", toks["e"].alias("e_toks"), toks["f"].alias("f_toks"))


def align(spark: SparkSession, a: argparse.Namespace) -> None:
    """A word alignment model of the first pairs of a parallel corpus."""
    readers.write_model(alignment.train(corpus(spark, a.input), a.iterations, a.sentences), a.output)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Decode a test set with a model for each training size and report BLEU."""
    pairs = corpus(spark, a.input)
    marked = pairs.select(F.concat(F.array(F.lit(text.SENTENCE_START)), "e_toks", F.array(F.lit(text.SENTENCE_END))).alias("toks"))
    uni, bi = language_model.unigrams(marked).checkpoint(), language_model.bigrams(marked).checkpoint()
    tests = readers.read_test_triples(spark, a.source, a.human, a.machine)
    toks = {c: text.tokens(text.normalise_sentence(F.col(c), s)) for c, s in (("src", "f"), ("ref_human", "e"), ("ref_machine", "e"))}
    tests = tests.select("line_no", *(x.alias(c) for c, x in toks.items()))
    models = alignment.size_sweep(pairs, a.sizes, a.iterations).checkpoint()
    words = tests.select(F.col("line_no").alias("sid"), F.posexplode("src").alias("pos", "f"))
    scored = None
    for n in a.sizes:
        said = alignment.decode(words, models.where(F.col("size") == n), uni, bi)
        lines = said.join(tests, said["sid"] == tests["line_no"])
        scores = lines.select("line_no", evaluation.bleu_scores(F.col("words"), [F.col("ref_human"), F.col("ref_machine")]).alias("s"))
        rows = scores.select(F.lit(n).alias("model"), "line_no", *(F.col("s")[k - 1].alias(f"bleu{k}") for k in (1, 2, 3)))
        scored = rows if scored is None else scored.unionByName(rows)
    scored = scored.checkpoint()
    each = scored.select("model", "line_no", F.explode(F.array(*(F.struct(F.lit(k).alias("n"), F.col(f"bleu{k}").alias("bleu")) for k in (1, 2, 3)))).alias("s")).select("model", "line_no", "s.n", "s.bleu")
    readers.write_lines(reports.bleu_lines(each, evaluation.bleu_report(scored, ["model"])), a.output, ["at"])


def identify(spark: SparkSession, a: argparse.Namespace) -> None:
    """Speakers named by mixtures of their other utterances."""
    frames = readers.read_frames(spark, a.input)
    out = mixtures.experiment(frames, "utt", a.m, a.max_iter, a.epsilon, a.speakers, var_floor=a.var_floor)
    readers.write_lines(reports.speaker_lines(out), a.output, ["at"])


COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], None]] = {f.__name__: f for f in (preprocess, extract, classify, align, evaluate, identify)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glossa")
    p.add_argument("--master", default=None)
    subs = p.add_subparsers(dest="command", required=True)
    made = {}
    for name, f in COMMANDS.items():
        made[name] = subs.add_parser(name, help=f.__doc__)
        made[name].add_argument("-i", "--input", required=True)
        made[name].add_argument("-o", "--output", required=True)
    made["preprocess"].add_argument("id", type=int, help="where the circular sample starts")
    made["preprocess"].add_argument("--max", type=int, default=10_000)
    made["preprocess"].add_argument("--stopwords")
    made["preprocess"].add_argument("--abbreviations")
    for option in ("lexicon-a", "lexicon-b", "external"):
        made["extract"].add_argument(f"--{option}", required=True)
    for name in ("align", "evaluate"):
        made[name].add_argument("--iterations", type=int, default=10)
    made["align"].add_argument("--sentences", type=int)
    for option in ("source", "human", "machine"):
        made["evaluate"].add_argument(f"--{option}", required=True)
    made["evaluate"].add_argument("--sizes", type=int, nargs="+", default=[1_000, 10_000, 15_000, 30_000])
    for option, kind, default in (("m", int, 8), ("max-iter", int, 20), ("epsilon", float, 0.0), ("speakers", int, None), ("var-floor", float, 0.0)):
        made["identify"].add_argument(f"--{option}", type=kind, default=default)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command](session(a.master), a)


if __name__ == "__main__":
    main()
