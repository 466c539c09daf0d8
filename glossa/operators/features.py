"""The 29 text features of tagged comments, lexicon statistics and the feature matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import PUNCT_CLASS, once, tagged_token

# Word lists and tag sets of the features.
FIRST_PERSON = ("i", "me", "my", "mine", "we", "us", "our", "ours")
SECOND_PERSON = ("you", "your", "yours", "u", "ur", "urs")
THIRD_PERSON = ("he", "him", "his", "she", "her", "hers", "it", "its", "they", "them", "their", "theirs")
FUTURE = ("'ll", "will", "gonna")
SLANG = (
    "smh", "fwb", "lmfao", "lmao", "lms", "tbh", "rofl", "wtf", "bff", "wyd", "lylc", "brb", "atm", "imao", "sml", "btw", "bw", "imho",
    "fyi", "ppl", "sob", "ttyl", "imo", "ltr", "thx", "kk", "omg", "omfg", "ttys", "afn", "bbs", "cya", "ez", "f2f", "gtr", "ic", "jk",
    "k", "ly", "ya", "nm", "np", "plz", "ru", "so", "tc", "tmi", "ym", "ur", "u", "sol", "fml",
)
CLASS_CODES = {"Left": 0, "Center": 1, "Right": 2, "Alt": 3}
LEXICON_A = ("aoa", "img", "fam")
LEXICON_B = ("v", "a", "d")
#: Bytes of the lexicons, a hundred more for each word, up to which they go to every task.
LEXICON_BYTES = 64 << 20


def tagged_sentences(body: Column) -> Column:
    """array<array<struct<word, tag>>> of a preprocessed comment; an empty sentence has one empty token."""
    return F.transform(F.split(body, "\n", -1), lambda s: F.transform(F.split(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), " ", -1), tagged_token))


def count_words(toks: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(toks, lambda t: F.lower(t["word"]).isin(*words))).cast("double")


def count_tags(toks: Column, tags: tuple[str, ...]) -> Column:
    low = [t.lower() for t in tags]
    return F.size(F.filter(toks, lambda t: F.coalesce(F.lower(t["tag"]).isin(*low), F.lit(False)))).cast("double")


def future_verbs(sents: Column, strict: bool = True) -> Column:
    """Single future words; not ``strict``: also going + to + VB within a sentence, which strict semantics never find."""
    single = count_words(F.flatten(sents), FUTURE)
    if strict:
        return single

    def in_sentence(s: Column) -> Column:
        at = F.when(F.size(s) > 2, F.sequence(F.lit(2), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(at, lambda i: (F.get(s, i)["tag"] == "VB") & (F.get(s, i - 1)["word"] == "to") & (F.get(s, i - 2)["word"] == "going")))

    return single + F.aggregate(F.transform(sents, in_sentence), F.lit(0), lambda a, x: a + x)


def native_features(body: str = "body", strict: bool = True) -> Column:
    """Features 1 to 17 of a preprocessed comment as a struct of doubles; the tokens are made once, no shuffle."""

    def of(s: Column) -> Column:
        return once(F.flatten(s), lambda t: once(F.transform(t, lambda x: x["word"]), lambda words: F.struct(*(c.cast("double").alias(k) for k, c in values(s, t, words).items()))))

    def values(s: Column, t: Column, words: Column) -> dict[str, Column]:
        real = F.filter(words, lambda w: w.rlike(f"[^{PUNCT_CLASS}]"))

        def chars(ws: Column) -> Column:
            return F.aggregate(ws, F.lit(0), lambda a, w: a + F.length(w)).cast("double")

        return {
            "f01_first_person": count_words(t, FIRST_PERSON),
            "f02_second_person": count_words(t, SECOND_PERSON),
            "f03_third_person": count_words(t, THIRD_PERSON),
            "f04_conjunctions": count_tags(t, ("CC",)),
            "f05_past_verbs": count_tags(t, ("VBD",)),
            "f06_future_verbs": future_verbs(s, strict),
            "f07_commas": count_tags(t, (",",)),
            "f08_multi_punctuation": F.size(F.filter(words, lambda w: w.rlike(f"^[{PUNCT_CLASS}]{{2,}}$"))),
            "f09_common_nouns": count_tags(t, ("NN", "NNS")),
            "f10_proper_nouns": count_tags(t, ("NNP", "NNPS")),
            "f11_adverbs": count_tags(t, ("RB", "RBR", "RBS")),
            "f12_wh_words": count_tags(t, ("WDT", "WP", "WP$", "WRB")),
            "f13_slang": count_words(t, SLANG),
            "f14_upper_case": F.size(F.filter(words, lambda w: (F.length(w) >= 3) & w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}"))),
            "f15_sentence_chars": F.try_divide(chars(words), F.size(s)),
            "f16_token_chars": F.coalesce(once(real, lambda ws: F.try_divide(chars(ws), F.size(ws))), F.lit(0.0)),
            "f17_sentences": F.size(s),
        }

    return once(tagged_sentences(F.col(body)), of)


def lexicon_stats(tokens: DataFrame, lexicon: DataFrame, columns: tuple[str, ...], key: str = "word", fold: bool = True) -> DataFrame:
    """(id, mean_<c>..., std_<c>...) of ``tokens`` (id, word): population deviation; words or cells that are missing or no number don't count.

    ``fold`` lower-cases the words before the lookup. Ids without any match are absent.
    """
    return lexicons_stats(tokens, [(lexicon, columns, fold)], key)


def lexicons_stats(tokens: DataFrame, lexicons: list[tuple[DataFrame, tuple[str, ...], bool]], key: str = "word") -> DataFrame:
    """``lexicon_stats`` of several (lexicon, columns, fold) at once; 0 where a lexicon has no match but another has.

    Lexicons up to ``LEXICON_BYTES`` go to every task, so only an id's sums are
    shuffled, once for each task that holds words of it; beyond that a text's
    distinct words meet them by shuffling. Deviations are central moments, so no
    digits are lost.
    """
    most = max(len(columns) for _, columns, _ in lexicons)
    parts = [x.select(F.lit(i).alias("of"), F.col(key).alias("w"), *((F.col(columns[j]).try_cast("double") if j < len(columns) else F.lit(None).cast("double")).alias(f"_{j}") for j in range(most))) for i, (x, columns, _) in enumerate(lexicons)]
    lex = reduce(DataFrame.unionByName, parts)
    few = (lex.agg(F.sum(F.octet_length("w") + 100)).first()[0] or 0) <= LEXICON_BYTES
    looked_up = F.array(*(F.struct(F.lit(i).alias("of"), (F.lower("word") if fold else F.col("word")).alias("w")) for i, (_, _, fold) in enumerate(lexicons)))
    words = tokens.select("id", F.explode(looked_up).alias("x")).select("id", "x.of", "x.w")
    if few:
        hits = words.join(F.broadcast(lex), ["of", "w"])
    else:
        hits = words.groupBy("id", "of", "w").agg(F.count("*").cast("int").alias("n")).join(lex, ["of", "w"]).withColumn("n", F.explode(F.array_repeat(F.lit(0), F.col("n"))))
    named = [(f"{p}_{c}", f(F.when(F.col("of") == i, F.col(f"_{j}")))) for i, (_, columns, _) in enumerate(lexicons) for p, f in (("mean", F.avg), ("std", F.stddev_pop)) for j, c in enumerate(columns)]
    return hits.groupBy("id").agg(*(F.coalesce(c, F.lit(0.0)).alias(n) for n, c in named))


def feature_rows(comments: DataFrame, lexicon_a: DataFrame, lexicon_b: DataFrame, strict: bool = True) -> DataFrame:
    """(id, cat, features): 29 features of ``comments`` (id, body preprocessed, cat)."""
    base = comments.select("id", "cat", native_features("body", strict).alias("f"))
    base = base.select("id", "cat", "f.*")
    toks = comments.select("id", F.explode(F.transform(F.flatten(tagged_sentences(F.col("body"))), lambda t: t["word"])).alias("word"))
    stats = lexicons_stats(toks, [(lexicon_a, LEXICON_A, True), (lexicon_b, LEXICON_B, False)])
    names = [*base.columns[2:], *(f"{p}_{c}" for cols in (LEXICON_A, LEXICON_B) for p in ("mean", "std") for c in cols)]
    joined = base.join(stats, "id", "left")
    return joined.select("id", "cat", F.array(*(F.coalesce(F.col(c), F.lit(0.0)) for c in names)).alias("features"))


def with_external(rows: DataFrame, external: DataFrame) -> DataFrame:
    """Features followed by ``external`` (id, feats), with the class code as label; an id without external features is an error."""
    codes = F.create_map(*(F.lit(x) for kv in CLASS_CODES.items() for x in kv))
    missing = F.raise_error(F.concat(F.lit("no external features for id "), F.col("id").cast("string")))
    joined = rows.join(external, "id", "left")
    feats = F.when(F.col("feats").isNull(), missing.cast("array<double>")).otherwise(F.concat("features", "feats"))
    return joined.select("id", feats.alias("features"), codes[F.col("cat")].alias("label"))


def positional_features(ids: DataFrame, matrix: DataFrame, order: tuple[str, ...] = ("Alt", "Center", "Left", "Right")) -> DataFrame:
    """(id, feats) of ids (cat, row, id) and matrix rows (cat, row, feats) joined by place; of repeated ids the last wins, classes in ``order``."""
    rank = F.create_map(*(F.lit(x) for i, c in enumerate(order) for x in (c, i)))
    rows = ids.join(matrix, ["cat", "row"]).withColumn("rank", rank[F.col("cat")])
    return rows.groupBy("id").agg(F.max_by("feats", F.struct("rank", "row")).alias("feats"))


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last in ``order``, as when rows are put into a dictionary one after another."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(key, "r.*")
