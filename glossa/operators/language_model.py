"""Bigram language model as tables: counts, smoothed scores, perplexity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.guards import safe_log2
from glossa.functions.text import bigram_pairs, ngrams
from glossa.session import written


def unigrams(sents: DataFrame, toks: str = "toks") -> DataFrame:
    return sents.select(F.explode(toks).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def bigrams(sents: DataFrame, toks: str = "toks") -> DataFrame:
    pairs = sents.select(F.explode(ngrams(F.col(toks), 2)).alias("b"))
    return pairs.groupBy(F.col("b")[0].alias("w1"), F.col("b")[1].alias("w2")).agg(F.count("*").alias("n"))


def log2_probability(c12: Column, c1: Column, delta: Column, vocabulary: Column) -> Column:
    """log2 of (c12 + delta) / (c1 + delta V); an unseen bigram without smoothing: -inf."""
    return safe_log2(c12 + delta) - safe_log2(c1 + delta * vocabulary)


def sentence_scores(sents: DataFrame, train: DataFrame, deltas: Sequence[float], keys: Sequence[str] = ("sid",), group: Sequence[str] = ()) -> DataFrame:
    """(group, keys, delta, n_tokens, logprob, finite) of ``sents`` (group, keys, toks) under the model of ``train`` (group, toks).

    ``group`` columns part both tables into models of their own. All deltas
    are scored in one job: the model is looked up once for each distinct
    bigram, its counts meet the sentences' bigrams by one shuffle of those and
    go on to the sentence as numbers, where all deltas are summed side by side.
    Words travel as 64-bit hashes, in a bigram with another one for each place.
    finite is false where a bigram is unseen and delta is 0.
    """
    g, k = list(group), list(keys)
    # a sentence's last token stands before a blank, which is no token, so that the pairs hold all counts of words too
    pair = ["_w1", "_w2"]

    def hashed(rows: DataFrame) -> DataFrame:
        return rows.select(*(c for c in rows.columns if c not in ("w1", "w2")), F.col("w1").isNotNull().alias("some"), *(F.xxhash64(F.lit(seed), name).alias(f"_{name}") for seed, name in enumerate(("w1", "w2"))))

    # outer, as the filter that Spark puts before an inner one makes the tokens twice
    learned = hashed(train.select(*g, F.inline_outer(bigram_pairs(F.col("toks"), " "))).where("w1 is not null and w2 is not null"))
    own = hashed(sents.select(*g, *k, F.size("toks").alias("n_tokens"), F.inline_outer(bigram_pairs(F.col("toks")))))
    # the model's bigrams and those to look up in one table
    both = learned.select(*g, *pair, F.lit(1).alias("n"), F.lit(False).alias("wanted")).unionByName(own.where("some").select(*g, *pair, F.lit(0).alias("n"), F.lit(True).alias("wanted")))
    both = written(both.groupBy(*g, *pair).agg(F.sum("n").alias("c12"), F.max("wanted").alias("wanted")))
    uni = both.where("c12 > 0").groupBy(*g, "_w1").agg(F.sum("c12").alias("c1"))
    size = uni.groupBy(*g).agg(F.count("*").alias("v")) if g else uni.agg(F.count("*").alias("v"))
    known = both.where("wanted").drop("wanted").join(uni, [*g, "_w1"], "left")
    seen = own.join(known, [*g, *pair], "left").select(*g, *k, "n_tokens", "some", F.coalesce("c12", F.lit(0)).alias("c12"), F.coalesce("c1", F.lit(0)).alias("c1"))
    seen = seen.repartition(*k)
    seen = seen.join(F.broadcast(size), g) if g else seen.crossJoin(F.broadcast(size))  # a row per group

    def of(delta: Column) -> tuple[Column, Column]:
        bad = F.col("some") & (F.col("c12") + delta == 0)
        return F.sum(F.when(F.col("some") & ~bad, log2_probability(F.col("c12"), F.col("c1"), delta, F.col("v"))).otherwise(0.0)), F.max(bad)

    sums = [(F.lit(float(x)), *of(F.lit(float(x)))) for x in deltas]
    rows = seen.groupBy(*g, *k, "n_tokens").agg(F.array(*(F.struct(delta.alias("delta"), total.alias("sum"), bad.alias("bad")) for delta, total, bad in sums)).alias("s"))
    rows = rows.select(*g, *k, "n_tokens", F.inline("s"))
    return rows.select(*g, *k, "delta", "n_tokens", F.when(F.col("bad"), F.lit(float("-inf"))).otherwise(F.col("sum")).alias("logprob"), (~F.col("bad")).alias("finite"))


def perplexity(scores: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, delta, sentences, tokens, perplexity): sentences that no model score covers leave both sums; no token: 0."""
    f = F.col("finite")
    sums = scores.groupBy(*group, "delta").agg(F.count_if(f).alias("sentences"), F.coalesce(F.sum(F.when(f, F.col("n_tokens"))), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(f, F.col("logprob"))), F.lit(0.0)).alias("total"))
    return sums.select(*group, "delta", "sentences", "tokens", F.when(F.col("tokens") == 0, 0.0).otherwise(F.pow(F.lit(2.0), F.try_divide(-F.col("total"), F.col("tokens")))).alias("perplexity"))
