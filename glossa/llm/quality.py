"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Three metrics have a spread in any prose: mean word length, punctuation marks
per word, and variety, the logarithm of the number of distinct words over that
of all words. A sketch of a metric is its histogram on a fixed integer grid
(hundredths of a code point, thousandths), so sketches merge by adding counts,
in any order and with one result, and a quantile is off by less than one grid
step. From ``GRID`` on a step is a power of two, at most one 5,000th of the
value, so no value is too large for a sketch. Rows of equal numbers count in
the quantiles as often as their number has binary digits, so copies hardly
narrow a group's spread.

A bound lies ``SPREAD`` half interquartile ranges from the group's median. The
range is the group's own, or half of the median range of the groups of its
language where that is more. Groups
of few documents use the sketch merged over their language, and languages of
few documents the one merged over all. No bound is a fixed cutoff: where hardly
any spread is left (near copies fill the group) a share of the median stands in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm import scan
from glossa.llm.store import keep

SYMBOLS = b"#*$%&|<>"
#: ASCII punctuation.
MARKS = bytes([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
#: Values below stand for themselves; beyond, each doubling has GRID / 2 steps.
GRID = 10_000
#: Documents that a group needs for thresholds of its own.
ENOUGH = 30
#: Metric, its value in grid steps (null: not judged), and whether it has a bound below and above the median. The small summand makes whole quotients of logarithms whole.
RULES = (
    ("mean_chars", "word_chars * 100 div n_words", True, True),
    ("marks", "n_marks * 1000 div n_words", False, True),
    ("variety", "if(n_words > 1, cast(floor(1000 * ln(n_distinct) / ln(n_words) + 1e-6) as bigint), null)", True, False),
)
#: Values over fewer words than this scatter more; their bounds are wider by the square root of the ratio.
STEADY = 100
#: Half interquartile ranges between the median and a bound: 5.4 standard deviations where values are normal.
SPREAD = 8
#: A bound is at least this part of the median away from it; that decides only where the quartiles nearly meet.
LEAST = 20

#: Groups whose thresholds (some 100 bytes each) go to every task; more are joined over salted keys.
MOST_GROUPS, SALTS = 100_000, 64

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_distinct")


def same_text_repeats(keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the items of texts: whether an equal one comes earlier in the same text, and whether there is any other."""
    mixed = scan.mix(keys ^ scan.mix(own.astype(np.uint64) + scan.U(1)))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    earlier, other = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:][same]] = True
    other[order[1:][same]] = True
    other[order[:-1][same]] = True
    return earlier, other


def text_stats(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of ``STATS`` for each text."""
    m = len(offs) - 1
    if not len(data):
        return np.zeros((m, len(STATS)), np.int64)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offs[1:]] - sums[offs[:-1]]

    starts, ends, h, own = scan.words(data, offs)
    n_words = np.bincount(own, minlength=m)
    chars = per_text(~scan.SPACE[data] & ((data & 0xC0) != 0x80))
    symbols, marks = (per_text(np.isin(data, np.frombuffer(kind, np.uint8))) for kind in (SYMBOLS, MARKS))
    said, _ = same_text_repeats(h, own)
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_ends = line_ends - (data[line_ends - 1] == 10)
    first_word = np.searchsorted(starts, line_starts)
    has_word = (first_word < len(starts)) & (np.append(starts, len(data) + 1)[first_word] < line_ends)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_own = np.searchsorted(offs, line_starts, "right") - 1
    earlier, _ = same_text_repeats(scan.span_hashes(data, line_starts, line_ends, 2), line_own)
    n_dup = np.bincount(line_own[earlier], minlength=m)
    g = scan.grams(h, 5)
    at = np.flatnonzero(own[: len(g)] == own[4:][: len(g)])
    _, again = same_text_repeats(g[at], own[at])
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + 5, -1)
    n_repeat = np.bincount(own[np.cumsum(cover)[:-1] > 0], minlength=m)
    return np.stack([n_words, chars, symbols, n_dup, n_repeat, marks, n_words - np.bincount(own[said], minlength=m)], axis=1)


def measured(keep_rows: int, inside: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(``keep_rows`` columns, text) to those columns and STATS; ``inside``: the text is a field of the first column, a whole row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(0).field("text")], ["text"]) if inside else batch.select([keep_rows])
            for a, b, offs, data in scan.chunks(texts, 0):
                s = text_stats(data, offs)
                names = [*batch.schema.names[:keep_rows], *STATS]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in range(keep_rows)), *(pa.array(s[:, j]) for j in range(len(STATS)))], names)

    return measure


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n, docs): the sketches of all groups, over documents with words; docs counts rows, n those of equal numbers by the digits of their number."""
    rows = stats.where("n_words > 0").groupBy("lang", "source", *STATS).agg(F.count("*").alias("docs"))
    rows = rows.select("lang", "source", "docs", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.expr(v).alias("value")) for m, v, _, _ in RULES))).alias("v")).where("v.value is not null")
    step = f"shiftleft(1L, length(bin(v.value div {GRID})))"
    rows = rows.select("lang", "source", "docs", "v.metric", F.expr(f"if(v.value < {GRID}, v.value, v.value - v.value % {step})").alias("bucket"))
    return rows.groupBy("lang", "source", "metric", "bucket").agg(F.sum(F.length(F.bin("docs")).cast("long")).alias("n"), F.sum("docs").alias("docs"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, docs, q25, q50, q75) of sketches merged over ``keys``."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    group = Window.partitionBy(*keys, "metric")
    upto = F.sum("n").over(group.orderBy("bucket"))
    ranked = merged.select(*keys, "metric", "bucket", "docs", upto.alias("upto"), F.sum("n").over(group).alias("total"))
    return ranked.groupBy(*keys, "metric").agg(F.sum("docs").alias("docs"), *(F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket"))).alias(f"q{q * 25}") for q in (1, 2, 3)))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang_key, source_key, <metric>_mid, _far: the median and the distance allowed from it) for every group; keys are as ``group_keys`` makes them."""
    sketch = sketch.select(*group_keys(), "metric", "bucket", "n", "docs")
    own = quartiles(sketch, ["lang_key", "source_key"])
    by_lang = quartiles(sketch, ["lang_key"]).select("lang_key", "metric", F.struct("docs", "q25", "q50", "q75").alias("l"))
    all_ = quartiles(sketch, []).select("metric", F.struct("docs", "q25", "q50", "q75").alias("a"))
    q = own.select("lang_key", "source_key", "metric", F.struct("docs", "q25", "q50", "q75").alias("o")).join(by_lang, ["lang_key", "metric"]).join(all_, "metric")
    q = q.withColumn("q", F.when(F.col("o.docs") >= ENOUGH, F.col("o")).when(F.col("l.docs") >= ENOUGH, F.col("l")).otherwise(F.col("a")))
    # of the groups with sketches of their own
    usual = q.where(F.col("o.docs") >= ENOUGH).groupBy("lang_key", "metric").agg(F.floor(F.percentile(F.expr("o.q75 - o.q25"), 0.5)).alias("usual"))
    q = q.join(usual, ["lang_key", "metric"], "left")
    far = F.expr(f"greatest(1, {SPREAD} * greatest(2 * (q.q75 - q.q25), usual) div 4, q.q50 div {LEAST})")
    parts = (("mid", F.col("q.q50")), ("far", far))
    return q.groupBy("lang_key", "source_key").agg(*(F.max(F.when(F.col("metric") == m, c)).alias(f"{m}_{part}") for m, _, _, _ in RULES for part, c in parts))


def group_keys() -> list:
    """Language and source as keys to join on; null is a value of its own."""
    return [F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(f"{c}_key") for c in ("lang", "source")]


def verdict(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """``stats`` with base_failed, kept and the thresholds used; a group may hold any share of the rows."""
    on, keyed = ["lang_key", "source_key"], stats.select("*", *group_keys())
    if limits.count() <= MOST_GROUPS:
        limits = F.broadcast(limits)
    else:
        on = [*on, "salt"]
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("n_words", "word_chars", "n_marks"), F.lit(SALTS)))
        limits = limits.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    s = keyed.join(limits, on, "left").drop(*on)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    wider = F.sqrt(F.greatest(F.lit(1.0), F.lit(float(STEADY)) / F.greatest(F.col("n_words"), F.lit(1))))
    fine = F.lit(True)
    for metric, value, below, above in RULES:
        off, far = F.when(F.col("n_words") > 0, F.expr(value)) - F.col(f"{metric}_mid"), F.col(f"{metric}_far") * wider
        for bounded, near in ((below, off >= -far), (above, off <= far)):
            if bounded:
                fine &= F.coalesce(near, F.lit(True))
    return s.withColumns({"base_failed": base, "kept": ~base & fine})


def text_column() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): doc_id, STATS, base_failed, kept, thresholds.

    base_failed: fewer than 10 words, or over 20 % of them in 5-word windows
    that come twice or more. Others are kept if mean word length, marks per word
    and variety lie within the group's bounds. Null text: no words. Null lang or
    source: a group of its own. Empty table: no rows. Rows that share a doc_id
    are judged each. Other columns are ignored.
    """
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in STATS)
    stats = keep(docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), text_column()).mapInArrow(measured(3), schema), "stats")
    return verdict(stats, keep(thresholds(sketches(stats)), "limits"))


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; equal rows stay or go together.

    Texts are read twice, for the thresholds and for the verdict, and never shuffled.
    """
    groups = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    numbers = T.StructType([T.StructField(c, T.LongType()) for c in STATS])
    pair = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
    stats = keep(docs.select(*groups, text_column()).mapInArrow(measured(2), T.StructType([*pair, *numbers])), "stats")
    limits = keep(thresholds(sketches(stats)), "limits")
    rows = docs.select(F.struct("*").alias("row"), *groups)
    again = rows.mapInArrow(measured(3, inside=True), T.StructType([rows.schema["row"], *pair, *numbers]))
    return verdict(again, limits).where("kept").select("row.*")
