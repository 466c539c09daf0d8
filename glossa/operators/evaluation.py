"""BLEU, word error rate and classification metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.guards import ratio_or_nan
from glossa.functions.text import ngrams, once


def ngram_precision(candidate: Column, references: list[Column], n: int) -> Column:
    """The share of the candidate's n-grams that any reference holds, without clipping; null for a candidate that is too short."""
    known = ngrams(references[0], n)
    for r in references[1:]:
        known = F.array_union(known, ngrams(r, n))
    own = ngrams(candidate, n)
    hits = once(known, lambda k: F.size(F.filter(own, lambda g: F.array_contains(k, g))))
    return F.when(F.size(own) > 0, hits / F.size(own))


def brevity_penalty(candidate: Column, references: list[Column]) -> Column:
    """1 if the closest reference (the first of those) is shorter than the candidate, else exp(1 - r / c); null for c = 0."""
    c = F.size(candidate)
    closest = F.array_min(F.array(*(F.struct(F.abs(F.size(r) - c).alias("d"), F.lit(i).alias("i"), F.size(r).alias("n")) for i, r in enumerate(references))))["n"]
    q = F.try_divide(closest.cast("double"), c.cast("double"))
    return F.when(q < 1, F.lit(1.0)).otherwise(F.exp(1 - q))


def gram_hashes(toks: Column, n: int) -> Column:
    """64-bit hashes of the n-grams of ``toks``."""
    return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.xxhash64(F.slice(toks, i, n)))).otherwise(F.array().cast("array<bigint>"))


def bleu_scores(candidate: Column, references: list[Column], orders: Sequence[int] = (1, 2, 3)) -> Column:
    """``bleu`` of each of ``orders`` as an array; precisions are taken once for all of them, over 64-bit hashes of n-grams."""

    def precision(n: int) -> Column:
        missing = gram_hashes(candidate, n)
        for r in references:
            missing = F.array_except(missing, gram_hashes(r, n))
        return once(gram_hashes(candidate, n), lambda own: once(missing, lambda gone: F.when(F.size(own) > 0, F.size(F.filter(own, lambda g: ~F.array_contains(gone, g))) / F.size(own))))

    def mean(p: Column, n: int) -> Column:
        some = F.slice(p, 1, n)
        return F.when(F.exists(some, lambda x: x.isNull()), None).when(F.exists(some, lambda x: x == 0), 0.0).otherwise(F.exp(F.aggregate(some, F.lit(0.0), lambda s, x: s + F.log(x)) / n))

    ps = F.array(*(precision(n) for n in range(1, max(orders) + 1)))
    return once(F.struct(brevity_penalty(candidate, references).alias("bp"), ps.alias("p")), lambda x: F.array(*(x["bp"] * mean(x["p"], n) for n in orders)))


def bleu(candidate: Column, references: list[Column], n: int) -> Column:
    """Brevity penalty times the geometric mean of the precisions of orders 1 to n; a zero precision gives 0."""
    return bleu_scores(candidate, references, (n,))[0]


def edit_counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int]:
    """Substitutions, insertions, deletions on the path that prefers deletion, then insertion, then (mis)match.

    The counts of a cell's path go along with its distance, a row at a time:
    from above, from above and left, or from the last cell to the left that is
    reached otherwise. Memory is a few rows, whatever the product of the
    lengths.
    """
    names: dict[str, int] = {}
    r = np.array([names.setdefault(w, len(names)) for w in ref], np.int64)
    h = np.array([names.setdefault(w, len(names)) for w in hyp], np.int64)
    steps = np.arange(len(h) + 1)
    dist, ins, dels = steps, steps, np.zeros(len(h) + 1, np.int64)
    for i in range(1, len(r) + 1):
        near = np.empty(len(h) + 1, np.int64)
        near[0] = i
        np.minimum(dist[1:] + 1, dist[:-1] + (h != r[i - 1]), out=near[1:])
        now = np.minimum.accumulate(near - steps) + steps
        deleted = now == dist + 1
        inserted = ~deleted
        inserted[0] = False
        inserted[1:] &= now[1:] == now[:-1] + 1
        back = steps - ~deleted
        last = np.maximum.accumulate(np.where(inserted, 0, steps))
        dels, ins, dist = (dels[back] + deleted)[last], ins[back][last] + steps - last, now
    return int(dist[-1] - ins[-1] - dels[-1]), int(ins[-1]), int(dels[-1])


def edit_counts_of(pairs: Sequence[tuple[list[str], list[str]]]) -> list[tuple[int, int, int]]:
    """``edit_counts`` of many pairs; those of like length go a row at a time together, up to ``CELLS`` cells a row."""
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]) // 8, len(pairs[i][0])))
    at = 0
    while at < len(order):
        end, wide, high = at, 0, 0
        while end < len(order):
            r, h = pairs[order[end]]
            if end > at and ((end - at + 1) * (max(wide, len(h)) + 1) > CELLS or (end - at + 1) * max(high, len(r)) > 16 * CELLS):
                break
            wide, high, end = max(wide, len(h)), max(high, len(r)), end + 1
        for i, found in zip(order[at:end], _edit_counts_side_by_side([pairs[i] for i in order[at:end]], wide), strict=True):
            out[i] = found
        at = end
    return out


def _edit_counts_side_by_side(pairs: list[tuple[list[str], list[str]]], wide: int) -> list[tuple[int, int, int]]:
    names: dict[str, int] = {}
    n = np.array([len(r) for r, _ in pairs])
    ends = np.array([len(h) for _, h in pairs])
    refs, hyps = np.full((len(pairs), max(int(n.max()), 1)), -1, np.int32), np.full((len(pairs), wide), -2, np.int32)
    for k, (r, h) in enumerate(pairs):
        refs[k, : len(r)] = [names.setdefault(w, len(names)) for w in r]
        hyps[k, : len(h)] = [names.setdefault(w, len(names)) for w in h]
    steps = np.arange(wide + 1, dtype=np.int32)
    dist = np.repeat(steps[None], len(pairs), 0)
    ins, dels = dist, np.zeros_like(dist)
    out = np.zeros((len(pairs), 3), np.int64)
    alive = np.arange(len(pairs))
    for i in range(int(n.max()) + 1):
        if i:
            near = np.empty_like(dist)
            near[:, 0] = i
            np.minimum(dist[:, 1:] + 1, dist[:, :-1] + (hyps != refs[:, i - 1, None]), out=near[:, 1:])
            now = np.minimum.accumulate(near - steps, axis=1) + steps
            deleted = now == dist + 1
            inserted = ~deleted
            inserted[:, 0] = False
            inserted[:, 1:] &= now[:, 1:] == now[:, :-1] + 1
            last = np.maximum.accumulate(np.where(inserted, 0, steps), axis=1)
            kept = np.take_along_axis(deleted, last, 1)
            back = last - ~kept
            dels = np.take_along_axis(dels, back, 1) + kept
            ins = np.take_along_axis(ins, back, 1) + steps - last
            dist = now
        over = n[alive] == i
        if over.any():
            rows, col = np.flatnonzero(over), ends[alive[over]]
            d, a, b = dist[rows, col], ins[rows, col], dels[rows, col]
            out[alive[over]] = np.stack([d - a - b, a, b], 1)
            alive, dist, ins, dels, refs, hyps = alive[~over], dist[~over], ins[~over], dels[~over], refs[~over], hyps[~over]
    return [tuple(x) for x in out.tolist()]


#: Cells of a row of edit tables that are filled side by side, a 16th of the words of their references; pairs that a task takes together.
CELLS, SLICE = 1 << 14, 1024


def word_errors(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with s, i, d, n_ref and wer of ``pairs`` (keys, ref, hyp: arrays of tokens); an empty reference: infinity.

    Rows are few bytes but much work, so they are dealt anew into a fixed number
    of parts; parts of few bytes would be joined into long tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                k = len(keys)
                refs = [r or [] for r in b.column(k).to_pylist()]
                found = edit_counts_of(list(zip(refs, (h or [] for h in b.column(k + 1).to_pylist()), strict=True)))
                cols = [pa.array([f[j] for f in found], pa.int64()) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*b.columns[:k], *cols, pa.array([len(r) for r in refs], pa.int64())], [*keys, "s", "i", "d", "n_ref"])

    src = pairs.select(*keys, "ref", "hyp")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(keys)]) + ", s long, i long, d long, n_ref long"
    out = src.repartition(max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * pairs.sparkSession.sparkContext.defaultParallelism), *keys).mapInArrow(run, schema)
    wrong = (F.col("s") + F.col("i") + F.col("d")).cast("double")
    return out.withColumn("wer", F.when(F.col("n_ref") == 0, F.lit(float("inf"))).otherwise(F.try_divide(wrong, F.col("n_ref"))))


def edit_distance_expression(ref: Column, hyp: Column) -> Column:
    """The token edit distance as a Spark expression, for short texts (each cell copies its row)."""
    first = F.transform(F.concat(F.array(F.lit("")), hyp), lambda _, j: j)

    def row(prev: Column, r: Column) -> Column:
        start = F.struct(F.array(F.element_at(prev, 1) + 1).alias("row"), F.lit(1).alias("j"))

        def cell(s: Column, h: Column) -> Column:
            best = F.least(F.get(prev, s["j"]) + 1, F.element_at(s["row"], -1) + 1, F.get(prev, s["j"] - 1) + F.when(h == r, 0).otherwise(1))
            return F.struct(F.array_append(s["row"], best).alias("row"), (s["j"] + 1).alias("j"))

        return F.aggregate(hyp, start, cell)["row"]

    return F.element_at(F.aggregate(ref, first, row), -1)


def error_summary(lines: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of wer over all lines of a group; an infinite line makes them infinite and NaN."""
    return lines.groupBy(*by).agg(F.count("*").alias("n_lines"), F.avg("wer").alias("mean_wer"), F.stddev_pop("wer").alias("std_wer"))


def bleu_report(scores: DataFrame, by: Sequence[str], orders: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(by, n, lines, mean_bleu) of ``scores`` (by, bleu1, bleu2, ...): a row per model and n. Lines without a score don't count."""
    rows = scores.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"bleu{n}").alias("bleu")) for n in orders))).alias("s"))
    return rows.groupBy(*by, "s.n").agg(F.count("s.bleu").alias("lines"), F.avg("s.bleu").alias("mean_bleu"))


def system_errors(lines: DataFrame, keys: Sequence[str], systems: Sequence[str]) -> DataFrame:
    """``word_errors`` of each of ``systems`` (columns of ``lines`` with their tokens, beside ref), a row per line and system.

    A line that one of them lacks (null) counts for none, as files that are
    read side by side end with the shortest.
    """
    whole = lines.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in ("ref", *systems)]))
    pairs = whole.select(*keys, "ref", F.explode(F.array(*(F.struct(F.lit(s).alias("system"), F.col(s).alias("hyp")) for s in systems))).alias("x"))
    return word_errors(pairs.select(*keys, "x.system", "ref", "x.hyp"), [*keys, "system"])


def confusion(pred: DataFrame) -> DataFrame:
    """(label, pred, n) over all pairs of the labels that occur on either side, absent ones with 0."""
    labels = pred.select(F.explode(F.array("label", "pred")).alias("label")).distinct()
    counts = pred.groupBy("label", "pred").agg(F.count("*").alias("n"))
    # one row per pair of classes
    return labels.crossJoin(labels.select(F.col("label").alias("pred"))).join(counts, ["label", "pred"], "left").na.fill(0, ["n"])


def metrics_row(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, accuracy, recall, precision, confusion): a confusion table (by, label, pred, n) as one row, classes in order, counts row by row."""
    w = {k: F.sum("n").over(Window.partitionBy(*by, k)) for k in ("label", "pred")}
    m = matrix.withColumns({"row": w["label"], "col": w["pred"]})
    same = F.col("label") == F.col("pred")

    def of_classes(total: str) -> Column:
        each = F.sort_array(F.collect_list(F.when(same, F.struct("label", ratio_or_nan(F.col("n"), F.col(total)).alias("x")))))
        return F.transform(each, lambda s: s["x"])

    counts = F.transform(F.sort_array(F.collect_list(F.struct("label", "pred", "n"))), lambda s: s["n"])
    accuracy = ratio_or_nan(F.sum(F.when(same, F.col("n")).otherwise(0)), F.sum("n"))
    return m.groupBy(*by).agg(accuracy.alias("accuracy"), of_classes("row").alias("recall"), of_classes("col").alias("precision"), counts.alias("confusion"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """(label, recall, precision, accuracy) of a confusion table; 0 / 0 is NaN."""
    m = matrix.withColumns({"row": F.sum("n").over(Window.partitionBy("label")), "col": F.sum("n").over(Window.partitionBy("pred"))})
    total = matrix.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("right"))
    diag = m.where("label = pred").crossJoin(F.broadcast(total))  # one row
    return diag.select("label", ratio_or_nan(F.col("n"), F.col("row")).alias("recall"), ratio_or_nan(F.col("n"), F.col("col")).alias("precision"), ratio_or_nan(F.col("right"), F.col("total")).alias("accuracy"))
