"""Text reports as lines with a key to sort by; ``readers.write_lines`` writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line(template: str, *values: Column) -> Column:
    return F.format_string(template, *values).alias("value")


def perplexity_lines(table: DataFrame) -> DataFrame:
    """Of (lang, delta, perplexity): a heading, then a line per language and smoothing."""
    rows = table.select(F.struct(F.lit(1).alias("part"), "delta", "lang").alias("at"), line("%s, %s, %.4f", F.upper("lang"), F.col("delta").cast("string"), F.col("perplexity")))
    head = table.sparkSession.range(1).select(F.struct(F.lit(0).alias("part"), F.lit(0.0).alias("delta"), F.lit("").alias("lang")).alias("at"), F.lit("Language, Delta, Perplexity").alias("value"))
    return head.unionByName(rows)


def bleu_lines(scores: DataFrame, report: DataFrame) -> DataFrame:
    """Of sentence scores (model, line_no, n, bleu) and their means (model, n, mean_bleu): each mean, then its scores."""
    means = report.select(F.struct("model", "n", F.lit(-1).cast("long").alias("line_no")).alias("at"), line("%s: BLEU scores with %d-gram: (Average %.4f)", F.col("model").cast("string"), F.col("n"), F.col("mean_bleu")))
    return means.unionByName(scores.select(F.struct("model", "n", F.col("line_no").cast("long").alias("line_no")).alias("at"), line("\t%.4f", F.col("bleu"))))


def error_lines(errors: DataFrame, summary: DataFrame) -> DataFrame:
    """Of lines (speaker, system, line_no, wer, s, i, d) and (system, mean_wer, std_wer): each line, then a line of averages per system."""
    each = errors.select(F.struct(F.lit(0).alias("part"), F.col("speaker").cast("string").alias("speaker"), F.col("line_no").cast("long").alias("line_no"), "system").alias("at"), line("[%s] %s %d %.3f S:%d, I:%d, D:%d", F.col("speaker").cast("string"), F.col("system"), F.col("line_no"), F.col("wer"), F.col("s"), F.col("i"), F.col("d")))
    last = summary.select(F.struct(F.lit(1).alias("part"), F.lit("").alias("speaker"), F.lit(0).cast("long").alias("line_no"), "system").alias("at"), line("%s WER Avg: %.4f %s WER StD: %.4f", F.col("system"), F.col("mean_wer"), F.col("system"), F.col("std_wer")))
    return each.unionByName(last)


def speaker_lines(table: DataFrame) -> DataFrame:
    """Of ``mixtures.sweep`` rows: a line per setting."""
    return table.select(F.struct("m", "max_iter", "trained").alias("at"), line("M: %d, maxIter: %d, S: %s, Accuracy: %s", F.col("m"), F.col("max_iter"), F.coalesce(F.col("trained").cast("string"), F.lit("all")), F.col("accuracy").cast("string")))
