"""Sentences' tokens are made once, and bigrams are shuffled as numbers."""

import re

import pytest
from pyspark.sql import functions as F

from glossa.functions import text
from glossa.operators import language_model
from glossa.plans import registry


@pytest.fixture
def tables(spark, tmp_path):
    rows = [(i, ("en", "fr", None)[i % 3], None if i == 7 else f"the cat sat {i % 4}\nl'homme,  a cat\x1c.\n" * (i % 3)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_tokens_are_made_once(spark, tables):
    plan = registry.ngram_uni_counts(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("SENTSTART", plan)) == 2  # an English and a French path


def test_bigrams_travel_as_numbers(spark, tables):
    plan = registry.lm_perplexity_sweep(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and re.search(r"\bw[12]#", line)]


def test_white_space(spark):
    every = "".join(map(chr, range(1, 0x3100)))
    row = spark.createDataFrame([(every + "a" + every,)], "s string").select(text.strip(F.col("s")).alias("s"), text.tokens(F.col("s")).alias("t"), F.expr(r"regexp_replace(s, '(?U)^[\\s\\x1C-\\x1F]+|[\\s\\x1C-\\x1F]+$', '')").alias("old"), F.expr(r"filter(split(s, '(?U)[\\s\\x1C-\\x1F]+'), x -> x <> '')").alias("old_t")).first()
    assert row.s == row.old and row.t == row.old_t and len(row.t) > 10
