"""Empty tables, and tables of null and empty texts, through the chat format, every stage and the whole pipeline."""

import pytest

from glossa.llm import pipeline as corpus_pipeline
from glossa.llm.chat import format_conversations
from tests.llm.fixtures import SCHEMA, frame


def test_chat_of_no_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert format_conversations(none).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return at


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_of_empty_tables(spark, folder, name, stage):
    out = stage(spark, frame(spark, []), str(folder))
    assert out.count() == 0
    assert name == "shard" or out.columns == [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:3])
def test_filters_of_null_and_empty_texts(spark, folder, name, stage):
    rows = [(i, None if i % 2 else "", None, None, *[None] * 9) for i in range(6)] + [(None, None, None, None, *[None] * 9)]
    kept = stage(spark, frame(spark, rows), str(folder)).count()
    assert kept == (0 if name == "quality" else 7)


def test_run_of_an_empty_table(spark, folder, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(str(folder / "benchmark.parquet")).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
