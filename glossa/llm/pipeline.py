"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``. An empty table gives an
empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.decontamination import clean_documents
from glossa.llm.mixing import mix
from glossa.llm.near_duplicates import near_duplicates
from glossa.llm.quality import good_documents
from glossa.llm.sharding import assign, even_map, map_table, rebalance, slot_bytes
from glossa.llm.store import NO_ID, discard, keep, row_key

SHARDS = 40


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep.

    Null text: no words, so it goes. Null lang or source: a group of its own.
    Rows equal in doc_id, text, lang and source stay or go together.
    """
    return good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one with the least doc_id; repeated rows go.

    Groups are of rows, by doc_id and text: rows that share a doc_id, or have
    none, stay unless their texts are near copies or both equal. Null and empty
    texts are near copies of nothing. Null doc_id: less than all others.
    """
    groups = near_duplicates(docs.select("doc_id", "text"), by_row=True)
    gone = groups.where("not kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "th").distinct()
    rows = docs.select(*row_key(), F.struct("*").alias("row")).join(gone, ["did", "th"], "left_anti")
    return rows.dropDuplicates(["did", "th"]).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null text: none; null doc_ids and repeated rows are judged by their texts."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null source: the last one; repeated rows count each."""
    return mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with virtual slot, shard and place within the shard.

    Version 1 of the slot map is even; version 2, which decides, is edited by
    the bytes of the slots so that shards are near equal. Null doc_id: hashed
    as one value; null text: 16 bytes.
    """
    owners = even_map(SHARDS)
    shard_map = keep(map_table(spark, [owners, rebalance(owners, slot_bytes(docs))]), "shard-map")
    return assign(docs, shard_map)[0]


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix_sources), ("shard", shard)]
#: No SQL: near-duplicate groups and edit distances are beyond it. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            discard(docs)
        docs = done
    return docs
