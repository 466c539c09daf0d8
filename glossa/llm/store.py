"""Intermediate tables in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that the session names; without one a temporary folder, which only a local session can share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="glossa-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def keep(df: DataFrame, name: str, row_group: int = 64 << 20, compression: str = "zstd", to: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, or to the folder ``to``, and read it back: cuts the lineage, survives lost executors."""
    path = to or f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).option("parquet.block.size", row_group).parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    if not to:
        kept._glossa_path = path
    return kept


def keep_sorted(df: DataFrame, name: str, by: str, *then: str) -> DataFrame:
    """``keep`` as a table in buckets of ``by``, each sorted by it and ``then``: tables of as many buckets are merge-joined on ``by`` without a shuffle of either."""
    spark, tag = df.sparkSession, uuid.uuid4().hex
    path, table, n = f"{shared_dir(spark)}/{name}-{tag}", f"glossa_{tag}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, by).write.bucketBy(n, by).sortBy(by, *then).option("compression", "zstd").option("path", path).saveAsTable(table)
    kept = spark.table(table)
    kept._glossa_path, kept._glossa_table = path, table
    return kept


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is run inside: Spark counts rows, not bytes, and rows may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` wrote and nothing reads any more, and free shuffle files of finished steps."""
    for t in tables:
        if name := getattr(t, "_glossa_table", None):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        path = getattr(t, "_glossa_path", None)
        if path:
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def keyed(docs: DataFrame) -> DataFrame:
    """(did, th, text): did is doc_id (null: the least long), th, 64 bits of the text's hash, tells rows apart that share a doc_id.

    Rows equal in both doc_id and text share one key.
    """
    return docs.select(*row_key(), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def row_key() -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("th")


def doc_id_back(col: str = "did") -> Column:
    return F.when(F.col(col) != NO_ID, F.col(col))
