"""A session with the settings that the engine relies on."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, **settings: str) -> SparkSession:
    b = SparkSession.builder.appName("glossa").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster where it isn't installed; the driver serves it, nothing is shared by path."""
    root, at = Path(__file__).resolve().parent, f"{tempfile.mkdtemp(prefix='glossa-')}/glossa.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(at)


_reached: set[str] = set()


def reach(spark: SparkSession) -> None:
    """``ship``, once for an application, if its workers can't import this package."""

    def found(name: str) -> bool:
        from importlib.util import find_spec

        return find_spec(name) is not None

    app = spark.sparkContext.applicationId
    if app not in _reached:
        if not spark.range(1).select(F.udf(found, "boolean")(F.lit(Path(__file__).resolve().parent.name)).alias("found")).first().found:
            ship(spark)
        _reached.add(app)


def cut_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the session names in spark.checkpoint.dir; a local session without one gets a folder of our own."""
    if not spark.sparkContext.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="glossa-"))


def bucketed(df: DataFrame, by: str, deal: bool = True) -> DataFrame:
    """``df`` written to the checkpoint folder in buckets of ``by`` and read again: tables of one ``by`` are joined and grouped on it without a shuffle.

    ``deal`` False: ``df`` stems from such tables and is dealt by ``by`` already.
    """
    spark, name = df.sparkSession, f"glossa_{uuid.uuid4().hex}"
    cut_folder(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    (df.repartition(buckets, by) if deal else df).write.bucketBy(buckets, by).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out._glossa_table, out._glossa_path = name, path
    return out


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read again."""
    spark = df.sparkSession
    cut_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/glossa_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._glossa_table, out._glossa_path = None, path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that ``bucketed`` or ``written`` wrote and nothing reads any more."""
    for t in tables:
        if t is not None:
            if t._glossa_table:
                t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._glossa_table}")
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._glossa_path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def held(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for what is planned and run inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)
