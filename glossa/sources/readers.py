"""Sources and sinks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.text import strip
from glossa.operators.features import last_wins, positional_features
from glossa.sources.ordered import write_ordered
from glossa.sources.ranges import numbered_lines, read_json_arrays, read_matrices


def read_comments(spark: SparkSession, folder: str) -> DataFrame:
    """(id, body, cat, file_pos) from files that each hold a JSON array of JSON strings; the file's name is the class. Files of any size are read in ranges."""
    element = F.from_json(F.concat(F.lit("["), "raw", F.lit("]")), "array<string>")[0]
    rows = read_json_arrays(spark, folder).select(F.col("file").alias("cat"), F.col("pos").cast("int").alias("file_pos"), element.alias("j"))
    return rows.select(F.get_json_object("j", "$.id").alias("id"), F.get_json_object("j", "$.body").alias("body"), "cat", "file_pos")


def read_lexicon(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV with header, all cells text; of repeated keys the last row wins."""
    rows = spark.read.option("header", "true").csv(path)
    # splits of a file may be read in any order, but each knows where it starts
    placed = rows.withColumns({"_file": F.col("_metadata.file_name"), "_start": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    return last_wins(placed, key, ["_file", "_start", "_at"]).drop("_file", "_start", "_at")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("entry"))


def read_lines(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(doc, line_no, text) of the files in ``folder`` with that suffix; doc is the name without it."""
    lines = numbered_lines(spark, folder, f"*.{suffix}")
    return lines.select(F.regexp_replace(file_name(), rf"\.{suffix}$", "").alias("doc"), "line_no", "text")


def file_name() -> Column:
    return F.url_decode(F.element_at(F.split("path", "/"), -1))


def read_pairs(spark: SparkSession, folder: str, e: str = "e", f: str = "f") -> DataFrame:
    """(doc, line_no, e, f): documents and lines that both languages have."""
    a, b = read_lines(spark, folder, e), read_lines(spark, folder, f)
    return a.withColumnRenamed("text", "e").join(b.withColumnRenamed("text", "f"), ["doc", "line_no"])


def read_test_triples(spark: SparkSession, source: str, human: str, machine: str) -> DataFrame:
    """(line_no, src, ref_human, ref_machine) of three aligned files."""

    def one(path: str, name: str) -> DataFrame:
        return numbered_lines(spark, path).select("line_no", F.col("text").alias(name))

    return one(source, "src").join(one(human, "ref_human"), "line_no").join(one(machine, "ref_machine"), "line_no")


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(speaker, utt, t, x) from <speaker>/*npy files of (T, d) matrices."""
    parts = F.split("path", "/")
    return read_matrices(spark, folder, "*npy").select(F.element_at(parts, -2).alias("speaker"), F.element_at(parts, -1).alias("utt"), F.col("row").alias("t"), F.col("features").alias("x"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, features) of the sole array of each npy or npz file at ``path``."""
    return read_matrices(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "row", "features")


def read_external_features(spark: SparkSession, folder: str, classes: tuple[str, ...] = ("Alt", "Center", "Left", "Right"), ids: str = "{}_IDs.txt", matrix: str = "{}_feats.dat.npy") -> DataFrame:
    """(id, feats) from a text file of ids and a matrix file for each class, joined by line; of repeated ids the last wins, classes in the order given."""

    def named(pattern: str, file: Column) -> Column:
        head, tail = (re.escape(x) for x in pattern.split("{}"))
        return F.regexp_extract(file, f"^{head}(.*){tail}$", 1)

    lines = numbered_lines(spark, [f"{folder}/{ids.format(c)}" for c in classes]).select(named(ids, file_name()).alias("cat"), F.col("line_no").alias("row"), F.col("text").alias("id"))
    rows = reduce(DataFrame.unionByName, [read_matrix(spark, f"{folder}/{matrix.format(c)}") for c in classes])
    return positional_features(lines.select("cat", "row", strip(F.col("id")).alias("id")), rows.select(named(matrix, F.col("file")).alias("cat"), "row", F.col("features").alias("feats")), classes)


def read_transcripts(spark: SparkSession, folder: str, names: dict[str, str]) -> DataFrame:
    """(speaker, line_no, system, text) of <speaker>/<file> for the speakers that have all of ``names`` (system to file name)."""
    table = F.create_map(*(F.lit(x) for s, n in names.items() for x in (n, s)))
    speaker = F.url_decode(F.element_at(F.split("path", "/"), -2))
    rows = numbered_lines(spark, folder, recursive=True).select(speaker.alias("speaker"), table[file_name()].alias("system"), "line_no", "text").where("system is not null")
    complete = rows.groupBy("speaker").agg(F.count_distinct("system").alias("n")).where(F.col("n") == len(names)).select("speaker")
    return rows.join(complete, "speaker", "left_semi").select("speaker", "line_no", "system", "text")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_model(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def cached_model(spark: SparkSession, root: str, name: str, params: dict, build) -> DataFrame:
    """The model table under a path that names all its parameters; built where it is absent."""
    key = "_".join(f"{k}={params[k]}" for k in sorted(params))
    path = f"{root.rstrip('/')}/{name}/{key}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        write_model(build(), path)
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows as comma-separated lines; a report is small."""
    write_ragged(df.select(*order, F.array(*(F.col(c).cast("string") for c in df.columns)).alias("cells")), path, order)


def write_ragged(rows: DataFrame, path: str, order: list[str]) -> None:
    """``rows`` (order, cells: array<string>, of any lengths) as comma-separated lines; cells with commas, quotes or line ends are quoted."""
    quoted = F.transform("cells", lambda c: F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit(""))))
    write_lines(rows.select(*order, F.array_join(quoted, ",").alias("value")), path, order)


def write_lines(rows: DataFrame, path: str, order: list[str]) -> None:
    """The column ``value`` of ``rows`` as one text file, in ``order``: tasks write their part, the commit joins them."""
    write_ordered(rows.orderBy(*order).select("value"), path)
