"""Mixing of sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SALTS = 64


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drawn(seed: int, name: Column) -> Column:
    """32 bits that seed and name decide; null as the empty name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(name, F.lit("")))), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, weigh ``weights``, repeated. They
    share ``share`` times all sizes by weight; a target stops at ``cap`` times
    its source's size, and the rest is shared again until none is above: all
    open targets are then one level times their weight, and the sources below
    it are those with the least cap per weight. One row per source is sorted in
    one task, twice.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank - 1) % len(weights) + 1))
    s = s.withColumn("top", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("w").over(after))
    s = s.withColumn("full", F.col("top") <= F.col("level") * F.col("w"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return s.select("source", "source_size", F.when(F.col("full"), F.col("top")).otherwise(level * F.col("w")).alias("target"))


def copies(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 0, ties: Sequence[str] = ()) -> DataFrame:
    """``rows`` (doc_id, source, size, others) with source_size, target and copies.

    Each document of a source expects target / source_size copies. Within the
    source, documents stand in order of size class, slot and size; the sum of
    expected copies runs along them from one random offset, and a document gets
    one copy for each integer that its own part crosses. Running sums come
    from counts per (source, class, slot), so that no task holds a source.
    Equal sizes stand together, so the sizes taken come near the target too.
    Columns ``ties`` order rows that agree in size and doc_id.
    """
    cls = F.expr("length(bin(size + 1)) * 4 + shiftright((size + 1) * 4, length(bin(size + 1)) - 1)").cast("int")  # four classes an octave
    slot = (drawn(seed, F.col("doc_id").cast("string")) % SALTS).cast("int")
    names = {"name": F.coalesce("source", F.lit("")), "unnamed": F.col("source").isNull()}
    d = rows.withColumns({"class": cls, "slot": slot} | names)
    key = ["name", "unnamed", "class", "slot"]
    targets = source_targets(d.select("source", "size"), weights, share, cap).withColumns(names).drop("source")
    along = Window.partitionBy("name", "unnamed").orderBy("class", "slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy(*key).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("n")
    d = d.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy("size", "doc_id", *ties)))
    d = d.join(starts.join(targets, ["name", "unnamed"]), key)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = (drawn(seed, F.when(~F.col("unnamed"), F.concat(F.lit("="), "name"))) % 65536) / F.lit(65536.0)
    end = F.col("start") + F.col("at")
    crossed = F.floor(end * rate + offset) - F.floor((end - 1) * rate + offset)
    return d.withColumn("copies", F.least(crossed, F.lit(int(-(-cap // 1)))).cast("long")).drop(*key, "start", "at")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """``docs`` (doc_id, text, source, others) with each row as often as the mix takes it; sizes are words.

    Null text: no words. Null source: a source of its own, the last. Rows that
    share a doc_id count each, in the order of a hash of all their columns, so
    that reruns agree. A source without words has target 0. Empty
    table: no rows. All columns of ``docs`` stay, whatever their names.
    """
    row, names = F.struct("*"), ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    marked = [x for c in names for x in (F.col(c).isNull(), F.col(c))]
    rows = docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64(*marked).alias("tie"), row.alias("row"))
    taken = copies(rows, weights, share, cap, seed, ["tie"]).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
