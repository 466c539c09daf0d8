"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.store import discard, keep


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node reachable over ``edges`` (u, v of one type that has an order); nodes with no edge are absent.

    Each step moves as many rows as there are edges; minima are pre-aggregated
    and joined back, so that a node with very many edges is split like any
    skewed join. Loops and repeated edges have no effect; no edges: no rows.
    """
    e = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = keep(small.unionByName(m.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(e)
        e = new
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        last = now
