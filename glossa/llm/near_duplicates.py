"""MinHash near-duplicates over word shingles with fast similarity sketches.

Texts are lower-cased (A-Z) and cut into words; a text's set holds its distinct
5-word shingles (fewer words: the whole sequence as one; no words: empty, linked
with nothing). Sets that are equal form one class; only one row of a class goes
on. Its sketch is cut into bands, whose hashes are buckets.

Links are confirmed on full sets. No bucket is turned into all its pairs: three
centres of each bucket are compared with its members; afterwards only pairs of
one bucket that still lie in different components are compared, first by
sketches in cells of a bounded number of members, then, where no sketch refused
them, by their sets in smaller cells, which give out nothing but links. So every
pair that shares a bucket ends in one component or has been refused by an exact
comparison or by a sketch more than 5 standard deviations too far off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm import scan
from glossa.llm.components import components
from glossa.llm.sketches import bands, fast_sketches, short
from glossa.llm.store import NO_ID, discard, doc_id_back, keep, keyed, small_batches

SHINGLE = 5


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All sets one after another (each sorted, distinct) and their sizes."""
    _, _, h, own = scan.words(data, offs, fold_case=True)
    n_words = np.bincount(own, minlength=len(offs) - 1)
    ends = np.cumsum(n_words)
    g = scan.grams(h, k)
    sets = []
    for n, e in zip(n_words.tolist(), ends.tolist(), strict=True):
        if n >= k:
            sets.append(np.unique(g[e - n : e - k + 1]))
        elif n:
            sets.append(scan.grams(h[e - n : e], n, seed=n))
        else:
            sets.append(h[:0])
    return np.concatenate(sets), np.array([len(x) for x in sets], np.int64)


def signatures(k: int, rows: int, n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offs, data in scan.chunks(batch, 2):
                x, sizes = shingle_sets(data, offs, k)
                ends = np.cumsum(sizes)
                digests = np.array([(int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")) for d in (xxhash.xxh3_128_digest(x[e - n : e].tobytes()) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True))], np.uint64)
                sk = fast_sketches(x, sizes, rows * n_bands)
                hashes = bands(sk, rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(sizes), scan.signed(digests[:, 0].copy()), scan.signed(digests[:, 1].copy()), pa.array([s.tobytes() for s in short(sk)], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * n_bands), scan.signed(hashes.reshape(-1)))],
                    ["did", "th", "n_shingles", "d1", "d2", "sketch", "bands"],
                )

    return run


def full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offs, data in scan.chunks(batch, 2):
                x, sizes = shingle_sets(data, offs, k)
                cut = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.ListArray.from_arrays(cut, scan.signed(x))], ["did", "th", "items"])

    return run


def close_sketches(least: float):
    """Keeps the pairs whose sketches agree in ``least`` of all coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (4, 5))
            yield batch.select(range(4)).filter(pa.array((x == y).mean(axis=1) >= least))

    return run


#: Members of a bucket on each side of a cell of sketches, and of a cell of sets.
BLOCK, FINE = 4096, 128
#: Rows of an Arrow batch: of texts, and of sets, each of which may be long.
TEXTS, SETS = 1024, 256


def refusal(percent: int, t: int) -> float:
    """The share of equal coordinates, of t, below which a pair lies 5 standard deviations under ``percent``."""
    q = percent / 100
    return q - 5 * math.sqrt(q * (1 - q) / t)


def by_key(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The rows of each key, the first ``n_keys`` columns (longs), of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in range(n_keys)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and last != tuple(key[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(key[a])
    if held:
        yield pa.Table.from_batches(held)


def cell_blocks(percent: int, least: float):
    """Reads cells (sorted by cell, bucket): left rows against right ones of other labels. Pairs that neither sizes nor sketches refuse are dealt into smaller cells.

    Of those each member gives a row: (fine, left, place, partners, did, th);
    partners are the places of the right rows that a left one is to meet.
    """

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        left = rows["left"].to_numpy()
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        if not len(x) or not len(y):
            return
        sizes, vertex, label = rows["n"].to_numpy(), np.stack([rows["did"].to_numpy(), rows["th"].to_numpy()], 1), np.stack([rows["label_did"].to_numpy(), rows["label_th"].to_numpy()], 1)
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(left), -1)
        marks = np.asarray(rows["bands"].combine_chunks().flatten()).reshape(len(left), -1)
        cell, bucket = (rows[c][0].as_py() for c in ("cell", "bucket"))
        right_sketch, right_marks, right_sizes, right_label = sketch[y], marks[y], sizes[y], label[y]
        for first in range(0, len(x), FINE):
            mine, theirs = [], []
            for place, i in enumerate(x[first : first + FINE].tolist()):
                fits = (100 * np.minimum(right_sizes, sizes[i]) >= percent * np.maximum(right_sizes, sizes[i])) & (right_label != label[i]).any(axis=1)
                at = np.flatnonzero(fits)
                at = at[(right_sketch[at] == sketch[i]).mean(axis=1) >= least]
                # a pair is taken in the first bucket that it shares
                at = at[marks[i][(right_marks[at] == marks[i]).argmax(axis=1)] == bucket]
                mine.append(np.full(len(at), place))
                theirs.append(at)
            a, b = np.concatenate(mine), np.concatenate(theirs)
            for block in np.unique(b // FINE).tolist():
                here = b // FINE == block
                fine = scan.mix(np.array([cell ^ bucket], np.int64).view(np.uint64) ^ scan.mix(np.array([(first << 32) | block], np.uint64)))
                yield dealt(fine.view(np.int64)[0], a[here], b[here] % FINE, vertex[x[first : first + FINE]], vertex[y[block * FINE : (block + 1) * FINE]])

    def dealt(fine: int, a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        lefts, n = np.unique(a, return_counts=True)
        rights = np.unique(b)
        places = np.concatenate([lefts, rights])
        who = np.concatenate([left[lefts], right[rights]])
        cuts = np.concatenate([[0], np.cumsum(n), np.full(len(rights), len(b))]).astype(np.int32)
        partners = pa.ListArray.from_arrays(pa.array(cuts), pa.array(b[np.argsort(a, kind="stable")].astype(np.int32)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(places), fine)), pa.array(np.arange(len(places)) < len(lefts)), pa.array(places.astype(np.int32)), partners, pa.array(who[:, 0].copy()), pa.array(who[:, 1].copy())],
            ["fine", "left", "place", "partners", "did", "th"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, 2):
            yield from compare(rows)

    return run


def fine_links(percent: int):
    """Reads rows of ``cell_blocks`` with their sets, sorted by fine: gives the linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, 1):
            left, place = rows["left"].to_pylist(), rows["place"].to_pylist()
            sets = [np.asarray(rows["items"][i].values) for i in range(len(left))]
            right = {p: i for i, p in enumerate(place) if not left[i]}
            vertex = np.stack([rows["did"].to_numpy(), rows["th"].to_numpy()], 1)
            found = []
            for i in np.flatnonzero(left).tolist():
                for p in rows["partners"][i].as_py():
                    x, y = sets[i], sets[right[p]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        found.append((i, right[p]))
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*vertex[pairs[:, 0]].T.copy(), *vertex[pairs[:, 1]].T.copy())], ["a", "at", "b", "bt"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = SHINGLE, rows: int = 6, n_bands: int = 42, by_row: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, th, n_shingles, component_id, kept.

    Two texts are linked if 100 * intersection >= percent * union of their sets.
    A vertex is a doc_id with 64 bits of the text's hash, th, so rows of unlike
    texts stay apart though they share a doc_id or have none. component_id is
    the least doc_id reachable, itself included. Unless ``by_row``, rows that
    share a doc_id share its links, and kept holds for doc_id = component_id;
    ``by_row`` they do not, and kept holds for the least vertex of a component
    (rows equal in doc_id and text are one vertex). Null text: an empty set,
    linked with nothing. Null doc_id: less than all others, returned as null.
    Empty table: no rows. Other columns are ignored.
    With 42 bands of 6 rows a link of 0.8 is missed with probability 3e-6, with
    32 bands of 8 rows one of 0.85 with 4e-5, before other members of a
    component help.
    """
    d = keyed(docs)
    spark = docs.sparkSession
    with small_batches(spark, TEXTS):
        sig = keep(d.mapInArrow(signatures(k, rows, n_bands), "did long, th long, n_shingles long, d1 long, d2 long, sketch binary, bands array<long>"), "signatures")
    node = F.struct("did", "th")
    classes = keep(sig.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min(node).alias("rep")), "classes")
    reps = classes.select("rep.did", "rep.th")
    own = sig.join(reps, ["did", "th"], "left_semi")
    buckets = own.select(node.alias("node"), F.explode("bands").alias("bucket"))
    tops = buckets.groupBy("bucket").agg(
        F.min("node").alias("lo"), F.max("node").alias("hi"),
        *(F.min_by("node", F.xxhash64(F.lit(s), "node")).alias(f"c{s}") for s in (1, 2)),
    ).where("lo <> hi")
    shared = keep(buckets.join(tops, "bucket").select("bucket", "node", F.array("lo", "c1", "c2").alias("centres")), "buckets")
    names = shared.select("node.did", "node.th").distinct()
    brief = own.join(names, ["did", "th"], "left_semi").select("did", "th", F.col("n_shingles").alias("n"), "sketch", "bands").dropDuplicates(["did", "th"])
    brief = keep(brief, "brief")
    with small_batches(spark, TEXTS):
        sets = keep(d.join(names, ["did", "th"], "left_semi").dropDuplicates(["did", "th"]).mapInArrow(full_sets(k), "did long, th long, items array<long>"), "sets")
    least, pair = refusal(percent, rows * n_bands), "a long, at long, b long, bt long"

    def side(table: DataFrame, s: str, *columns: str) -> DataFrame:
        return table.select(F.col("did").alias(s), F.col("th").alias(f"{s}t"), *(F.col(c).alias(f"{c}_{s}") for c in columns))

    def likely(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(side(brief, "a", "n", "sketch"), ["a", "at"]).join(side(brief, "b", "n", "sketch"), ["b", "bt"])
        sized = sized.where(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))
        return sized.select("a", "at", "b", "bt", "sketch_a", "sketch_b").mapInArrow(close_sketches(least), pair)

    def ends() -> list[Column]:
        return [F.struct(F.col(s).alias("did"), F.col(f"{s}t").alias("th")).alias(n) for s, n in (("a", "u"), ("b", "v"))]

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side(sets, "a", "items"), ["a", "at"]).join(side(sets, "b", "items"), ["b", "bt"])
        common = both.select(*ends(), F.size(F.array_intersect("items_a", "items_b")).alias("common"), (F.size("items_a") + F.size("items_b")).alias("total"))
        return common.where(f"100 * common >= {percent} * (total - common)").select("u", "v")

    centred = shared.select(F.explode("centres").alias("x"), F.col("node").alias("y")).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    found = linked(likely(centred.select(F.col("x.did").alias("a"), F.col("x.th").alias("at"), F.col("y.did").alias("b"), F.col("y.th").alias("bt"))))
    if not by_row:
        # vertices of one doc_id belong together; most have but one
        several = keep(sig.groupBy("did").agg(F.min(F.struct("d1", "d2")).alias("lo"), F.max(F.struct("d1", "d2")).alias("hi")).where("lo <> hi").select("did"), "several")
        theirs = sig.join(several, "did", "left_semi").select("did", "d1", "d2").distinct().join(classes, ["d1", "d2"]).select("did", F.col("rep").alias("v"))
        found = found.unionByName(theirs.join(theirs.groupBy("did").agg(F.min("v").alias("u")), "did").select("u", "v"))
    found = keep(found, "links")
    label = keep(components(found), "labels")
    named = shared.select("bucket", "node").distinct().join(label, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    counts = named.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    most = counts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count("*").alias("labels"), F.sum("n").alias("all"), F.max("n").alias("top")).where("labels > 1")
    split = named.join(most, "bucket").withColumn("odd", F.col("label") != F.col("most"))
    wide, high = (F.ceil(c / F.lit(BLOCK)).cast("int") for c in (F.col("all"), F.col("all") - F.col("top")))
    block = F.xxhash64("node")
    sides = F.array(F.struct(F.lit(False).alias("left"), F.pmod(block, wide).alias("own"), high.alias("others")))
    odd_sides = F.array_append(sides, F.struct(F.lit(True).alias("left"), F.pmod(block, high).alias("own"), wide.alias("others")))
    cells = split.select("bucket", "node", "label", F.explode(F.when(F.col("odd"), odd_sides).otherwise(sides)).alias("s"))
    cells = cells.select("bucket", "node", "label", "s", F.explode(F.sequence(F.lit(0), F.col("s.others") - 1)).alias("other"))
    row, column = (F.when(F.col("s.left") == left, F.col("s.own")).otherwise(F.col("other")) for left in (True, False))
    cells = cells.select(F.xxhash64("bucket", row, column).alias("cell"), "bucket", F.col("s.left").alias("left"), "node.did", "node.th", F.col("label.did").alias("label_did"), F.col("label.th").alias("label_th"))
    cells = cells.join(brief, ["did", "th"]).select("cell", "bucket", "left", "did", "th", "label_did", "label_th", "n", "sketch", "bands")
    apart = cells.repartition("cell").sortWithinPartitions("cell", "bucket").mapInArrow(cell_blocks(percent, least), "fine long, left boolean, place int, partners array<int>, did long, th long")
    apart = keep(apart, "apart")
    full = apart.join(sets, ["did", "th"]).select("fine", "left", "place", "partners", "did", "th", "items")
    with small_batches(spark, SETS):
        found2 = keep(full.repartition("fine").sortWithinPartitions("fine").mapInArrow(fine_links(percent), pair).select(*ends()), "more-links")
    label2 = components(label.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(found2))
    of_class = keep(classes.join(label2.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("label", "rep").alias("label")), "of-class")
    discard(found, found2, label, shared, brief, sets, apart)
    out = sig.select("did", "th", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left").withColumn("label", F.coalesce("label", node))
    component, kept = F.col("label.did"), F.col("label") == node
    if not by_row:
        whole = out.join(several, "did", "left_semi").groupBy("did").agg(F.min("label.did").alias("least"))
        out = out.join(whole, "did", "left")
        component = F.coalesce("least", "label.did")
        kept = F.col("did") == component
    return out.select(doc_id_back().alias("doc_id"), "th", "n_shingles", F.when(component != NO_ID, component).alias("component_id"), kept.alias("kept"))
