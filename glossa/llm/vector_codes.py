"""Vector codes: each part of a vector becomes the number of its nearest codebook entry.

All is done on integers, so results don't depend on the order of rows or tasks.
In every round a kd-tree over each part's codebook goes to all tasks. A search
first goes down to the leaf on a vector's side of every split, then goes through
the tree with the distance found: a node is left out only if its box is farther
than that, so nodes at an equal distance are searched and the entry of lower
index wins ties. Tasks add up the parts of each entry; Spark adds up the tasks'
sums, and the driver divides: as many numbers as the codebooks have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.store import keep

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries of a leaf; vectors that are searched together.
LEAF, PIECE = 8, 1 << 13
#: Labels whose sums go to every task; more are joined over salted keys.
MOST_LABELS, SALTS = 100_000, 64


class Tree:
    """A kd-tree over the rows of an integer array."""

    def __init__(self, entries: np.ndarray, which: np.ndarray | None = None):
        self.which = np.arange(len(entries)) if which is None else which
        self.lo, self.hi = entries.min(0), entries.max(0)
        self.left = self.right = None
        spread = self.hi - self.lo
        if len(entries) > LEAF and spread.max() > 0:
            self.axis = int(spread.argmax())
            values = np.sort(entries[:, self.axis])
            self.split = values[len(values) // 2]
            below = entries[:, self.axis] < self.split
            if not below.any():  # the least value is the median: it goes by itself
                self.split = values[values > self.split][0]
                below = entries[:, self.axis] < self.split
            self.left, self.right = Tree(entries[below], self.which[below]), Tree(entries[~below], self.which[~below])
        else:
            self.entries = entries

    def bound(self, x: np.ndarray) -> np.ndarray:
        """The squared distance of each vector to the node's box."""
        off = np.maximum(np.maximum(self.lo - x, x - self.hi), 0)
        return np.einsum("ij,ij->i", off, off)

    def take(self, x: np.ndarray, idx: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        """Compare the vectors ``idx`` with the leaf's entries."""
        off = x[idx, None, :] - self.entries[None]
        d = np.einsum("ijk,ijk->ij", off, off)
        k = d.argmin(1)
        d, k = d[np.arange(len(idx)), k], self.which[k]
        better = (d < best[idx]) | ((d == best[idx]) & (k < at[idx]))
        best[idx[better]], at[idx[better]] = d[better], k[better]

    def home(self, x: np.ndarray, idx: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        if not len(idx):
            return
        if self.left is None:
            self.take(x, idx, best, at)
        else:
            below = x[idx, self.axis] < self.split
            self.left.home(x, idx[below], best, at)
            self.right.home(x, idx[~below], best, at)

    def visit(self, x: np.ndarray, idx: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        idx = idx[self.bound(x[idx]) <= best[idx]]
        if not len(idx):
            return
        if self.left is None:
            self.take(x, idx, best, at)
        else:
            self.left.visit(x, idx, best, at)
            self.right.visit(x, idx, best, at)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each vector's nearest entry."""
        every, best, at = np.arange(len(x)), np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).max)
        self.home(x, every, best, at)
        self.visit(x, every, best, at)
        return at, best


def vectors(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, last row + 1 and vectors of pieces of a batch; all have one length."""
    col = batch.column(column)
    if len(col):
        values = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(col), -1)
        for a in range(0, len(col), PIECE):
            yield a, min(a + PIECE, len(col)), values[a : a + PIECE]


def part_sums(trees: Broadcast, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec) to the sums of a task: (part, entry, place, total); place -1 holds the number of vectors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray] = []
        for batch in batches:
            for _, _, x in vectors(batch, 0):
                for p, piece in enumerate(np.split(x, parts, axis=1)):
                    if len(sums) <= p:
                        sums.append(np.zeros((ENTRIES, piece.shape[1] + 1), np.int64))
                    at, _ = trees.value[p].nearest(piece)
                    order = np.argsort(at, kind="stable")
                    hit, first = np.unique(at[order], return_index=True)
                    sums[p][hit, 1:] += np.add.reduceat(piece[order], first, axis=0)
                    sums[p][hit, 0] += np.diff(np.append(first, len(at)))
        for p, s in enumerate(sums):
            entry, place = np.nonzero(np.broadcast_to(s[:, :1] > 0, s.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p)), pa.array(entry), pa.array(place - 1), pa.array(s[entry, place])], ["part", "entry", "place", "total"])

    return rows


def assign(trees: Broadcast, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec_id, label, vec) to (vec_id, label, code, error)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in vectors(batch, 2):
                found = [t.nearest(piece) for t, piece in zip(trees.value, np.split(x, parts, axis=1), strict=True)]
                code = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array([c.tobytes().hex() for c in code]), pa.array(sum(d for _, d in found))], ["vec_id", "label", "code", "error"])

    return rows


def whole_vectors(df: DataFrame, column: str, scale: int) -> DataFrame:
    """(vec_id, label, vec): vectors of numbers only, as integers; an absolute value has a limit that no squared distance overflows at."""
    v = F.col(column).cast("array<double>")
    fine = F.col(column).isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0))))
    limit = F.floor(F.sqrt(F.lit(2.0**60) / F.greatest(F.size(v), F.lit(1)))).cast("double")
    return df.where(fine).select("vec_id", "label", F.transform(v, lambda x: F.floor(F.least(F.greatest(x * F.lit(float(scale)), -limit), limit)).cast("long")).alias("vec"))


def codebooks_text(books: list[np.ndarray]) -> str:
    return ",".join(str(x) for b in books for x in b.ravel().tolist())


def vector_codes(df: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per whole vector of ``df`` (vec_id, label, ``column``): vec_id, label, code, error, label_error, codebooks_sha256.

    A vector with a null or non-finite component, or a null one, has no row.
    Components become floor(scale * x), held within a limit of 2^30 over the
    root of the length, so that distances are exact. The vector of the least
    vec_id whose length is a multiple of ``parts`` fixes the length; vectors of
    other lengths have no row. A part's codebook begins as that part of the
    vectors with the ``entries`` (at most 256) least vec_ids, null ones last,
    ties by the vector; with fewer vectors it has fewer entries. Each round
    replaces an entry by the floored mean of the parts nearest to it; unused
    ones stay. label_error sums the error over equal labels, nulls together.
    Rows that share a vec_id have a row each. Empty table: no rows.
    """
    if not 0 < entries <= ENTRIES:
        raise ValueError(f"a codebook has 1 to {ENTRIES} entries")
    spark = df.sparkSession
    whole = keep(whole_vectors(df, column, scale), "vectors")
    even = F.size("vec").between(1, 1 << 20) & (F.size("vec") % parts == 0)
    order = (F.col("vec_id").asc_nulls_last(), F.col("vec").asc())
    first = whole.where(even).orderBy(*order).select(F.size("vec")).first()
    length = first[0] if first else parts
    whole = whole.where(F.size("vec") == length)
    start = np.array([r[0] for r in whole.orderBy(*order).limit(entries).select("vec").collect()], np.int64).reshape(-1, length)
    books = [b.copy() for b in np.split(start, parts, axis=1)]
    if not len(start):
        books = [np.zeros((1, length // parts), np.int64) for _ in range(parts)]
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([Tree(b) for b in books])
        sums = whole.select("vec").mapInArrow(part_sums(trees, parts), "part long, entry long, place long, total long")
        totals = {tuple(r[:3]): int(r[3]) for r in sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(20,0)"))).collect()}
        trees.unpersist()
        for (p, e, place), total in totals.items():
            if place >= 0:
                books[p][e, place] = total // totals[p, e, -1]
    trees = spark.sparkContext.broadcast([Tree(b) for b in books])
    kind = dict(df.dtypes)
    coded = keep(whole.select("vec_id", "label", "vec").mapInArrow(assign(trees, parts), f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"), "codes")
    trees.unpersist()
    totals = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    totals, on = keep(totals, "label-errors"), F.col("label").eqNullSafe(F.col("of_label"))
    if totals.count() <= MOST_LABELS:
        totals = F.broadcast(totals)
    else:
        coded = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
        totals = totals.withColumn("of_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on &= F.col("salt") == F.col("of_salt")
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return coded.join(totals, on).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
