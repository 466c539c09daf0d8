"""Incremental removal of word windows that came earlier, by a log-structured fingerprint index.

A window is ``window`` consecutive words of one text. Equal windows have the
same least hash over their inner ``k``-word grams, so neighbouring windows with
one least hash make one row: its fingerprint m, a hash seg of all its words, its
place, and a 48-bit hash of each of its windows. The index holds such rows as
runs: immutable tables in buckets of m, sorted by m. A new batch is dealt and
sorted the same way and merge-joined with the runs, which are read but not
shuffled; only rows whose fingerprint the batch has go on. Fingerprints that
meet are verified: rows equal as a whole (m and seg, 128 bits) are repeats of
the first; where rows of one m differ, their windows are compared by m and
hash (112 bits). No text is read again. Then the batch becomes a run, and runs
of like size are merged into one, which keeps the first place of each (m, seg).

An index under a path of its own lasts: a manifest, written anew after each
batch, names its runs, and a later session goes on from there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm import scan
from glossa.llm.store import discard, doc_id_back, keep, keyed, shared_dir
from glossa.session import held

WINDOW = 20
K = 5
#: Bytes of a window's hash; windows that an earlier one of the same piece of a batch equals have none, as they decide nothing more.
HASH = 6
REPEAT = bytes(HASH)
ROW = "m long, seg long, did long, th long, pos long, hashes binary"


def window_hashes(h: np.ndarray, where: np.ndarray, own: np.ndarray, dids: np.ndarray, ths: np.ndarray, window: int) -> np.ndarray:
    """``HASH`` bytes of each window at ``where``, in words; zeros where an equal window stands at an earlier place (did, th, start)."""
    w = scan.grams(h, window, 3)[where]
    place = np.argsort(np.argsort(np.lexsort((ths, dids)), kind="stable")[own[where]], kind="stable")
    by_window = place[np.argsort(w[place], kind="stable")]
    text = own[where][by_window]
    other = (text[1:] == text[:-1]) | (dids[text[1:]] != dids[text[:-1]]) | (ths[text[1:]] != ths[text[:-1]])
    out = w.view(np.uint8).reshape(-1, 8)[:, 8 - HASH :].copy()
    out[~out.any(axis=1), 0] = 1
    out[by_window[1:][(w[by_window[1:]] == w[by_window[:-1]]) & other]] = 0
    return out


def window_runs(window: int, k: int):
    """Rows (m, seg, did, th, pos, hashes) of all windows of (did, th, text); pos as in ``scan.pack``, in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offs, data in scan.chunks(batch, 2):
                _, _, h, own = scan.words(data, offs)
                hashes, w = scan.grams(h, k), window - k + 1
                mins = scan.window_min(hashes, w)
                if not len(mins):
                    continue
                ends = np.cumsum(np.bincount(own, minlength=len(offs) - 1))
                begins = np.concatenate([[0], ends[:-1]])
                where = np.flatnonzero(np.arange(len(mins)) + window <= ends[own[: len(mins)]])
                at, n = scan.runs(mins[where], own[where], scan.LONGEST)
                start = where[at]
                twice = np.isin(mins[start], scan.least_twice(hashes, mins, w, window))
                raw = memoryview(h.tobytes())
                seg = np.fromiter((xxhash.xxh3_64_intdigest(raw[8 * s : 8 * (s + c + window - 1)]) for s, c in zip(start.tolist(), n.tolist(), strict=True)), np.uint64, len(start))
                rows = pa.array(a + own[start])
                dids, ths = (batch.column(c)[a:b].to_numpy(zero_copy_only=False) for c in (0, 1))
                each = window_hashes(h, where, own, dids, ths, window)
                places = pa.py_buffer((np.append(at, len(where)) * HASH).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [scan.signed(mins[start]), scan.signed(seg), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(scan.pack(start - begins[own[start]], n, twice)), pa.Array.from_buffers(pa.binary(), len(at), [None, places, pa.py_buffer(each)])],
                    ["m", "seg", "did", "th", "pos", "hashes"],
                )

    return run


def without_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, th, text, spans of words) to what is left: words joined by one space."""
    for batch in batches:
        out: dict[str, list] = {"did": [], "n_words": [], "n_removed": [], "kept": []}
        for i in range(batch.num_rows):
            words = batch.column(2)[i].as_py().encode().split()
            left, at, gone = [], 0, 0
            for a, b in sorted((s["start"], s["end"]) for s in batch.column(3)[i].as_py() or ()):
                if a > at:
                    left += words[at:a]
                if b > at:
                    gone += b - max(a, at)
                    at = b
            left += words[at:]
            out["did"].append(batch.column(0)[i].as_py())
            out["n_words"].append(len(words))
            out["n_removed"].append(gone)
            out["kept"].append(b" ".join(left).decode())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema({"did": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}))


def first_places(rows: DataFrame) -> DataFrame:
    """The first place of each (m, seg)."""
    return rows.groupBy("m", "seg").agg(F.min(F.struct("did", "th", "pos", "hashes")).alias("r")).select("m", "seg", "r.did", "r.th", "r.pos", "r.hashes")


class FingerprintIndex:
    """Sorted runs over the documents added so far. Documents must come in ascending order of (did, th).

    With a ``path`` the runs stand there, and an index that the path holds
    already is opened, with the window, k and buckets that it was made with.
    Without one they are intermediate tables, deleted by ``close``. A batch
    that was cut off leaves the manifest, and so the index, as it was.
    """

    def __init__(self, window: int = WINDOW, k: int = K, fanout: int = 2, path: str | None = None, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.getActiveSession()
        self.window, self.k, self.fanout, self.path = window, k, fanout, path
        self.buckets, self.version = int(self.spark.conf.get("spark.sql.shuffle.partitions")), 0
        #: (level, table): a table of level l + 1 is merged from ``fanout`` of level l.
        self.runs: list[tuple[int, DataFrame]] = []
        if path and (found := self.manifest()):
            self.version, self.window, self.k, self.buckets = (found[x] for x in ("version", "window", "k", "buckets"))
            self.runs = [(level, self.table(at)) for level, at in found["runs"]]

    def manifest(self) -> dict | None:
        """The newest manifest at the path."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        rows = self.spark.read.schema("version long, body string").json(f"{self.path}/manifests/*").orderBy(F.desc("version")).limit(1).collect()
        return json.loads(rows[0].body) if rows else None

    def save(self) -> None:
        """A manifest that names the present runs; each version is a folder of its own, so none is half written."""
        if self.path:
            self.version += 1
            body = {"version": self.version, "window": self.window, "k": self.k, "buckets": self.buckets, "runs": [(level, t._glossa_path) for level, t in self.runs]}
            self.spark.createDataFrame([(self.version, json.dumps(body))], "version long, body string").coalesce(1).write.json(f"{self.path}/manifests/{self.version:012d}")

    def table(self, path: str, rows: DataFrame | None = None, deal: bool = False) -> DataFrame:
        """A run: ``rows`` written in buckets of m, or what stands at ``path``."""
        name = f"glossa_{uuid.uuid4().hex}"
        if rows is None:
            columns = ", ".join(ROW.split(", "))
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (m) SORTED BY (m, seg) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        else:
            (rows.repartition(self.buckets, "m") if deal else rows).write.bucketBy(self.buckets, "m").sortBy("m", "seg").option("compression", "zstd").option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out._glossa_path, out._glossa_table = path, name
        return out

    def place(self) -> str:
        return f"{self.path or shared_dir(self.spark)}/run-{uuid.uuid4().hex}"

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """Spans (did, th, start, end) of words in ``batch`` (did, th, text) that earlier windows cover; ``last``: no batch will follow, so its run isn't kept."""
        new = batch.mapInArrow(window_runs(self.window, self.k), ROW)
        if self.runs or not last:
            new = self.table(self.place(), new, deal=True)
        # a union of tables of one bucketing stays dealt by m, if no expression has to be made below it, so neither runs nor batch are shuffled again
        both = reduce(DataFrame.unionByName, [new, *(t.join(new.select("m"), "m", "left_semi") for _, t in self.runs)])
        by_m, by_seg = Window.partitionBy("m"), Window.partitionBy("m", "seg")
        start, n, twice = scan.unpack("pos")
        met = both.select("*", F.count("*").over(by_m).alias("of_m"), F.min("seg").over(by_m).alias("least_seg"), F.max("seg").over(by_m).alias("greatest_seg"))
        fresh = F.lit(True)  # each m here is one of the batch's
        if self.runs and (least := new.agg(F.min(F.struct("did", "th")).alias("k")).first().k):
            fresh = (F.col("did") > least.did) | ((F.col("did") == least.did) & (F.col("th") >= least.th))
        met = met.where((F.col("of_m") > 1) | twice).withColumns({"new": fresh, "unlike": F.col("least_seg") != F.col("greatest_seg")})
        place = F.struct("did", "th", start.alias("start"))
        met = met.select("new", "m", "did", "th", start.alias("start"), n.alias("n"), (F.col("unlike") | twice).alias("mixed"), (F.min(place).over(by_seg) == place).alias("first"), "hashes")
        met = met.withColumn("hashes", F.when(F.col("mixed") & F.col("first"), F.col("hashes"))).where("hashes is not null or (new and not first)")
        with held(self.spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):  # else the buckets below the union aren't used
            met = keep(met, "met")
        spans = met.where("new and not first").select("did", "th", "start", (F.col("start") + F.col("n") + F.lit(self.window - 1)).alias("end"))
        # windows of rows that are equal as a whole count once, and those of one piece of a batch too
        places = F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct((F.col("start") + i).alias("start"), F.substring("hashes", i * HASH + 1, F.lit(HASH)).alias("w"))))
        each = met.where("mixed and first").select("new", "m", "did", "th", places.alias("x")).select("new", "m", "did", "th", "x.start", "x.w")
        known = each.where(F.col("new") & (F.col("w") == F.lit(REPEAT))).select("did", "th", "start")
        here = F.struct("did", "th", "start")
        open_ = each.where(F.col("w") != F.lit(REPEAT)).withColumn("repeat", F.min(here).over(Window.partitionBy("m", "w")) < here)
        repeats = known.unionByName(open_.where("new and repeat").select("did", "th", "start"))
        out = keep(spans.unionByName(repeats.select("did", "th", "start", (F.col("start") + F.lit(self.window)).alias("end"))), "spans")
        discard(met)
        if last:
            discard(new)
        else:
            self.runs.append((0, new))
            old = self.compact()
            self.save()
            discard(*old)
        return out

    def compact(self) -> list[DataFrame]:
        """Merge ``fanout`` runs of one level into one of the next, which keeps the first place of each (m, seg); the merged ones, which may go."""
        gone = []
        while len([x for x in self.runs if x[0] == self.runs[-1][0]]) >= self.fanout:
            level = self.runs[-1][0]
            old = [t for x, t in self.runs if x == level]
            merged = self.table(self.place(), first_places(reduce(DataFrame.unionByName, old)))
            self.runs = [x for x in self.runs if x[0] != level] + [(level + 1, merged)]
            gone += old
        return gone

    def close(self) -> None:
        """Delete an index without a path; one with a path stays."""
        for _, t in self.runs:
            if self.path:
                self.spark.sql(f"DROP TABLE IF EXISTS {t._glossa_table}")
        if not self.path:
            discard(*(t for _, t in self.runs))
        self.runs = []


def batches_of(docs: DataFrame, n_batches: int) -> list[DataFrame]:
    """``docs`` in ``n_batches`` ascending ranges of doc_id with about as many rows each; null comes first."""
    if n_batches < 2:
        return [keyed(docs)]
    cuts = docs.select(F.percentile_approx("doc_id", [i / n_batches for i in range(1, n_batches)], 1000)).first()[0]
    cuts = sorted(set(cuts or []))
    out = []
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        rows = F.lit(True)
        if lo is not None:
            rows &= F.col("doc_id") > lo
        if hi is not None:
            rows &= F.col("doc_id") <= hi
        out.append(keyed(docs.where(rows | F.col("doc_id").isNull() if lo is None else rows)))
    return out


def remove_earlier_windows(docs: DataFrame, window: int = WINDOW, k: int = K, n_batches: int = 4, fanout: int = 2, path: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept (words left, joined by one space).

    A word goes if a window covers it whose words also start earlier: in a
    smaller doc_id, or in the same text further left; the input decides, not
    what is left of it. The documents pass in ``n_batches`` through one index;
    one at ``path`` lasts, and what it holds from earlier calls counts as
    earlier, so later calls must bring greater doc_ids.
    Null text: no words. Null doc_id: less than all others. Rows that share a
    doc_id are ordered by a hash of the text; rows equal in doc_id and text are
    one document and lose the same words. Texts of fewer words than ``window``
    stay. Empty table: no rows. Other columns are ignored.
    """
    index = FingerprintIndex(window, k, fanout, path, docs.sparkSession)
    parts = batches_of(docs, n_batches)
    spans = [index.add(part, last=not path and i == len(parts) - 1) for i, part in enumerate(parts)]
    index.close()
    lists = reduce(DataFrame.unionByName, spans).distinct().groupBy("did", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = keyed(docs).join(lists, ["did", "th"], "left").select("did", "th", "text", "spans")
    out = joined.mapInArrow(without_words, "did long, n_words long, n_removed long, kept string")
    return out.select(doc_id_back().alias("doc_id"), "n_words", "n_removed", "kept")
