"""Token counts by a compiled finite-state transducer.

A subword model merges neighbouring symbols, best score first. For such models
a sequence of tokens is the encoding of its text if and only if each pair of
neighbours is the encoding of its own text, and every prefix of a text has one
encoding. So a text can be read from left to right: the transducer's state
holds, for every place where a token that is still open may begin, the part of
that token read so far, the token before it, and how many tokens the prefix up
to that place has, relative to the last one. A transition on a character is
annotated with the number of tokens that the prefix grows by (it may fall: a
long token takes in short ones). States and transitions are made when they are
first met, and remembered.

Two characters that no piece holds next to each other never share a token:
between them every state collapses into the start state. So a text falls into
segments, whose counts are transitions of the start state to itself; they are
remembered by 64-bit hash, and adding them up is array work.

A chunk of a text is a map from states to states and counts: its characters up
to the first place where states collapse (they are run from whatever state
comes in), the count of the segments after that, and the state at its end. Maps
compose, so the chunks of a long text are worked on apart and composed by a
parallel prefix scan.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import scan
from glossa.llm.store import keep

BLANK = "▁"
#: Characters of a chunk; texts of more than ``LONG`` bytes have their chunks dealt over all tasks.
CHUNK, LONG = 1 << 16, 1 << 20
#: Chunk maps that one task composes.
FAN = 64
#: Segments, and transitions, that a worker remembers.
REMEMBER = 1 << 21

#: Part of an open token, the token before it (None: nothing that could join it), tokens up to there less those up to now.
Entry = tuple[str, str | None, int]
State = tuple[Entry, ...]
START: State = (("", None, 0),)
#: Characters before the first collapse; whether there is one; tokens after it; the state at the end if there is one.
Map = tuple[str, bool, int, State]
SAME: Map = ("", False, 0, ())

STATE = pa.list_(pa.struct([("open", pa.string()), ("before", pa.string()), ("less", pa.int64())]))
_compiled: dict[str, Transducer] = {}


class Transducer:
    """The transducer of a model whose pieces have scores; a character that is no piece counts as its UTF-8 bytes."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.open = {p[:i] for p in scores for i in range(1, len(p))}
        pairs = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.letters = sorted({c for p in pairs for c in p} | {p for p in scores if len(p) == 1})
        number = {c: i + 1 for i, c in enumerate(self.letters)}
        self.numbers = np.zeros(0x110000, np.uint16)
        for c, i in number.items():
            self.numbers[ord(c)] = i
        self.numbers[ord(" ")] = number.get(BLANK, 0)
        self.joins = np.zeros((len(number) + 1, len(number) + 1), bool)
        for a, b in pairs:
            self.joins[number[a], number[b]] = True
        self.pairs = pairs
        self.weights = np.array([0, *(self.weight(c) for c in self.letters)], np.int64)
        self.codes = np.random.Generator(np.random.PCG64(12)).integers(1, 2**63, len(number) + 1, dtype=np.uint64) * scan.U(2) + scan.U(1)
        self.fits: dict[tuple[str | None, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.steps: dict[tuple[State, str], tuple[State, int]] = {}
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def weight(self, token: str) -> int:
        return 1 if token in self.scores else len(token.encode())

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text, by its definition."""
        parts = list(text)
        while True:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fit(self, before: str | None, token: str) -> bool:
        """Whether ``token`` may stand after ``before``."""
        known = self.fits.get((before, token))
        if known is None:
            parts = [token] if before is None else [before, token]
            if len(self.fits) > REMEMBER:
                self.fits.clear()
            known = self.fits[before, token] = self.merged("".join(parts)) == parts
        return known

    def step(self, state: State, c: str) -> tuple[State, int]:
        done = self.steps.get((state, c))
        if done:
            return done
        alive, last, more = [], None, 0
        for open_, before, less in state:
            token = open_ + c
            if not open_ and before is not None and before[-1] + c not in self.pairs:
                before = None  # these two never share a token
            if (not open_ or token in self.scores) and last is None and self.fit(before, token):
                last, more = token, less + self.weight(token)
            if token in self.open:
                alive.append((token, before, less))
        if last is None:
            raise ValueError(f"no encoding of a text that ends in {state[0][0] + c!r}")
        out = (*((o, b, less - more) for o, b, less in alive), ("", last, 0)), more
        if len(self.steps) > REMEMBER:
            self.steps.clear()
        self.steps[state, c] = out
        return out

    def run(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for c in text:
            state, n = self.step(state, c)
            total += n
        return state, total

    def compose(self, f: Map, g: Map) -> Map:
        """First ``f``, then ``g``."""
        if not f[1]:
            return f[0] + g[0], g[1], g[2], g[3]
        state, n = self.run(f[3], g[0])
        return f[0], True, f[2] + n + g[2], g[3] if g[1] else state

    def prefix_scan(self, maps: list[Map]) -> list[Map]:
        """The compositions of the first one, two, ... maps, in rounds that double the distance."""
        maps, step = list(maps), 1
        while step < len(maps):
            maps = [self.compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
            step *= 2
        return maps

    def total(self, whole: Map) -> int:
        return self.run(START, whole[0])[1] + whole[2]

    def segment_counts(self, numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of segments of two and more known letters."""
        sums = np.zeros(len(numbers) + 1, np.uint64)
        up, down = scan.powers(len(numbers) + 1)
        np.cumsum(self.codes[numbers] * up[: len(numbers)], out=sums[1:])
        h = scan.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        counts = np.zeros(len(keys), np.int64)
        counts[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            a, b = starts[first[new]], ends[first[new]]
            counts[new] = [self.run(START, "".join(self.letters[k - 1] for k in numbers[i:j]))[1] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            if len(self.keys) + len(new) > REMEMBER:
                self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)
                at = at * 0
            short = b - a <= 64  # others hardly come again
            self.keys, self.counts = np.insert(self.keys, at[new][short], keys[new][short]), np.insert(self.counts, at[new][short], counts[new][short])
        return counts[which]

    def segments(self, points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the segments of texts that begin at ``begins``, and the running sum of their counts, from 0."""
        n = len(points)
        numbers = self.numbers[points]
        cut = np.ones(n, bool)
        cut[1:] = ~self.joins[numbers[:-1], numbers[1:]]
        cut[begins[begins < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        counts = self.weights[numbers[starts]]
        strange = numbers[starts] == 0
        p = points[starts[strange]]
        counts[strange] = 1 + (p > 0x7F).astype(np.int64) + (p > 0x7FF) + (p > 0xFFFF)
        several = ends - starts > 1
        counts[several] = self.segment_counts(numbers, starts[several], ends[several])
        return starts, ends, np.concatenate([[0], np.cumsum(counts)])

    def text_counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of whole texts."""
        points, begins = code_points(texts)
        if not len(points):
            return np.zeros(len(texts), np.int64)
        starts, _, sums = self.segments(points, begins)
        at = np.searchsorted(starts, np.append(begins, len(points)))
        return sums[at[1:]] - sums[at[:-1]]

    def chunk_map(self, text: str, first: bool) -> Map:
        """The map of a chunk; states collapse before the ``first`` one of a text."""
        if first:
            text = BLANK + text
        if not text:
            return SAME
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts, _, sums = self.segments(points, np.zeros(1, np.int64))
        text = text.replace(" ", BLANK)
        if len(starts) == 1 and not first:
            return text, False, 0, ()
        head = 0 if first else 1
        tail, n = self.run(START, text[starts[-1] :])
        return text[: starts[head]], True, int(sums[-2] - sums[head]) + n, tail

    def long_count(self, text: str) -> int:
        """Tokens of one text, by the maps of its chunks."""
        return self.total(self.prefix_scan([self.chunk_map(text[i : i + CHUNK], not i) for i in range(0, len(text), CHUNK)])[-1])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, a blank before each that isn't empty, and where each begins."""
    lengths = np.array([len(x) + bool(x) for x in texts], np.int64)
    return np.frombuffer("".join(BLANK + x if x else x for x in texts).encode("utf-32-le"), np.uint32), np.cumsum(lengths) - lengths


def compiled(model: str) -> Transducer:
    """The transducer of a sentencepiece BPE model with byte fallback, an identity normaliser and a leading blank; other kinds are refused."""
    if model not in _compiled:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        t = Transducer({sp.id_to_piece(i): sp.get_score(i) for i in ids})
        for probe in ("  two  blanks ", "① ﬁ A\u0301 <s>", " ".join(p + q for p, q in zip(t.scores, t.letters, strict=False))[:20_000]):
            if len(sp.encode(probe)) != t.run(START, (BLANK + probe).replace(" ", BLANK))[1]:
                raise ValueError(f"{model} is no BPE model of the kind that can be compiled")
        _compiled[model] = t
    return _compiled[model]


COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("rid", pa.int64()), ("chunk", pa.int64()), ("part", pa.string())])
MAPPED = pa.schema([("rid", pa.int64()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("head", pa.string()), ("synced", pa.bool_()), ("n", pa.int64()), ("tail", STATE)])
MAPPED_SQL = "rid long, chunk long, doc_id long, n_bytes long, head string, synced boolean, n long, tail array<struct<open: string, before: string, less: bigint>>"


def count_or_cut(model: Callable[[], str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) to a row with the count of a text, or a row for each chunk of a text of more than ``LONG`` bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, rid = compiled(model()), TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, offs, data in scan.chunks(batch, 1):
                ids, sizes = batch.column(0)[a:b], np.diff(offs)
                if sizes.max() > LONG:
                    order = [(k, sizes[k] > LONG) for k in range(b - a)]
                else:
                    order = [(slice(0, b - a), False)]
                for k, long_ in order:
                    if long_:
                        rid += 1
                        text = data[offs[k] : offs[k + 1]]
                        begins = np.flatnonzero((text & 0xC0) != 0x80)[::CHUNK]
                        for c, (i, j) in enumerate(zip(begins, np.append(begins[1:], len(text)), strict=True)):
                            row = {"doc_id": ids[k].as_py(), "n_bytes": int(sizes[k]), "n_tokens": None, "rid": rid, "chunk": c, "part": text[i:j].tobytes().decode()}
                            yield pa.RecordBatch.from_pylist([row], COUNTED)
                        continue
                    k = k if isinstance(k, slice) else slice(k, k + 1)
                    texts = [data[x:y].tobytes().decode() for x, y in zip(offs[k.start : k.stop], offs[k.start + 1 : k.stop + 1], strict=True)]
                    n = t.text_counts([x if len(x) <= CHUNK else "" for x in texts])
                    for i, x in enumerate(texts):
                        if len(x) > CHUNK:
                            n[i] = t.long_count(x)
                    none = pa.nulls(len(texts), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids[k.start : k.stop], pa.array(sizes[k]), pa.array(n), none, none, pa.nulls(len(texts), pa.string())], schema=COUNTED)

    return rows


def map_chunks(model: Callable[[], str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The state maps of chunks of long texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model())
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield mapped([(row, t.chunk_map(row["part"], row["chunk"] == 0))])

    return rows


def mapped(rows: list[tuple[dict, Map]]) -> pa.RecordBatch:
    out = [{**{c: r[c] for c in ("rid", "chunk", "doc_id", "n_bytes")}, "head": m[0], "synced": m[1], "n": m[2], "tail": [dict(zip(("open", "before", "less"), e, strict=True)) for e in m[3]]} for r, m in rows]
    return pa.RecordBatch.from_pylist(out, MAPPED)


def compose_chunks(model: Callable[[], str]) -> Callable[[pa.Table], pa.Table]:
    """Up to ``FAN`` neighbouring maps of a text to one."""

    def one(table: pa.Table) -> pa.Table:
        t = compiled(model())
        rows = sorted(table.to_pylist(), key=operator.itemgetter("chunk"))
        maps = [(r["head"], r["synced"], r["n"], tuple((e["open"], e["before"], e["less"]) for e in r["tail"])) for r in rows]
        rows[0]["chunk"] //= FAN
        return pa.Table.from_batches([mapped([(rows[0], t.prefix_scan(maps)[-1])])])

    return one


def count_tokens(docs: DataFrame, model: Callable[[], str], limit: int = 4096) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``model`` gives the path of the model's file where it is called, on the
    workers. Counts are those of the model's own library for whole texts,
    without begin and end. Null text: empty, no bytes and no tokens. Rows that
    share a doc_id, or are equal, are counted each; null doc_ids stay null.
    Empty table: no rows. Other columns are ignored. A text of more than
    ``LONG`` bytes is cut into chunks that are counted by other tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = keep(rows.mapInArrow(count_or_cut(model), "doc_id long, n_bytes long, n_tokens long, rid long, chunk long, part string"), "token-counts", row_group=16 << 20)
    out = counted.where("rid is null").select("doc_id", "n_bytes", "n_tokens")
    cut = counted.where("rid is not null")
    last = cut.agg(F.max("chunk")).first()[0]
    if last is not None:
        maps = cut.select("rid", "chunk", "doc_id", "n_bytes", "part").repartition("rid", "chunk").mapInArrow(map_chunks(model), MAPPED_SQL)
        while last > 0:
            maps = keep(maps, "chunk-maps").groupBy("rid", F.expr(f"chunk div {FAN}")).applyInArrow(compose_chunks(model), MAPPED_SQL)
            last //= FAN
        out = out.unionByName(maps.mapInArrow(total_maps(model), "doc_id long, n_bytes long, n_tokens long"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def total_maps(model: Callable[[], str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The counts of maps of whole texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model())
        for batch in batches:
            n = [t.total((r["head"], r["synced"], r["n"], ())) for r in batch.select(["head", "synced", "n"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return rows
