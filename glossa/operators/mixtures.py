"""Diagonal Gaussian mixtures: densities, EM, training per speaker, identification."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.guards import NEG_INF, log_sum_exp, nan_low, safe_ln
from glossa.session import cut_folder

MODEL = "speaker string, m int, w double, mu array<double>, var array<double>"


def log_density(x: Column, mu: Column, var: Column) -> Column:
    """ln of a diagonal Gaussian at x; a variance of 0 gives NaN."""
    terms = F.zip_with(F.zip_with(x, mu, lambda a, b: (a - b) * (a - b)), var, lambda d, v: F.when(v == 0, F.lit(float("nan"))).otherwise(F.try_divide(d, v) + F.log(v)))
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    return F.lit(-0.5) * (total + F.size(x) * math.log(2 * math.pi))


def packed(model: DataFrame) -> DataFrame:
    """(speaker, parts): the components of a speaker as one array, in order of m."""
    return model.groupBy("speaker").agg(F.sort_array(F.collect_list(F.struct("m", "w", "mu", "var"))).alias("parts"))


def responsibilities(frames: DataFrame, model: DataFrame) -> DataFrame:
    """(keys of frames, x, m, logb, logp, loglik) for every component of the frame's speaker.

    A frame meets its speaker's whole mixture in one row, so that frames
    aren't shuffled and equal ones stay apart.
    """
    keys = [c for c in frames.columns if c != "x"]
    rows = frames.join(packed(model), "speaker")
    dense = F.transform("parts", lambda p: F.struct(p["m"].alias("m"), p["w"].alias("w"), log_density(F.col("x"), p["mu"], p["var"]).alias("logb")))
    joint = F.transform("dense", lambda p: safe_ln(p["w"]) + p["logb"])
    rows = rows.select(*keys, "x", dense.alias("dense")).withColumn("joint", joint).withColumn("loglik", log_sum_exp(F.col("joint")))
    each = rows.select(*keys, "x", "loglik", F.explode(F.arrays_zip("dense", "joint")).alias("z"))
    return each.select(*keys, "x", "z.dense.m", "z.dense.logb", (F.col("z.joint") - F.col("loglik")).alias("logp"), "loglik")


def m_step(resp: DataFrame, var_floor: float = 0.0) -> DataFrame:
    """The next model: weights are mean responsibilities, variances E[x2] - mu2, not below ``var_floor``; loglik is that of the old model."""
    r = F.exp("logp")
    per_dim = resp.select("speaker", "m", "loglik", r.alias("r"), F.posexplode("x").alias("dim", "x"))
    sums = per_dim.groupBy("speaker", "m", "dim").agg(
        F.sum("r").alias("r"), F.sum(F.col("r") * F.col("x")).alias("rx"), F.sum(F.col("r") * F.col("x") * F.col("x")).alias("rxx"), F.count("*").alias("n"), F.sum("loglik").alias("loglik")
    )
    mu = F.try_divide(F.col("rx"), F.col("r"))
    dims = sums.select("speaker", "m", "dim", "loglik", F.try_divide(F.col("r"), F.col("n")).alias("w"), mu.alias("mu"), F.greatest(F.try_divide(F.col("rxx"), F.col("r")) - mu * mu, F.lit(var_floor)).alias("var"))
    whole = dims.groupBy("speaker", "m").agg(F.max(F.struct("dim", "w", "loglik")).alias("any"), F.sort_array(F.collect_list(F.struct("dim", "mu", "var"))).alias("d"))
    return whole.select("speaker", "m", "any.w", F.transform("d", lambda s: s["mu"]).alias("mu"), F.transform("d", lambda s: s["var"]).alias("var"), "any.loglik")


def initial_model(frames: DataFrame, id_: str, m: int = 8, seed: int = 401) -> DataFrame:
    """Means are frames drawn by hash, with replacement; weights and variances come from hashes."""
    unit = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
    drawn = frames.groupBy(F.col("speaker").cast("string").alias("speaker")).agg(*(F.min_by("x", F.struct(F.xxhash64(F.lit(seed), F.lit(k), F.col(id_)), F.col(id_), F.col("x"))).alias(f"x{k}") for k in range(m)))
    each = drawn.select("speaker", F.posexplode(F.array(*(f"x{k}" for k in range(m)))).alias("m", "mu"))
    w = unit(F.lit("w"), "speaker", "m")
    return each.select("speaker", "m", (w / F.sum(w).over(Window.partitionBy("speaker"))).alias("w"), "mu", F.transform("mu", lambda _, i: unit(F.lit("v"), F.col("speaker"), F.col("m"), i)).alias("var"))


def train_in_steps(frames: DataFrame, model: DataFrame, max_iter: int = 20, epsilon: float = 0.0, var_floor: float = 0.0) -> DataFrame:
    """``train`` from a first ``model`` by aggregates over all tasks, for speakers of any size.

    As there, max_iter + 1 passes at most, and a speaker rests once its last
    gain was below epsilon. Each pass reads the frames once; the model, some
    rows a speaker, is checkpointed in the shared folder.
    """
    cut_folder(frames.sparkSession)
    names = [c.split()[0] for c in MODEL.split(", ")]
    model = model.select(*names, F.lit(NEG_INF).alias("loglik"), F.lit(float("inf")).alias("gain"))
    frames = frames.select(F.col("speaker").cast("string").alias("speaker"), "x")
    for _ in range(max_iter + 1):
        model = model.checkpoint()
        live, rest = model.where(F.col("gain") >= epsilon), model.where(F.col("gain") < epsilon)
        if live.isEmpty():
            break
        before = live.groupBy("speaker").agg(F.max("loglik").alias("before"))
        done = m_step(responsibilities(frames, live.select(*names)), var_floor).join(before, "speaker")
        gain = F.coalesce(nan_low(F.col("loglik") - F.col("before")), F.lit(NEG_INF))
        model = done.select(*names, "loglik", gain.alias("gain")).unionByName(rest)
    return model.select(*names)


def log_b(x: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        const = (mu**2 / var + np.log(var)).sum(axis=1) + x.shape[1] * math.log(2 * math.pi)
        return -0.5 * ((x**2) @ (1 / var).T - 2 * x @ (mu / var).T + const)


def fit(x: np.ndarray, m: int, max_iter: int, epsilon: float, seed: int, var_floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """max_iter + 1 passes at most; it stops before a pass once the last gain was below epsilon. Frames go in blocks."""
    r = np.random.default_rng(seed)
    w = r.random(m)
    w, mu, var = w / w.sum(), x[r.integers(0, len(x), m)], 1 - r.random((m, x.shape[1]))
    last, gain, i = -math.inf, math.inf, 0
    while i <= max_iter and gain >= epsilon:
        ll, s0, s1, s2 = 0.0, np.zeros(m), np.zeros_like(mu), np.zeros_like(mu)
        for at in range(0, len(x), 8192):
            block = x[at : at + 8192]
            joint = np.log(w) + log_b(block, mu, np.maximum(var, var_floor))
            top = joint.max(axis=1, keepdims=True)
            total = top + np.log(np.exp(joint - top).sum(axis=1, keepdims=True))
            p = np.exp(joint - total)
            ll += float(total.sum())
            s0 += p.sum(axis=0)
            s1 += p.T @ block
            s2 += p.T @ block**2
        w, mu = s0 / len(x), s1 / s0[:, None]
        var = np.maximum(s2 / s0[:, None] - mu**2, var_floor)
        gain, last, i = ll - last, ll, i + 1
    return w, mu, var


def train(frames: DataFrame, m: int = 8, max_iter: int = 20, epsilon: float = 0.0, seed: int = 401, var_floor: float = 0.0) -> DataFrame:
    """A mixture for each speaker of ``frames`` (speaker, x). Speakers are independent; one speaker's frames meet in one task.

    For speakers whose frames don't fit a task there is ``train_in_steps``.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        x = x[np.lexsort(x.T[::-1])]  # an order of its own, so the partitions don't count
        w, mu, var = fit(x, m, max_iter, epsilon, seed, var_floor)
        return pd.DataFrame({"speaker": pdf["speaker"].iloc[0], "m": range(m), "w": w, "mu": list(mu), "var": list(var)})

    return frames.select(F.col("speaker").cast("string"), "x").groupBy("speaker").applyInPandas(one, MODEL)


def hold_out(utterances: DataFrame, id_: str, seed: int = 401) -> DataFrame:
    """``utterances`` (speaker, id_) with test: one per speaker, by hash order."""
    order = Window.partitionBy("speaker").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_).cast("string"))))
    return utterances.withColumn("test", F.row_number().over(order) == 1)


#: Bytes of models that go to every task; beyond, models and utterances meet in blocks of about so many.
BLOCK_BYTES = 32 << 20


def identify(tests: DataFrame, model: DataFrame, k: int = 1) -> DataFrame:
    """(truth, utt, speaker, loglik, rank <= k, correct) of ``tests`` (truth, utt, x), every utterance against every model.

    Models of a checked size go to all tasks. More are cut into blocks, and the
    utterances too: each block of utterances is dealt to each of models, where
    its k best are picked, so only those are shuffled on. NaN likelihoods rank
    last; ties by speaker.
    """
    size = model.agg(F.sum((F.size("mu") + F.size("var")) * 8 + F.octet_length("speaker") + 32)).first()[0] or 0
    mixes, here = packed(model), ["truth", "utt"]
    if size <= BLOCK_BYTES:
        scored = tests.crossJoin(F.broadcast(mixes))
    else:
        held = tests.agg(F.sum(F.size("x") * 8 + 32)).first()[0] or 0
        n_models, n_tests = -(-size // BLOCK_BYTES), max(1, -(-held // BLOCK_BYTES))
        blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = tests.withColumns({"_t": F.pmod(F.xxhash64("truth", "utt"), F.lit(n_tests)), "_m": blocks(n_models)})
        right = mixes.withColumns({"_m": F.pmod(F.xxhash64("speaker"), F.lit(n_models)), "_t": blocks(n_tests)})
        scored, here = left.join(right.hint("merge"), ["_t", "_m"]), ["_t", "_m", "truth", "utt"]
    joint = F.transform("parts", lambda p: safe_ln(p["w"]) + log_density(F.col("x"), p["mu"], p["var"]))
    frames = scored.select(*here, "speaker", log_sum_exp(joint).alias("ll"))
    total = frames.groupBy(*here, "speaker").agg(F.coalesce(nan_low(F.sum("ll")), F.lit(NEG_INF)).alias("loglik"))

    def best(rows: DataFrame, by: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("loglik").desc(), "speaker"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= k)

    if len(here) > 2:
        total = best(total, here).select("truth", "utt", "speaker", "loglik")
    return best(total, ["truth", "utt"]).select("truth", "utt", "speaker", "loglik", "rank", (F.col("truth").cast("string") == F.col("speaker")).alias("correct"))


def open_set(model: DataFrame, speakers: DataFrame, trained: int) -> DataFrame:
    """``model`` of the first ``trained`` of ``speakers`` (speaker), by name; all others get an all-zero mixture of the same shape, whose NaN likelihood ranks last."""
    seen = speakers.select(F.col("speaker").cast("string").alias("speaker")).distinct().withColumn("rank", F.row_number().over(Window.orderBy("speaker")))  # a row per speaker
    shape = model.groupBy("m").agg(F.first(F.size("mu")).alias("d"))
    zero = F.array_repeat(F.lit(0.0), F.col("d"))
    empty = seen.where(F.col("rank") > trained).crossJoin(F.broadcast(shape)).select("speaker", "m", F.lit(0.0).alias("w"), zero.alias("mu"), zero.alias("var"))  # a row per component
    return model.join(seen.where(F.col("rank") <= trained).select("speaker"), "speaker").select("speaker", "m", "w", "mu", "var").unionByName(empty)


def experiment(frames: DataFrame, utterance: str, m: int = 8, max_iter: int = 20, epsilon: float = 0.0, trained: int | None = None, seed: int = 401, var_floor: float = 0.0) -> DataFrame:
    """(m, max_iter, trained, utterances, accuracy): one utterance of each speaker held out and named by models of the first ``trained`` speakers."""
    held = hold_out(frames.select("speaker", utterance).distinct(), utterance, seed)
    marked = frames.join(held, ["speaker", utterance])
    known = marked.where("not test")
    model = train(known.select("speaker", "x"), m, max_iter, epsilon, seed, var_floor)
    if trained is not None:
        model = open_set(model, held.select("speaker"), trained)
    named = identify(marked.where("test").select(F.col("speaker").alias("truth"), F.col(utterance).alias("utt"), "x"), model)
    return named.agg(F.count("*").alias("utterances"), F.avg(F.col("correct").cast("double")).alias("accuracy")).select(F.lit(m).alias("m"), F.lit(max_iter).alias("max_iter"), F.lit(trained).cast("int").alias("trained"), "utterances", "accuracy")


def sweep(frames: DataFrame, utterance: str, ms: Sequence[int] = (8, 6, 4, 2, 1), iterations: Sequence[int] = (0, 5, 10, 15, 20), speakers: Sequence[int] = (4, 8, 16, 24, 32), **others) -> DataFrame:
    """``experiment`` over component counts, then over iterations, then over trained speakers, each with the others at their default."""
    settings = [{"m": m} for m in ms] + [{"max_iter": i} for i in iterations] + [{"trained": n} for n in speakers]
    return reduce(DataFrame.unionByName, [experiment(frames, utterance, **(others | s)) for s in settings])


def empty_models(speakers: Iterator[str], m: int, d: int) -> list[tuple]:
    """All-zero models of speakers that weren't trained (open set): their likelihood is NaN, so they rank last."""
    return [(s, i, 0.0, [0.0] * d, [0.0] * d) for s in speakers for i in range(m)]
