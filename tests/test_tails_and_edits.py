"""Tail probabilities as expressions against plain Python, edit counts in linear space against the whole table."""

import math
import random
import tracemalloc

from pyspark.sql import functions as F

from glossa.operators import statistics
from glossa.operators.evaluation import edit_counts


def beta_share(a, b, x, y):
    """The regularised incomplete beta function by its power series or, near 1, the complement's."""
    if x > y:
        return 1 - beta_share(b, a, y, x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(y)) / a
    total = term = 1.0
    n = 0
    while abs(term) > 1e-17 * total:
        term *= (a + b + n) / (a + 1 + n) * x
        total += term
        n += 1
    return front * total


def f_tail(f, d1, d2):
    whole = d2 + d1 * f
    return beta_share(d2 / 2, d1 / 2, d2 / whole, d1 * f / whole)


def test_tails_equal_plain_python(spark):
    r = random.Random(1)
    rows = [(r.choice([0.01, 0.3, 1.0, 2.5, 7.0]), float(r.choice([1, 2, 3, 9, 80])), float(r.choice([1, 2, 5, 30, 400, 5000]))) for _ in range(200)]
    df = spark.createDataFrame(rows, "f double, d1 double, d2 double")
    out = df.select("f", "d1", "d2", statistics.f_tail(F.col("f"), F.col("d1"), F.col("d2")).alias("p"), statistics.t_tails(F.col("f"), F.col("d2")).alias("t")).collect()
    for x in out:
        for got, want in ((x.p, f_tail(x.f, x.d1, x.d2)), (x.t, f_tail(x.f * x.f, 1, x.d2))):
            assert abs(got - want) <= 1e-9 * got + 1e-11  # the series of the plain one cancels in the twelfth place


def test_odd_tails(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(nan, 1.0, 1.0), (inf, 2.0, 9.0), (0.0, 2.0, 9.0), (3.0, 2.0, 2_000_000.0)], "f double, d1 double, d2 double")
    p = [x.p for x in df.select(statistics.f_tail(F.col("f"), F.col("d1"), F.col("d2")).alias("p")).collect()]
    assert math.isnan(p[0]) and p[1] == 0.0 and p[2] == 1.0 and abs(p[3] - math.exp(-3)) < 1e-6
    plan = df.select(statistics.t_tails(F.col("f"), F.col("d2")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_log_gamma(spark):
    xs = [1e-3, 0.1, 0.5, 1.0, 1.5, 2.0, 10.0, 123.25, 1e4, 1e6]
    out = spark.createDataFrame([(x,) for x in xs], "x double").select("x", statistics.log_gamma(F.col("x")).alias("g")).collect()
    assert all(abs(r.g - math.lgamma(r.x)) <= 1e-11 * max(1, abs(r.g)) for r in out)


def whole_table(ref, hyp):
    """Counts along with distances in a table of both lengths, the first of deletion, insertion and match that is least."""
    t = {}
    for i in range(len(ref) + 1):
        for j in range(len(hyp) + 1):
            if i == 0 or j == 0:
                t[i, j] = (0, j, i)
                continue
            ways = [(sum(t[i - 1, j]) + 1, 0), (sum(t[i, j - 1]) + 1, 1), (sum(t[i - 1, j - 1]) + (ref[i - 1] != hyp[j - 1]), 2)]
            s, n, d = (t[i - 1, j], t[i, j - 1], t[i - 1, j - 1])[min(ways)[1]]
            t[i, j] = [(s, n, d + 1), (s, n + 1, d), (s + (ref[i - 1] != hyp[j - 1]), n, d)][min(ways)[1]]
    return t[len(ref), len(hyp)]


def test_ten_thousand_random_pairs():
    r = random.Random(2)
    for _ in range(10_000):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(2))
        assert edit_counts(a, b) == whole_table(a, b)


def test_memory_is_linear():
    r = random.Random(3)
    a, b = ([r.choice("abcdef") for _ in range(20_000)] for _ in range(2))
    tracemalloc.start()
    edit_counts(a[:2000], b)
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.stop()
