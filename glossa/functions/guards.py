"""Numeric guards: what the engine's semantics want where Spark's default is null, an error or another order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def safe_log2(x: Column) -> Column:
    """log2 with log2(0) = -inf (Spark gives null)."""
    return F.when(x == 0, F.lit(NEG_INF)).otherwise(F.log2(x))


def safe_ln(x: Column) -> Column:
    return F.when(x == 0, F.lit(NEG_INF)).otherwise(F.log(x))


def nan_low(x: Column) -> Column:
    """NaN as -inf, so that it ranks last in descending order."""
    return F.nanvl(x, F.lit(NEG_INF))


def safe_div(a: Column, b: Column) -> Column:
    """a / b; null for b = 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_nan(a: Column, b: Column) -> Column:
    """a / b; NaN for 0 / 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(float("nan")))


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of exponentials of an array; all -inf: -inf."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.when(top == NEG_INF, F.lit(NEG_INF)).otherwise(top + F.log(total))
