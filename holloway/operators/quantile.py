"""Exact quantiles of columns of any size: counts narrow the range down before single values are looked at."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that may be sorted at once, and ranges that a round counts.
FEW, RANGES = 100_000, 1000


def _at_rank(t: DataFrame, low: float, high: float, below: int, rank: int) -> float:
    """The value at a rank (from 0) of t.v, which lies in [low, high]; ``below`` values are less than low."""
    while True:
        inside = t.where(F.col("v").between(low, high))
        width = high / RANGES - low / RANGES
        if width <= 0 or low + width <= low:
            return low
        k = F.least(F.floor((F.col("v") - low) / width), F.lit(RANGES - 1)).alias("k")
        counts = sorted(inside.groupBy(k).agg(F.count(F.lit(1)), F.min("v"), F.max("v")).collect())
        for _, n, least, most in counts:
            if below + n > rank:
                break
            below += n
        if (least, most) == (low, high) and n > FEW:
            raise ArithmeticError(f"{n} values between {low} and {high} could not be told apart")
        low, high = least, most
        if low == high:
            return low
        if n <= FEW:
            return sorted(r[0] for r in t.where(F.col("v").between(low, high)).collect())[rank - below]


def quantile(t: DataFrame, value, share: float) -> float | None:
    """The value at a share (0 to 1) of the sorted values, between neighbours in proportion; nulls and nan are left out, and infinite
    values are the least and the greatest: between one of them and a finite value it is the infinite one.

    Each round counts the values in RANGES ranges in one aggregation and goes on in the one that holds the rank, so neither a task nor the
    driver ever has more than FEW values.
    """
    v = t.select(value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    infinite = F.col("v").isin(float("inf"), float("-inf"))
    finite = v.where(~infinite)
    n, under, over, low, high = v.agg(F.count(F.lit(1)), F.count_if(infinite & (F.col("v") < 0)), F.count_if(infinite & (F.col("v") > 0)), *[f(F.when(~infinite, F.col("v"))) for f in (F.min, F.max)]).first()
    if not n:
        return None
    value_at = lambda rank: -math.inf if rank < under else math.inf if rank >= n - over else _at_rank(finite, low, high, under, rank)
    at = share * (n - 1)
    first, part = value_at(int(at)), at - int(at)
    if part == 0 or math.isinf(first):
        return first
    return first + part * (value_at(int(at) + 1) - first)
