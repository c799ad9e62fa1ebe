"""Criterion scores from 0 to 1 as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))  # greatest alone skips nulls


def _finite(x) -> bool:
    return isinstance(x, (int, float)) and math.isfinite(x)


def score_ranges(rows: list[dict]) -> list[tuple[float, float, float]]:
    """(low, high, score) rows in order: bad rows go, reversed ones are turned, scores are clamped; overlaps raise."""
    out = []
    for row in rows or []:
        try:
            low, high, score = (float(row[k]) for k in ("min", "max", "score"))
        except (KeyError, TypeError, ValueError):
            continue
        if all(map(math.isfinite, (low, high, score))):
            out.append((min(low, high), max(low, high), min(1.0, max(0.0, score))))
    out.sort(key=lambda r: r[:2])
    for (a, b, _), (c, _, _) in zip(out, out[1:], strict=False):
        if c < b or b - a <= 1e-12 and abs(c - b) <= 1e-12:
            raise ValueError(f"score ranges overlap at {c}")
    return out


def score(v: Column, direction: str, low: float, high: float, target: float | None = None,
          prefer: tuple[float | None, float | None] = (None, None), ranges: list[dict] | None = None) -> Column:
    """Score of a criterion value: benefit, cost, target, range or reclass; others count as benefit.

    With low = high every score is 0; a target outside [low, high] moves to the middle, a bad preferred range to the middle half.
    """
    if direction == "reclass":
        rows = score_ranges(ranges or [])
        out = F.lit(0.0)
        for k, (a, b, s) in enumerate(rows):
            inside = (v == a) if b - a <= 1e-12 else (v >= a) & ((v <= b) if k == len(rows) - 1 else (v < b))
            out = out + F.when(inside, F.lit(s)).otherwise(0.0)
        return F.when(v.isNotNull(), out)
    if high == low:
        return F.when(v.isNotNull(), F.lit(0.0))
    up, down = (v - low) / (high - low), (F.lit(high) - v) / (high - low)
    if direction == "cost":
        return clamp01(down)
    if direction == "target":
        t = float(target) if _finite(target) and low <= target <= high else low + (high - low) / 2
        if t <= low:
            return clamp01(down)
        if t >= high:
            return clamp01(up)
        return clamp01(F.when(v <= t, (v - low) / (t - low)).otherwise((F.lit(high) - v) / (high - t)))
    if direction == "range":
        a, b = prefer
        if not (_finite(a) and _finite(b) and a < b):
            a, b = low + (high - low) * 0.25, low + (high - low) * 0.75
        out = F.when(v.isNull(), F.lit(None))
        if a > low:
            out = out.when(v < a, (v - low) / (a - low))
        if b < high:
            out = out.when(v > b, (F.lit(high) - v) / (high - b))
        return clamp01(out.otherwise(F.lit(1.0)))
    return clamp01(up)
