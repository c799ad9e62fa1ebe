"""Pairwise comparison weights, collinearity, and ranking of candidate places."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..lineage import cut
from .quantile import quantile

# Random consistency index for 1 to 15 criteria.
RANDOM_INDEX = (0.0, 0.0, 0.58, 0.90, 1.12, 1.24, 1.32, 1.41, 1.45, 1.49, 1.51, 1.48, 1.56, 1.57, 1.59)
LEAST, MOST = 1 / 9, 9.0


def clean_pairs(pairs: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """(a, b, ratio) for each pair of keys in their order, for each value of ``by``: given (a, b, ratio) rows are turned to it and clamped, the rest are 1.

    Of several rows for one pair the greatest ratio counts.
    """
    order = {k: i for i, k in enumerate(keys)}
    own = [by] * bool(by)
    every = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in keys for b in keys if order[a] < order[b]])
    whole = (pairs.select(by).distinct() if by else pairs.sparkSession.range(1).select()).select(*own, F.inline(every))
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    turned = rank[F.col("a")] > rank[F.col("b")]
    valid = pairs.where(F.col("ratio") > 0)
    given = valid.select(*own, F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), F.when(turned, 1 / F.col("ratio")).otherwise(F.col("ratio")).alias("ratio"))
    given = given.groupBy(*own, "a", "b").agg(F.max("ratio").alias("ratio"))
    return whole.join(given, [*own, "a", "b"], "left").select(*own, "a", "b", F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.coalesce("ratio", F.lit(1.0)))).alias("ratio"))


def pair_weights(pairs: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, criterion, weight, lambda_max, consistency): the weights of each judge's pair ratios (by, a, b, ratio); a task solves a batch of judges at once."""
    kind = pairs.schema[by].dataType.simpleString()
    rank = F.create_map(*[F.lit(x) for kv in enumerate(keys) for x in reversed(kv)])
    listed = F.array_sort(F.collect_list(F.struct(rank[F.col("a")].alias("i"), rank[F.col("b")].alias("j"), "ratio")))  # one row a pair of criteria

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i, j = np.triu_indices(len(keys), 1)
        for t in batches:
            if len(t):
                m = np.ones((len(t), len(keys), len(keys)))
                m[:, i, j] = np.stack(t["ratios"])
                m[:, j, i] = 1 / m[:, i, j]
                w, top, ratio = stacked_weights(m)
                each = lambda v: np.repeat(v, len(keys))
                yield pd.DataFrame({by: each(t[by]), "criterion": np.tile(keys, len(t)), "weight": w.ravel(), "lambda_max": each(top), "consistency": each(ratio)})

    rows = clean_pairs(pairs, keys, by).groupBy(by).agg(F.transform(listed, lambda x: x["ratio"]).alias("ratios"))
    return rows.mapInPandas(solve, f"{by} {kind}, criterion string, weight double, lambda_max double, consistency double")


def hierarchy_weights(outer: DataFrame, inner: DataFrame, by: str) -> DataFrame:
    """(by, criterion, weight): the weight of each judge's groups (by, grp, weight) times that of the criteria in them (by, grp, criterion, weight), summing to one."""
    both = inner.join(outer.select(by, "grp", F.col("weight").alias("w")), [by, "grp"]).select(by, "criterion", (F.col("weight") * F.col("w")).alias("weight"))
    return both.join(both.groupBy(by).agg(F.sum("weight").alias("total")), by).select(by, "criterion", (F.col("weight") / F.col("total")).alias("weight"))


def matrix(keys: list[str], ratios: dict[tuple[str, str], float]) -> np.ndarray:
    """The reciprocal matrix of pair ratios; missing pairs are 1."""
    out = np.ones((len(keys), len(keys)))
    for i, a in enumerate(keys):
        for j in range(i + 1, len(keys)):
            v = ratios.get((a, keys[j]), 1 / ratios[keys[j], a] if (keys[j], a) in ratios else 1.0)
            out[i, j], out[j, i] = v, 1 / v
    return out


def weights(m: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights (principal eigenvector), largest eigenvalue and consistency ratio; the ratio is nan beyond 15 criteria."""
    if len(m) == 0:
        return np.empty(0), 0.0, 0.0
    w, top, ratio = stacked_weights(m[None])
    return w[0], float(top[0]), float(ratio[0])


def stacked_weights(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As weights(), of many matrices of one size."""
    n, at = m.shape[1], np.arange(len(m))
    values, vectors = np.linalg.eig(m)
    k = values.real.argmax(axis=1)
    w, top = np.abs(vectors[at, :, k].real), values.real[at, k]
    ratio = np.zeros(len(m)) if n <= 2 else np.full(len(m), math.nan) if n > len(RANDOM_INDEX) else (top - n) / (n - 1) / RANDOM_INDEX[n - 1]
    return w / w.sum(axis=1, keepdims=True), top, ratio


def hierarchy(groups: dict[str, list[str]], group_ratios: dict, local_ratios: dict) -> dict[str, float]:
    """Weight of each criterion for one judge: its group's weight times its weight in the group, summing to one."""
    names = [g for g, members in groups.items() if members]
    outer, _, _ = weights(matrix(names, group_ratios))
    out = {}
    for g, w in zip(names, outer, strict=True):
        inner, _, _ = weights(matrix(groups[g], local_ratios))
        out |= {c: float(w * x) for c, x in zip(groups[g], inner, strict=True)}
    total = sum(out.values())
    return {c: v / total for c, v in out.items()} if total else out


def correlations(t: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all column pairs, in one aggregation over rows with all values."""
    full = t.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = full.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])))


def inflation(t: DataFrame, columns: list[str], warn: float = 5.0, bad: float = 10.0) -> DataFrame:
    """(column, vif, level): variance inflation of each column by the others, from one aggregated correlation matrix.

    A constant column is nan; a column that the others explain fully is infinite.
    """
    r = {(x.a, x.b): x.r for x in correlations(t, columns).collect()}
    n = len(columns)
    m = np.array([[r[columns[min(i, j)], columns[max(i, j)]] for j in range(n)] for i in range(n)], dtype=float)
    rows = []
    for k, c in enumerate(columns):
        others = [j for j in range(n) if j != k and not math.isnan(m[j, j])]
        if math.isnan(m[k, k]):
            vif = math.nan
        elif not others:
            vif = 1.0
        else:
            x, y = m[np.ix_(others, others)], m[others, k]
            explained = float(y @ np.linalg.lstsq(x, y, rcond=None)[0])
            vif = math.inf if explained >= 0.999999 else 1 / (1 - explained)
        rows.append((c, vif, "bad" if vif >= bad else "warn" if vif >= warn else "ok"))
    return t.sparkSession.createDataFrame(rows, "column string, vif double, level string")


def trench_score(slope: Column, reference: Column, suitability: Column, weights: tuple[float, float, float] = (0.55, 0.25, 0.20), steepest: float = 30.0, radius: float = 1000.0) -> Column:
    """Weighted mean of flatness, nearness to known sites and suitability (0 to 1), over those that are there."""
    parts = [1 - slope / steepest, 1 - reference / radius, suitability]
    parts = [F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))) for p in parts]
    total = sum(F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for p, w in zip(parts, weights, strict=True))
    return F.when(total > 0, sum(F.coalesce(p * w, F.lit(0.0)) for p, w in zip(parts, weights, strict=True)) / total)


def spaced(candidates: DataFrame, most: int, spacing: float, coverage: float, block: int = 5000) -> DataFrame:
    """(id, rank, x, y, score): up to ``most`` of the ``candidates`` (id, x, y, score), none nearer than ``spacing`` to another. Coverage squares take
    turns, the one with the best candidate first; in its turn a square gives its best candidate that fits with all chosen before.

    The choice is sequential, so rows come to the driver in blocks: those of the next places in their squares. Before each block Spark drops what does not fit
    with the chosen ones (a list of at most ``most``); blocks go on until enough are chosen or no candidate is left, so none is overlooked.
    """
    bx, by = F.floor(F.col("x") / coverage), F.floor(F.col("y") / coverage)
    left = cut(candidates.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("score").cast("double").alias("score"), bx.alias("bx"), by.alias("by")))
    squares = left.groupBy("bx", "by").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("top"))
    left = cut(left.join(squares, ["bx", "by"]))
    kept: list = []
    while len(kept) < most:
        # A turn: every square's best that fits. Squares come in blocks, as those chosen first may rule out the rest's best.
        before, chosen = None, len(kept)
        while len(kept) < most:
            open_ = left if before is None else left.where((F.col("top.s") > before[0]) | (F.col("top.s") == before[0]) & (F.col("top.id") > before[1]))
            for k in kept:
                open_ = open_.where((F.col("x") - k.x) * (F.col("x") - k.x) + (F.col("y") - k.y) * (F.col("y") - k.y) >= spacing * spacing)
            best = open_.groupBy("bx", "by", "top").agg(F.max(F.struct("score", (-F.col("id")).alias("i"), "x", "y")).alias("b"))
            rows = best.orderBy("top").limit(block).collect()
            got = None
            for row in rows:
                if all((row.b.x - k.x) ** 2 + (row.b.y - k.y) ** 2 >= spacing * spacing for k in kept):
                    got = Row(id=-row.b.i, x=row.b.x, y=row.b.y, score=row.b.score)
                    kept.append(got)
                    before = (row.top.s, row.top.id)
                    if len(kept) == most:
                        break
                elif got is not None:
                    break  # this square's best does not fit any more: ask for its next ones
            else:
                if len(rows) < block:
                    break
        if len(kept) == chosen:
            break
    return candidates.sparkSession.createDataFrame([(k.id, i, k.x, k.y, k.score) for i, k in enumerate(kept, 1)], "id long, rank int, x double, y double, score double")


def checked(t: DataFrame, value: Column, limits: tuple[float, ...]) -> DataFrame:
    """One row: n, least, most, mean, middle (median) of a surface at known places, and the per cent of them at or over each limit (over_50 for 0.5)."""
    v = t.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    middle = quantile(v, F.col("v"), 0.5)
    shares = [(100.0 * F.count_if(F.col("v") >= x) / F.count("*")).alias(f"over_{round(100 * x)}") for x in limits]
    return v.agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"), F.lit(middle).cast("double").alias("middle"), *shares)


def view_mode(points: int, weighted: bool = False, counted: bool = False, line: bool = False) -> str:
    """How views of several observers are put together: weighted, count, union (a line or over 20 points) or flags."""
    return "weighted" if weighted else "count" if counted else "union" if line or points > 20 else "flags"


def preferences(mode: str, low: float, high: float, target: float | None = None, span: tuple[float | None, float | None] = (None, None), ranges: list | None = None) -> dict:
    """Valid preferences of a criterion with values from ``low`` to ``high``: a missing or outlying target is the middle, a span the middle half, ranges one of score 1."""
    low, high = min(low, high), max(low, high)
    ok = lambda v: v is not None and math.isfinite(v) and low <= v <= high
    if mode == "target":
        return {"target": target if ok(target) else (low + high) / 2}
    if mode == "range":
        good = ok(span[0]) and ok(span[1]) and span[0] < span[1]
        return {"span": tuple(span) if good else (low + (high - low) / 4, low + (high - low) * 3 / 4)}
    return {"ranges": list(ranges) if ranges else [(low, high, 1.0)]} if mode == "reclass" else {}


def grouped(criteria: list[str], groups: dict[str, list[str]]) -> dict[str, list[str]]:
    """Groups with known criteria only, each in one group; a criterion without a group is a group of its own."""
    left, out = list(criteria), {}
    for name, members in groups.items():
        own = [m for m in dict.fromkeys(members) if m in left]
        left = [c for c in left if c not in own]
        if own:
            out[name] = own
    return out | {c: [c] for c in left}


def snapped(ratio: float) -> float:
    """The nearest ratio of the scale 1/9, ..., 1/2, 1, 2, ..., 9."""
    scale = [1 / k for k in range(9, 1, -1)] + [float(k) for k in range(1, 10)]
    return min(scale, key=lambda v: abs(v - ratio))
