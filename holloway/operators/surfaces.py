"""Visibility and interpolation over rasters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .graph import nearest
from .profile import EARTH
from .quantile import quantile


#: Systems that are solved at once, and observers at one place whose views are made at once.
STACKED, SHARED = 1024, 64


def bend(curvature: bool = True, refraction: bool = True, k: float = 0.13) -> float:
    """The share of the earth's curvature that lowers far cells; refraction counts only with curvature."""
    return 0.0 if not (curvature or refraction) else max(0.0, min(1.0, 1 - k)) if refraction else 1.0


def _sweep(reach: int, cell: float, target_height: float, cc: float):
    """Kernel: what observers (obs) at one place and height see of the cells round it. Rays are walked side by side, one step of all at a time."""
    i, j = (a.ravel() for a in np.mgrid[-reach : reach + 1, -reach : reach + 1])
    round_ = (i * i + j * j > 0) & (i * i + j * j <= reach * reach)
    i, j = i[round_], j[round_]
    m, away = np.maximum(np.abs(i), np.abs(j)), np.sqrt((i * i + j * j).astype(float)) * cell

    def run(part: pd.DataFrame, who: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(who):
            return pd.DataFrame({k: [] for k in ("obs", "r", "c", "distance", "visible")})
        r0, c0, h = (part[k].iloc[0] for k in ("r0", "c0", "h"))
        z = np.full((2 * reach + 1, 2 * reach + 1), np.nan)
        z[part["r"] - r0 + reach, part["c"] - c0 + reach] = part["z"]
        z0 = z[reach, reach]
        before, own = np.full(len(i), -np.inf), np.full(len(i), np.nan)
        for k in range(1, reach + 1):
            at = np.flatnonzero(m >= k)
            share = k / m[at]
            y = z[reach + np.floor(i[at] * share + 0.5).astype(int), reach + np.floor(j[at] * share + 0.5).astype(int)]
            d, last = away[at] * share, m[at] == k
            angle = (y + np.where(last, target_height, 0.0) - cc * d * d / (2 * EARTH) - z0 - h) / d
            own[at[last]] = angle[last]
            before[at] = np.where(last, before[at], np.fmax(before[at], angle))
        ok = ~np.isnan(own)
        obs, seen = who["obs"].to_numpy(), (r0 + i[ok], c0 + j[ok], away[ok], own[ok] >= before[ok])
        return pd.DataFrame({"obs": np.repeat(obs, len(seen[0])), **{k: np.tile(v, len(obs)) for k, v in zip(("r", "c", "distance", "visible"), seen, strict=True)}})

    return run


def viewsheds(cells: DataFrame, observers: DataFrame, reach: int, cell: float, target_height: float = 0.0, cc: float = 0.87) -> DataFrame:
    """(obs, r, c, distance, visible) of the cells with data within ``reach`` cells of each observer (obs, r, c, h).

    A cell is seen when no cell on the ray to it stands at a steeper angle; elevations are lowered by the bent earth's curvature. Cells meet observers by
    an equi-join on squares as wide as the reach. Observers at one place and height share its surroundings and view, some SHARED at a time; a task holds one place's.
    """
    o = cut(observers.select("obs", F.col("h").cast("double").alias("h"), F.col("r").cast("long").alias("r0"), F.col("c").cast("long").alias("c0")).distinct())
    place = ["r0", "c0", "h"]
    most = o.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    o = o.withColumn("part", F.pmod(F.xxhash64("obs"), F.lit(-(-most // SHARED))).cast("int"))
    who, o = o, o.select(*[F.col(k).alias(k) for k in (*place, "part")]).distinct()
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    filed = o.select("*", F.explode(F.transform(around, lambda i: F.floor(F.col("r0") / reach) + i)).alias("sr")).select("*", F.explode(F.transform(around, lambda i: F.floor(F.col("c0") / reach) + i)).alias("sc"))
    base = cells.where("z IS NOT NULL").select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("z").cast("double").alias("z"), F.floor(F.col("r") / reach).alias("sr"), F.floor(F.col("c") / reach).alias("sc"))
    dr, dc = F.col("r") - F.col("r0"), F.col("c") - F.col("c0")
    near = filed.join(base, ["sr", "sc"]).where(dr * dr + dc * dc <= reach * reach)
    kind = observers.schema["obs"].dataType.simpleString()
    by = [*place, "part"]
    seen = near.select(*by, "r", "c", "z").groupBy(*by).cogroup(who.groupBy(*by)).applyInPandas(_sweep(reach, cell, target_height, cc), f"obs {kind}, r long, c long, distance double, visible boolean")
    return seen


def cumulative(seen: DataFrame, weights: DataFrame) -> DataFrame:
    """(r, c, seen_any, n_seen, flags, weighted, weighted_pct) over observers (obs, flag, weight)."""
    total = weights.agg(F.sum("weight").alias("total"))
    v = F.col("visible").cast("int")
    out = seen.join(weights, "obs").groupBy("r", "c").agg(F.max(v).alias("any"), F.sum(v).alias("n_seen"), F.bit_or(F.when(F.col("visible"), F.expr("shiftleft(1L, least(flag, 30))")).otherwise(F.lit(0).cast("long"))).alias("flags"), F.sum(v * F.col("weight")).alias("weighted"))
    return out.crossJoin(F.broadcast(total)).select("r", "c", (F.col("any") == 1).alias("seen_any"), "n_seen", "flags", "weighted", (100 * F.col("weighted") / F.col("total")).alias("weighted_pct"))


def imbalance(forward: DataFrame, back: DataFrame) -> DataFrame:
    """1 where only the forward view sees, 2 where only the reverse one does, else 0; cells that both have."""
    both = forward.select("r", "c", F.col("visible").alias("f")).join(back.select("r", "c", F.col("visible").alias("b")), ["r", "c"])
    return both.select("r", "c", F.when(F.col("f") & ~F.col("b"), 1).when(F.col("b") & ~F.col("f"), 2).otherwise(0).alias("imbalance"))


def sight_lines(pairs: DataFrame, cells: DataFrame, cell: float, step: float, least: int = 80, most: int = 2000) -> DataFrame:
    """(a, b, i, n, t, d, z): samples along each pair (a, b, ra, ca, rb, cb), nearest cells; z is null without data."""
    length = F.sqrt((F.col("rb") - F.col("ra")) * (F.col("rb") - F.col("ra")) + (F.col("cb") - F.col("ca")) * (F.col("cb") - F.col("ca"))) * cell
    n = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(length / step).cast("int")))
    at = pairs.withColumns({"length": length, "n": n}).select("*", F.explode(F.sequence(F.lit(0), "n")).alias("i")).withColumn("t", F.col("i") / F.col("n"))
    place = lambda p, q: F.floor(F.col(p) + (F.col(q) - F.col(p)) * F.col("t") + 0.5)
    return at.withColumns({"r": place("ra", "rb"), "c": place("ca", "cb"), "d": F.col("length") * F.col("t")}).join(cells, ["r", "c"], "left").select("a", "b", "i", "n", "t", "d", "z")


def in_sight(lines: DataFrame, observer: float = 1.6, target: float = 0.0) -> DataFrame:
    """(a, b, visible): whether no sample inside stands over the straight line; null if an end has no data."""
    ends = lines.groupBy("a", "b").agg(F.max(F.when(F.col("i") == 0, F.col("z"))).alias("za"), F.max(F.when(F.col("i") == F.col("n"), F.col("z"))).alias("zb"))
    over = F.col("z") > F.col("za") + observer + (F.col("zb") + target - F.col("za") - observer) * F.col("t")
    inside = lines.join(ends, ["a", "b"]).withColumn("over", F.when((F.col("i") > 0) & (F.col("i") < F.col("n")), over))
    return inside.groupBy("a", "b").agg(F.when(F.max("za").isNotNull() & F.max("zb").isNotNull(), ~F.coalesce(F.max("over"), F.lit(False))).alias("visible"))


# Interpolation


def _neighbours(targets: DataFrame, points: DataFrame, k: int) -> DataFrame:
    near = nearest(targets, points, k)
    return near.join(points.select(F.col("id").alias("b"), F.col("x").alias("px"), F.col("y").alias("py"), "z").hint("merge"), "b")


def _all_pairs(targets: DataFrame, points: DataFrame) -> DataFrame:
    """(a, d2, z) of every target with every point."""
    dx, dy = F.col("ax") - F.col("px"), F.col("ay") - F.col("py")
    a = targets.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    return a.crossJoin(points.select(F.col("x").alias("px"), F.col("y").alias("py"), "z")).select("a", (dx * dx + dy * dy).alias("d2"), "z")


def inverse_distance(targets: DataFrame, points: DataFrame, k: int | None = 12, power: float = 2.0) -> DataFrame:
    """(id, z) from the k nearest points, weighted by distance to minus ``power``; a point in the place itself decides.

    Without ``k`` all points count for every target: these pairs are neither ranked nor shuffled, only their sums are.
    """
    w = F.pow("d2", F.lit(-power / 2))
    near = _neighbours(targets, points, k) if k is not None else _all_pairs(targets, points)
    hit = F.avg(F.when(F.col("d2") == 0, F.col("z")))
    away = F.when(F.col("d2") > 0, w)
    return near.groupBy(F.col("a").alias("id")).agg(F.coalesce(hit, F.sum(away * F.col("z")) / F.sum(away)).alias("z"))


def kriging_parameters(points: DataFrame) -> tuple[float, float, float]:
    """(nugget, partial sill, range): 5 % and the rest of the sample variance, three times the median distance of nearest points."""
    var = points.agg(F.var_samp("z")).first()[0] or 0.0
    var = var if var > 0 else 1e-6
    gap = quantile(cut(nearest(points, points, 1, same=True).where("d2 > 0").select("d2")), F.sqrt("d2"), 0.5)
    return var * 0.05, max(1e-6, var * 0.95), max(1e-6, 3 * (gap or 1.0))


def kriging(targets: DataFrame, points: DataFrame, k: int = 16, parameters: tuple[float, float, float] | None = None) -> DataFrame:
    """(id, z, variance): ordinary kriging with an exponential covariance from the k nearest points (three at least).

    Neighbours are found by joins; each batch of targets then solves its small systems at once.
    """
    nugget, sill, reach = parameters or kriging_parameters(points)
    place = targets.select(F.col("id").alias("a"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    near = _neighbours(targets, points, max(3, k)).join(place, "a").groupBy("a", "tx", "ty").agg(F.sort_array(F.collect_list(F.struct("d2", "b", "px", "py", "z"))).alias("p"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["p"].map(len)
            for n in sorted(set(sizes[sizes >= 3])):  # systems of one size are solved at once
                part = batch[sizes == n]
                for lo in range(0, len(part), STACKED):
                    own = part.iloc[lo : lo + STACKED]
                    x, y, z = (np.array([[q[f] for q in p] for p in own["p"]], float) for f in ("px", "py", "z"))
                    m = np.ones((len(own), n + 1, n + 1))
                    m[:, :n, :n] = sill * np.exp(-np.hypot(x[:, :, None] - x[:, None, :], y[:, :, None] - y[:, None, :]) / reach)
                    at = np.arange(n)
                    m[:, at, at] = sill + nugget
                    m[:, n, n] = 0
                    right = np.ones((len(own), n + 1))
                    right[:, :n] = sill * np.exp(-np.hypot(x - own["tx"].to_numpy()[:, None], y - own["ty"].to_numpy()[:, None]) / reach)
                    try:
                        w = np.linalg.solve(m, right[:, :, None])[:, :, 0]
                    except np.linalg.LinAlgError:
                        m[:, at, at] += max(1e-12, sill * 1e-10)
                        w = np.linalg.solve(m, right[:, :, None])[:, :, 0]
                    variance = sill + nugget - (w[:, :n] * right[:, :n]).sum(axis=1) - w[:, n]
                    yield pd.DataFrame({"id": own["a"].to_numpy(), "z": (w[:, :n] * z).sum(axis=1), "variance": np.maximum(0.0, variance)})

    return near.mapInPandas(solve, "id long, z double, variance double")
