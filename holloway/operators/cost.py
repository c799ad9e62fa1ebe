"""Accumulated movement cost over rasters of any size, least-cost paths, and what is read off them.

A raster is cut into tiles; a row of the tile table holds one tile with a rim of one cell, packed. Each round searches only the tiles that
were told of a lower cost, and sends the border cells that got cheaper to the tiles that have them in their rims, until none did.
A task holds one tile; narrow rasters have high ones, as a front goes on by one tile a round. A search that needs no cost over some limit
(``Movement.most``, or what its targets cost) does not go beyond it. ``job`` tells searches apart that run side by side, each in cells of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.movement import HERZOG
from ..lineage import cut

#: Bytes of messages that may be broadcast, and rounds between cuts of the tile table.
BROADCAST, KEPT_ROUNDS = 32 << 20, 8
#: Tiles' usual width, the cells of a tile that fitted() makes (about 400 MB in a task that searches it), and rows between changes that are still searched together.
WIDTH, CELLS, APART = 512, 1 << 21, 32
_MOVES = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
TILE = "job long, tr long, tc long, r0 long, c0 long, h int, w int, z binary, f binary, g binary"
MESSAGE = "array<struct<tr: long, tc: long, r: long, c: long, cost: double>>"


@dataclass(frozen=True)
class Movement:
    """How a step costs: cell size, model, ``time`` (seconds) or ``energy`` (joules), from the starts or to them, the tiles' width, their
    height if it is another, and the limit beyond which costs are of no interest."""

    cell: float
    model: str = "tobler"
    mode: str = "time"
    reverse: bool = False
    tile: int = WIDTH
    params: dict = field(default_factory=dict)
    down: int = 0
    most: float = math.inf

    @property
    def rows(self) -> int:
        return self.down or self.tile

    def tiles(self, r: Column, c: Column) -> dict[str, Column]:
        """The tile of a cell."""
        return {"tr": F.floor(r / self.rows), "tc": F.floor(c / self.tile)}

    def steps(self, length: float, climb: np.ndarray) -> np.ndarray:
        return step_costs(self.model, length, -climb if self.reverse else climb, self.mode, **self.params)


def fitted(cells: DataFrame, move: Movement) -> Movement:
    """``move`` with tiles of up to CELLS cells: the narrower the raster, the higher."""
    low, high = cells.agg(F.min("c"), F.max("c")).first()
    return move if low is None else replace(move, down=max(move.tile, CELLS // min(move.tile, int(high) - int(low) + 1)))


def step_costs(model: str, h: float, dz: np.ndarray, mode: str = "time", **p) -> np.ndarray:
    """``functions.movement.step_cost`` for an array of climbs over one length."""
    s = dz / h
    if model == "tobler":
        return h / np.maximum(p.get("min_mps", 0.05), p.get("base_kmh", 6.0) * np.exp(-p.get("factor", 3.5) * np.abs(s + p.get("offset", 0.05))) / 3.6)
    floor = p.get("min_mps", 0.05)
    base = max(floor, p.get("base_kmh", 4.0 if model == "wheeled" else 5.0) / 3.6)
    if model == "herzog":
        return h / np.maximum(floor, base * HERZOG[-1] / np.maximum(1e-9, np.polyval(HERZOG, np.abs(s))))
    if model == "conolly":
        return h / base * np.maximum(1.0, np.abs(s) / max(1e-9, math.tan(math.radians(max(0.1, p.get("ref_deg", 1.0))))))
    if model == "wheeled":
        critical = max(1e-9, math.tan(math.radians(max(1.0, p.get("critical_deg", 12.0)))))
        steep = np.degrees(np.arctan(np.abs(s))) > max(1.0, min(89.0, p.get("max_deg", 45.0))) + 1e-9
        return np.where(steep, np.inf, h / np.maximum(floor, base / (1.0 + (np.abs(s) / critical) ** 2)))
    if model == "pandolf":
        v = max(0.05, p.get("speed_mps", 5 / 3.6))
        if mode != "energy":
            return np.where(np.isnan(dz), np.nan, h / v)
        body, load, eta = max(1.0, p.get("body_kg", 70.0)), max(0.0, p.get("load_kg", 0.0)), max(0.1, p.get("terrain", 1.0))
        watts = 1.5 * body + 2.0 * (body + load) * (load / body) ** 2 + eta * (body + load) * (1.5 * v * v + 0.35 * v * (s * 100.0))
        return np.maximum(1.5 * body, watts) * h / v
    return h * (3600.0 / (max(1e-4, p.get("kmh", 5.0)) * 1000.0)) + np.maximum(0.0, dz) * (3600.0 / max(1e-4, p.get("ascent_m_per_h", 600.0)))


def friction(values: Column, scale: float = 1.0) -> Column:
    """A multiplier of cost: missing or not positive is 1, kept within 0.0001 and a million."""
    return F.least(F.greatest(F.coalesce(F.when(values > 0, values), F.lit(1.0)) * scale, F.lit(1e-4)), F.lit(1e6))


class _Tile:
    """One unpacked row of the tile table."""

    def __init__(self, row, move: Movement):
        self.row, self.move, self.shape = row, move, (int(row["h"]), int(row["w"]))
        self.r0, self.c0 = int(row["r0"]), int(row["c0"])
        self.z = np.frombuffer(row["z"], np.float64).reshape(self.shape)
        self.f = np.frombuffer(row["f"], np.float64).reshape(self.shape) if row["f"] else None
        self.g = np.frombuffer(row["g"], np.float64).copy()

    def own(self) -> np.ndarray:
        """Which cells are this tile's own and not its rim's."""
        r, c = (np.arange(n) + o for n, o in zip(self.shape, (self.r0, self.c0), strict=True))
        return ((r // self.move.rows == self.row["tr"])[:, None] & (c // self.move.tile == self.row["tc"])[None, :]).ravel()

    def edge(self) -> np.ndarray:
        """Which cells may lie in another tile's rim."""
        r, c = (np.arange(n) + o for n, o in zip(self.shape, (self.r0, self.c0), strict=True))
        return (np.isin(r % self.move.rows, (0, self.move.rows - 1))[:, None] | np.isin(c % self.move.tile, (0, self.move.tile - 1))[None, :]).ravel()

    def steps(self) -> list[tuple[int, int, np.ndarray]]:
        """(rows, columns, costs to each cell) of the eight moves; infinity where there is no way."""
        h, w = self.shape
        out = []
        for i, j in _MOVES:
            a = (slice(max(0, -i), h - max(0, i)), slice(max(0, -j), w - max(0, j)))
            b = (slice(max(0, i), h + min(0, i)), slice(max(0, j), w + min(0, j)))
            cost = np.full(self.shape, np.inf)
            cost[b] = self.move.steps(self.move.cell * math.hypot(i, j), self.z[b] - self.z[a])
            if self.f is not None:
                cost[b] = cost[b] * (self.f[a] + self.f[b]) / 2
            cost[np.isnan(cost)] = np.inf
            out.append((i, j, cost))
        return out

    def search(self, known: list[tuple[int, float]]) -> np.ndarray:
        """Lower the costs from what is known of some cells on; returns which cells got cheaper. Costs over the limit stay unknown.

        All cells of the rows round the last changes are lowered at once, until none changes.
        """
        (h, w), solid, before, most = self.shape, ~np.isnan(self.z).ravel(), self.g, self.move.most
        g = np.full((h + 2, w + 2), np.inf)
        inner = g[1:-1, 1:-1]
        inner[:] = before.reshape(self.shape)
        rows = set()
        for p, cost in known:
            if solid[p] and cost < inner[divmod(p, w)] and cost <= most:
                inner[divmod(p, w)] = cost
                rows.add(p // w)
        changed, steps = np.array(sorted(rows), np.int64), self.steps() if rows else []
        while len(changed):
            found = []
            for run in np.split(changed, np.flatnonzero(np.diff(changed) > APART) + 1):
                lo, hi = max(0, run[0] - 1), min(h, run[-1] + 2)
                new = inner[lo:hi].copy()
                for i, j, cost in steps:
                    np.minimum(new, g[lo + 1 - i:hi + 1 - i, 1 - j:w + 1 - j] + cost[lo:hi], out=new)
                if most < math.inf:
                    new[new > most] = np.inf
                found.append(lo + np.flatnonzero((new < inner[lo:hi]).any(axis=1)))
                inner[lo:hi] = new
            changed = np.concatenate(found)
        self.g = inner.ravel()
        return self.g < before

    def place(self, r: int, c: int) -> int:
        return (r - self.r0) * self.shape[1] + c - self.c0

    def packed(self) -> dict:
        return {**{k: self.row[k] for k in ("job", "tr", "tc", "r0", "c0", "h", "w", "z", "f")}, "g": self.g.tobytes()}


def _pack(move: Movement):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        r, c = part["r"].to_numpy(), part["c"].to_numpy()
        r0, c0 = int(r.min()), int(c.min())
        z = np.full((int(r.max()) - r0 + 1, int(c.max()) - c0 + 1), np.nan)
        g = np.full(z.shape, np.inf)
        z[r - r0, c - c0] = part["z"]
        rate = b""
        if (part["friction"] != 1).any():
            f = np.ones(z.shape)
            f[r - r0, c - c0] = part["friction"]
            rate = f.tobytes()
        first = part.iloc[0]
        return pd.DataFrame([{"job": first["job"], "tr": first["tr"], "tc": first["tc"], "r0": r0, "c0": c0, "h": z.shape[0], "w": z.shape[1], "z": z.tobytes(), "f": rate, "g": g.tobytes()}])

    return run


def _near_tiles(move: Movement) -> list[Column]:
    """The tiles that have a cell (r, c), in their rims too."""
    side = lambda k, size: F.array_distinct(F.array(*[F.floor((F.col(k) + i) / size) for i in (-1, 0, 1)]))
    return [F.explode(side("r", move.rows)).alias("tr"), F.explode(side("c", move.tile)).alias("tc")]


def tiles_of(cells: DataFrame, move: Movement) -> DataFrame:
    """The tile table of ``cells`` (r, c, z, and if there are: friction, job)."""
    job = F.col("job") if "job" in cells.columns else F.lit(0)
    rate = F.col("friction") if "friction" in cells.columns else F.lit(1.0)
    rows = cells.select(job.cast("long").alias("job"), *[F.col(k).cast("long").alias(k) for k in "rc"], F.col("z").cast("double").alias("z"), rate.cast("double").alias("friction"))
    down, across = _near_tiles(move)
    return cut(rows.select("*", down).select("*", across).groupBy("job", "tr", "tc").applyInPandas(_pack(move), TILE))


def _searched(move: Movement):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        row = part.iloc[0]
        t = _Tile(row, move)
        known = [(m["r"], m["c"], m["cost"]) for m in row["told"] if 0 <= m["r"] - t.r0 < t.shape[0] and 0 <= m["c"] - t.c0 < t.shape[1]]
        cheaper = t.search([(t.place(r, c), cost) for r, c, cost in known]) & t.own()
        out = []
        for p in np.flatnonzero(cheaper & t.edge()):
            r, c = t.r0 + int(p) // t.shape[1], t.c0 + int(p) % t.shape[1]
            near = {((r + i) // move.rows, (c + j) // move.tile) for i, j in _MOVES} - {(row["tr"], row["tc"])}
            out += [{"tr": a, "tc": b, "r": r, "c": c, "cost": float(t.g[p])} for a, b in near]
        return pd.DataFrame([{**t.packed(), "out": out}])

    return run


def spread(tiles: DataFrame, starts: DataFrame, move: Movement, targets: DataFrame | None = None) -> DataFrame:
    """``tiles`` with the least costs from the starts (r, c, and job if there are several searches).

    With ``targets`` (r, c; one search only) costs are right at these and wherever they are lower: once all are reached, nothing is sent on that costs more than the dearest.
    """
    at = starts.select((F.col("job") if "job" in starts.columns else F.lit(0)).cast("long").alias("job"), *[F.col(k).cast("long").alias(k) for k in "rc"]).distinct()
    told = cut(at.withColumns(move.tiles(F.col("r"), F.col("c"))).select("job", "tr", "tc", "r", "c", F.lit(0.0).alias("cost")))
    goals = None if targets is None else cut(targets.select(F.lit(0).cast("long").alias("job"), *[F.col(k).cast("long").alias(k) for k in "rc"]).distinct())
    keys, names = ["job", "tr", "tc"], [f.split()[0] for f in TILE.split(", ")]
    n = 0
    while (size := told.count()):
        grouped = told.groupBy(*keys).agg(F.collect_list(F.struct("r", "c", "cost")).alias("told"))
        grouped = F.broadcast(grouped) if size * 48 < BROADCAST else grouped
        done = cut(tiles.join(grouped, keys).groupBy(*keys).applyInPandas(_searched(move), f"{TILE}, out {MESSAGE}"))
        here = done.select(*keys)
        tiles = tiles.join(F.broadcast(here) if size * 48 < BROADCAST else here, keys, "left_anti").unionByName(done.select(*names))
        n += 1
        tiles = cut(tiles) if n % KEPT_ROUNDS == 0 else tiles
        told = done.select("job", F.inline("out"))
        if goals is not None:
            dearest = costs_at(tiles, goals, move).agg(F.max("cost")).first()[0]
            told = told if dearest is None else told.where(F.col("cost") <= dearest)
        told = cut(told)
    return tiles


def costs(tiles: DataFrame, move: Movement) -> DataFrame:
    """(job, r, c, cost) of each cell with data; infinity if there is no way."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        t = _Tile(part.iloc[0], move)
        p = np.flatnonzero(t.own() & ~np.isnan(t.z).ravel())
        return pd.DataFrame({"job": part.iloc[0]["job"], "r": t.r0 + p // t.shape[1], "c": t.c0 + p % t.shape[1], "cost": t.g[p]})

    return tiles.groupBy("job", "tr", "tc").applyInPandas(run, "job long, r long, c long, cost double")


def costs_at(tiles: DataFrame, places: DataFrame, move: Movement) -> DataFrame:
    """(job, r, c, cost) at some places (job, r, c) only; those without data are left out."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        t = _Tile(part.iloc[0], move)
        at = [(m["r"], m["c"]) for m in part.iloc[0]["asked"]]
        inside = [(r, c) for r, c in at if 0 <= r - t.r0 < t.shape[0] and 0 <= c - t.c0 < t.shape[1]]
        return pd.DataFrame([(part.iloc[0]["job"], r, c, t.g[t.place(r, c)]) for r, c in inside if not math.isnan(t.z[r - t.r0, c - t.c0])], columns=["job", "r", "c", "cost"])

    asked = places.withColumns(move.tiles(F.col("r"), F.col("c"))).groupBy("job", "tr", "tc").agg(F.collect_list(F.struct("r", "c")).alias("asked"))
    return tiles.join(asked, ["job", "tr", "tc"]).groupBy("job", "tr", "tc").applyInPandas(run, "job long, r long, c long, cost double")


def accumulated_cost(cells: DataFrame, starts: DataFrame, cell: float, model: str = "tobler", mode: str = "time", reverse: bool = False, tile: int = 0, most: float = math.inf, **params) -> DataFrame:
    """(r, c, cost): the least cost from the starts (r, c) to each cell with data, infinity if there is no way or it costs more than ``most``;
    ``reverse``: from each cell to the starts. ``cells`` may have a friction column. Without ``tile`` tiles are fitted to the raster."""
    move = Movement(cell, model, mode, reverse, tile or WIDTH, params, most=most)
    move = move if tile else fitted(cells, move)
    return costs(spread(tiles_of(cells, move), starts, move), move).select("r", "c", "cost")


def _traced(move: Movement):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        row = part.iloc[0]
        t = _Tile(row, move)
        back = [(i * t.shape[1] + j, cost.ravel()) for i, j, cost in t.steps()]
        g, own, out = t.g, t.own(), []
        for m in row["told"]:
            if not (0 <= m["r"] - t.r0 < t.shape[0] and 0 <= m["c"] - t.c0 < t.shape[1]):
                continue
            p = t.place(m["r"], m["c"])
            while own[p] and g[p] < math.inf:
                out.append((row["job"], m["path"], t.r0 + p // t.shape[1], t.c0 + p % t.shape[1], g[p], False))
                if not g[p]:
                    break
                p = min((g[p - q] + cost[p], p - q) for q, cost in back if 0 <= p - q < len(g) and g[p - q] < g[p])[1]
            else:
                if g[p] < math.inf:
                    out.append((row["job"], m["path"], t.r0 + p // t.shape[1], t.c0 + p % t.shape[1], g[p], True))
        return pd.DataFrame(out, columns=["job", "path", "r", "c", "cost", "left"])

    return run


def paths(tiles: DataFrame, targets: DataFrame, move: Movement) -> DataFrame:
    """(path, seq, r, c, cost): the cells of the least-cost way from a start to each target (path, r, c, and job if there are several
    searches), in order; a target that cannot be reached has none. ``tiles`` are those of spread().

    Each round follows every way back to the edge of its tile and hands it on to the next one.
    """
    told = targets.select((F.col("job") if "job" in targets.columns else F.lit(0)).cast("long").alias("job"), *[F.col(k).cast("long").alias(k) for k in ("path", "r", "c")])
    told = cut(told)
    keys, out = ["job", "tr", "tc"], None
    while (size := told.count()):
        at = told.withColumns(move.tiles(F.col("r"), F.col("c")))
        grouped = at.groupBy(*keys).agg(F.collect_list(F.struct("path", "r", "c")).alias("told"))
        grouped = F.broadcast(grouped) if size * 48 < BROADCAST else grouped
        done = cut(tiles.join(grouped, keys).groupBy(*keys).applyInPandas(_traced(move), "job long, path long, r long, c long, cost double, left boolean"))
        found = done.where("NOT left").select("job", "path", "r", "c", "cost")
        out = found if out is None else out.unionAll(found)
        told = cut(done.where("left").select("job", "path", "r", "c"))
    if out is None:
        return targets.selectExpr("CAST(path AS LONG) AS path", "0 AS seq", "CAST(r AS LONG) AS r", "CAST(c AS LONG) AS c", "0.0D AS cost").limit(0)
    return out.selectExpr("path", "CAST(row_number() OVER (PARTITION BY job, path ORDER BY cost, r, c) - 1 AS INT) AS seq", "r", "c", "cost")


def corridor(there: DataFrame, back: DataFrame, over_pct: float = 5.0) -> DataFrame:
    """(r, c, total): the cells on ways that cost at most ``over_pct`` percent more than the best; with 0 the best ways themselves."""
    both = cut(there.join(back.withColumnRenamed("cost", "rest"), ["r", "c"]).withColumn("total", F.col("cost") + F.col("rest")).where(F.col("total") < math.inf))
    best = both.agg(F.min("total").alias("best"))
    return both.crossJoin(F.broadcast(best)).where(F.col("total") <= F.col("best") * (1 + over_pct / 100) + 1e-9).select("r", "c", "cost", "total")


def corridor_between(cells: DataFrame, start: DataFrame, goal: DataFrame, cell: float, over_pct: float = 5.0, model: str = "tobler", mode: str = "time", **params) -> DataFrame:
    """corridor() from a start to a goal (r, c): both searches end at the most that a cell of it can cost, so the rest of the raster is not searched."""
    move = fitted(cells, Movement(cell, model, mode, params=params))
    tiles = tiles_of(cells, move)
    goals = goal.select(F.lit(0).cast("long").alias("job"), *[F.col(k).cast("long").alias(k) for k in "rc"]).distinct()
    best = costs_at(spread(tiles, start, move, goal), goals, move).agg(F.min("cost")).first()[0]
    move = replace(move, most=math.inf if best is None else best * (1 + over_pct / 100) + 1e-6)
    there, back = (costs(spread(tiles, at, m), m).where(F.col("cost") < math.inf).select("r", "c", "cost") for at, m in ((start, move), (goal, replace(move, reverse=True))))
    return corridor(there, back, over_pct)
