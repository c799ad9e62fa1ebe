"""Straight-line costs, what sites and rings see, and least-cost networks between sites."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.movement import JOULES_PER_KCAL, SECONDS_PER_MINUTE, step_cost
from ..lineage import cut
from .cost import Movement, _Tile, costs_at, spread, tiles_of
from .graph import nearest, spanning_tree, undirected, within
from .surfaces import in_sight, sight_lines

#: Width of the squares, in cells, by which cells and boxes meet.
SQUARE = 64
#: Cells along a side of the boxes that are searched whole in a task, and boxes of one square that share a copy of its cells.
NEAR, TOGETHER = 256, 64


def straight_cost(pairs: DataFrame, cells: DataFrame, cell: float, step: float, model: str = "tobler", least: int = 1, **params) -> DataFrame:
    """(a, b, cost) along the straight line of each pair (a, b, ra, ca, rb, cb); null if any sample has no data."""
    lines = sight_lines(pairs, cells, cell, step, least, 1_000_000)
    w = Window.partitionBy("a", "b").orderBy("i")
    steps = lines.select("a", "b", "i", "z", (F.col("d") - F.lag("d").over(w)).alias("h"), (F.col("z") - F.lag("z").over(w)).alias("climb"))
    cost = F.sum(F.when(F.col("i") > 0, step_cost(model, F.col("h"), F.col("climb"), **params)))
    return steps.groupBy("a", "b").agg(F.when(F.count("z") == F.count("*"), cost).alias("cost"))


def ring_visibility(observers: DataFrame, cells: DataFrame, cell: float, radius: float, interval: float, height: float = 1.6, target: float = 0.0) -> DataFrame:
    """(a, b, visible) of the points b = 0, 1, ... on a circle round each observer (obs, r, c), with ten samples to each."""
    n = max(8, int(2 * math.pi * radius / interval))
    turn = F.col("b") * (2 * math.pi / n)
    ring = observers.select(F.col("obs").alias("a"), F.col("r").alias("ra"), F.col("c").alias("ca"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))
    ring = ring.withColumns({"rb": F.floor(F.col("ra") - F.cos(turn) * radius / cell + 0.5), "cb": F.floor(F.col("ca") + F.sin(turn) * radius / cell + 0.5)})
    return in_sight(sight_lines(ring, cells, cell, cell, 10, 10), height, target)


BOX = ["r", "c", "r0", "r1", "c0", "c1"]


def _inside(boxes: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, c, z) of the cells in each box (keys, r0, r1, c0, c1); they meet on squares."""
    span = lambda k: F.explode(F.sequence(F.floor(F.col(f"{k}0") / SQUARE), F.floor(F.col(f"{k}1") / SQUARE)))
    filed = boxes.select(*keys, "r0", "r1", "c0", "c1", span("r").alias("qr")).select("*", span("c").alias("qc"))
    squares = cells.select("r", "c", "z", F.floor(F.col("r") / SQUARE).alias("qr"), F.floor(F.col("c") / SQUARE).alias("qc"))
    return filed.join(squares, ["qr", "qc"]).where("r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1").select(*keys, "r", "c", "z")


def _box_searches(moves: list[Movement]):
    """Kernel: the costs both ways between the place of each box (BOX, goals) of a group and its goals, over the cells (r, c, z) round them all."""

    def run(jobs: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(jobs["r0"].min()), int(jobs["c0"].min())
        z = np.full((int(jobs["r1"].max()) - r0 + 1, int(jobs["c1"].max()) - c0 + 1), np.nan)
        z[cells["r"].to_numpy() - r0, cells["c"].to_numpy() - c0] = cells["z"]
        out = []
        for job in jobs.itertuples():
            own = z[job.r0 - r0:job.r1 - r0 + 1, job.c0 - c0:job.c1 - c0 + 1]
            row = {"r0": job.r0, "c0": job.c0, "h": own.shape[0], "w": own.shape[1], "z": own.tobytes(), "f": b"", "g": np.full(own.shape, np.inf).tobytes()}
            ways = [_Tile(row, move) for move in moves]
            for t in ways:
                t.search([(t.place(job.r, job.c), 0.0)])
            out += [(*(getattr(job, k) for k in BOX), g["r"], g["c"], *(float(t.g[t.place(g["r"], g["c"])]) for t in ways)) for g in job.goals]
        return pd.DataFrame(out, columns=[*BOX, "rb", "cb", "forth", "back"])

    return run


def _near_costs(pairs: DataFrame, boxes: DataFrame, cells: DataFrame, moves: list[Movement]) -> DataFrame:
    """(a, b, forth, back) of the pairs whose boxes (job, BOX) have at most NEAR cells a side: sites with one place and box share a search, and boxes of one square share its cells."""
    own = pairs.join(boxes.withColumnRenamed("job", "a"), "a").select("a", "b", "rb", "cb", *BOX)
    jobs = own.groupBy(*BOX).agg(F.collect_set(F.struct(F.col("rb").alias("r"), F.col("cb").alias("c"))).alias("goals"))
    jobs = cut(jobs.withColumns({"sr": F.floor(F.col("r") / SQUARE), "sc": F.floor(F.col("c") / SQUARE)}))
    parts = jobs.groupBy("sr", "sc").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("n"))
    keys = ["sr", "sc", "part"]
    jobs = cut(jobs.join(parts, ["sr", "sc"]).withColumn("part", F.pmod(F.xxhash64(*BOX), F.col("n"))).drop("n"))
    own_keys = ["gr", "gc", "gpart"]  # names of their own, as both sides come from one table
    groups = jobs.groupBy(*[F.col(k).alias(g) for k, g in zip(keys, own_keys, strict=True)]).agg(*[f(k).alias(k) for k, f in (("r0", F.min), ("r1", F.max), ("c0", F.min), ("c1", F.max))])
    found = jobs.groupBy(*keys).cogroup(_inside(groups, cells, own_keys).groupBy(*own_keys)).applyInPandas(_box_searches(moves), ", ".join(f"{k} long" for k in (*BOX, "rb", "cb")) + ", forth double, back double")
    return own.join(cut(found), [*BOX, "rb", "cb"]).select("a", "b", "forth", "back")


def pair_costs(pairs: DataFrame, cells: DataFrame, cell: float, margin: int, model: str = "tobler", mode: str = "time", tile: int = 512, **params) -> DataFrame:
    """(a, b, forth, back): the least costs both ways between the ends of each pair (a, b, ra, ca, rb, cb), on ways that stay inside the box round ``a``
    and all its partners and ``margin`` cells; infinity if there is no way.

    Boxes of up to NEAR cells a side are searched in one task each, once for all sites of one place and box. A larger one is a search of its own, in tiles of the box.
    """
    pairs = cut(pairs.select(*[F.col(k).cast("long").alias(k) for k in ("a", "b", "ra", "ca", "rb", "cb")]))
    ends = [(f(g(f"{k}a", f"{k}b")) + side * margin).alias(f"{k}{n}") for k in "rc" for n, f, g, side in ((0, F.min, F.least, -1), (1, F.max, F.greatest, 1))]
    boxes = cut(pairs.groupBy(F.col("a").alias("job")).agg(F.first("ra").alias("r"), F.first("ca").alias("c"), *ends))
    cells = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "z")
    moves = [Movement(cell, model, mode, reverse, tile, params) for reverse in (False, True)]
    small = (F.col("r1") - F.col("r0") < NEAR) & (F.col("c1") - F.col("c0") < NEAR)
    near, far = _near_costs(pairs, boxes.where(small), cells, moves), cut(boxes.where(~small))
    if far.isEmpty():
        return near
    out = pairs.join(far.select(F.col("job").alias("a")), "a", "left_semi")
    tiles = tiles_of(_inside(far, cells, ["job"]), moves[0])
    asked = out.select(F.col("a").alias("job"), F.col("rb").alias("r"), F.col("cb").alias("c")).distinct()
    for name, move in zip(("forth", "back"), moves, strict=True):
        found = costs_at(spread(tiles, far.select("job", "r", "c"), move), asked, move)
        out = cut(out.join(found.select(F.col("job").alias("a"), F.col("r").alias("rb"), F.col("c").alias("cb"), F.col("cost").alias(name)), ["a", "rb", "cb"], "left"))
    return near.unionByName(out.select("a", "b", *[F.coalesce(k, F.lit(math.inf)).alias(k) for k in ("forth", "back")]))


def symmetric(costs: DataFrame, how: str = "avg") -> DataFrame:
    """(a, b, w): one cost for both ways (avg, min or max); without one of them there is no link."""
    both = {"avg": (F.col("forth") + F.col("back")) / 2, "min": F.least("forth", "back"), "max": F.greatest("forth", "back")}[how]
    return costs.where((F.col("forth") < math.inf) & (F.col("back") < math.inf)).select("a", "b", both.alias("w"))


def cheapest(costs: DataFrame, k: int) -> DataFrame:
    """(a, b): each site's k cheapest partners by the cost of going there, as links."""
    going = costs.select("a", "b", F.col("forth").alias("w")).unionAll(costs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("w"))).where(F.col("w") < math.inf)
    first = going.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("w", "b"))).where(F.col("n") <= k)
    return first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hub_edges(costs: DataFrame, hubs: DataFrame) -> DataFrame:
    """(a, b, kind): each other site's cheapest hub by the cost of going there (hub_link), and the least spanning tree of the hubs (hub_mst)."""
    marked = costs.join(hubs.select(F.col("id").alias("a"), F.lit(True).alias("ha")).distinct(), "a", "left").join(hubs.select(F.col("id").alias("b"), F.lit(True).alias("hb")).distinct(), "b", "left")
    one = marked.where("coalesce(ha, false) <> coalesce(hb, false)")
    going = one.select(F.when(F.col("ha"), F.col("b")).otherwise(F.col("a")).alias("site"), F.when(F.col("ha"), F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(F.col("ha"), F.col("back")).otherwise(F.col("forth")).alias("w")).where(F.col("w") < math.inf)
    best = going.groupBy("site").agg(F.min(F.struct("w", "hub")).alias("m"))
    links = best.select(F.least("site", "m.hub").alias("a"), F.greatest("site", "m.hub").alias("b"), F.lit("hub_link").alias("kind")).distinct()
    tree = spanning_tree(symmetric(marked.where("ha AND hb").select("a", "b", "forth", "back")), "w")
    return links.unionAll(tree.select("a", "b", F.lit("hub_mst").alias("kind")))


def network(costs: DataFrame, k: int = 3, hubs: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    """(a, b, kind): the links of the least spanning tree (mst), of the k cheapest partners (knn) and, with ``hubs`` (id), of hub_edges(); a link can be of several kinds.

    With ``sites`` (id) the tree has to join all of them; it is an error if it does not.
    """
    tree = cut(spanning_tree(symmetric(costs), "w").select("a", "b", F.lit("mst").alias("kind")))
    if sites is not None and tree.count() + 1 < sites.select("id").distinct().count():
        raise ValueError("the sites are not joined: some cannot be reached from others")
    out = tree.unionAll(cheapest(costs, k).select("a", "b", F.lit("knn").alias("kind")))
    return out if hubs is None else out.unionAll(hub_edges(costs, hubs))


def edge_table(edges: DataFrame, costs: DataFrame, sites: DataFrame, model: str, cell: float, how: str = "avg") -> DataFrame:
    """The links with names, straight distance and minutes: kind, from_id, to_id, from_nm, to_nm, dist_m, time_ab, time_ba, time_sym, model."""
    end = lambda k, p: sites.select(F.col("id").alias(k), F.coalesce(F.col("name"), F.col("id").cast("string")).alias(f"{p}_nm"), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    timed = edges.join(costs, ["a", "b"]).join(symmetric(costs, how), ["a", "b"], "left").join(end("a", "from"), "a").join(end("b", "to"), "b")
    minutes = lambda k: F.when(F.col(k) < math.inf, F.col(k) / SECONDS_PER_MINUTE)
    dx, dy = (F.col(f"a{v}") - F.col(f"b{v}") for v in "xy")
    return timed.select("kind", F.col("a").alias("from_id"), F.col("b").alias("to_id"), "from_nm", "to_nm", (F.sqrt(dx * dx + dy * dy) * cell).alias("dist_m"),
                        minutes("forth").alias("time_ab"), minutes("back").alias("time_ba"), minutes("w").alias("time_sym"), F.lit(model).alias("model"))


def weights_of(edges: DataFrame) -> DataFrame:
    """(a, b, w): one weight a link for network measures: its time, or else its length, or else 1; the least of repeated links."""
    w = F.coalesce(F.when(F.col("time_sym") > 0, F.col("time_sym")), F.when(F.col("dist_m") > 0, F.col("dist_m")), F.lit(1.0))
    return edges.groupBy(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).agg(F.min(w).alias("w"))


def along(t: DataFrame, keys: list[str], order: str, cell: float, model: str = "tobler", **params) -> DataFrame:
    """``t`` (r, c, z in order) with dist_m, time_min and energy_kcal (Pandolf's) so far."""
    w = Window.partitionBy(*keys).orderBy(order)
    dr, dc = (F.col(k) - F.lag(k).over(w) for k in "rc")
    steps = t.withColumns({"__h": F.sqrt(dr * dr + dc * dc) * cell, "__dz": F.col("z") - F.lag("z").over(w)})
    so_far = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    time, energy = step_cost(model, F.col("__h"), F.col("__dz"), **params), step_cost("pandolf", F.col("__h"), F.col("__dz"), "energy")
    steps = steps.withColumns({"__t": time, "__e": energy})
    return steps.withColumns({"dist_m": so_far("__h"), "time_min": so_far("__t") / SECONDS_PER_MINUTE, "energy_kcal": so_far("__e") / JOULES_PER_KCAL}).drop("__h", "__dz", "__t", "__e")


def visibility_links(sites: DataFrame, cells: DataFrame, cell: float, k: int = 10, most: float = 2500.0, observer: float = 1.6, target: float = 0.0) -> DataFrame:
    """(from_id, to_id, dist_m, vis_ab, vis_ba, status): whether sites (id, x, y in cells) see each other, among the ``k`` nearest within ``most`` metres (all of these if ``k`` is 0)."""
    near = within(sites, most / cell) if not k else undirected(nearest(sites, sites, k, same=True, most=most / cell))
    near = cut(near.select("a", "b"))
    end = lambda k: sites.select(F.col("id").alias(k), F.col("y").alias(f"r{k}"), F.col("x").alias(f"c{k}"))
    both = near.unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lines = cut(sight_lines(both.join(end("a"), "a").join(end("b"), "b"), cells, cell, cell))
    seen = in_sight(lines, observer, target).join(lines.groupBy("a", "b").agg(F.max("d").alias("dist_m")), ["a", "b"])
    seen = cut(seen)
    there = seen.where("a < b")
    back = seen.where("a > b").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("visible").alias("back"))
    status = F.when(F.col("visible").isNull() | F.col("back").isNull(), "no data").when(F.col("visible") & F.col("back"), "mutual").when(F.col("visible") | F.col("back"), "one way").otherwise("hidden")
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    return there.join(back, ["a", "b"]).select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), "dist_m", flag("visible").alias("vis_ab"), flag("back").alias("vis_ba"), status.alias("status"))


def visibility_degrees(links: DataFrame) -> DataFrame:
    """(id, out_deg, in_deg, vis_total, mutual) of visibility_links()."""
    sides = links.select(F.inline(F.array(F.struct(F.col("from_id").alias("id"), F.col("vis_ab").alias("o"), F.col("vis_ba").alias("i")), F.struct(F.col("to_id").alias("id"), F.col("vis_ba").alias("o"), F.col("vis_ab").alias("i")))))
    return sides.groupBy("id").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg"), F.sum(F.col("o") + F.col("i")).alias("vis_total"), F.sum(F.col("o") * F.col("i")).alias("mutual"))
