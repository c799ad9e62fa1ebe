"""Searches that end where their result does, and tiles that fit the raster, on small rasters."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from holloway.operators import cost, routes


def raster(spark, h, w, seed=3):
    z = np.random.default_rng(seed).normal(0, 6, (h, w))
    z[h // 3, : w // 2] = np.nan  # a wall
    rows = [(r, c, float(v)) for (r, c), v in np.ndenumerate(z) if not math.isnan(v)]
    return z, spark.createDataFrame(rows, "r long, c long, z double").repartition(3)


def place(spark, r, c):
    return spark.createDataFrame([(r, c)], "r long, c long")


def dijkstra(z, start, cell=10.0, reverse=False):
    g, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, (r, c) = heapq.heappop(heap)
        if d > g[r, c]:
            continue
        for i, j in cost._MOVES:
            q = (r + i, c + j)
            if 0 <= q[0] < z.shape[0] and 0 <= q[1] < z.shape[1] and not math.isnan(z[q]):
                climb = (z[q] - z[r, c]) * (-1 if reverse else 1)
                new = d + float(cost.step_costs("tobler", cell * math.hypot(i, j), np.array(climb)))
                if new < g.get(q, math.inf):
                    g[q] = new
                    heapq.heappush(heap, (new, q))
    return g


@pytest.mark.parametrize("apart", [1, 32])
def test_fitted_tiles_are_high_and_give_the_same_costs(spark, monkeypatch, apart):
    monkeypatch.setattr(cost, "CELLS", 200)
    monkeypatch.setattr(cost, "APART", apart)
    z, cells = raster(spark, 90, 8)
    move = cost.fitted(cells, cost.Movement(10.0, tile=6))
    assert (move.rows, move.tile) == (33, 6)
    tiles = cost.tiles_of(cells, move)
    assert tiles.where("tr >= 0 AND tc >= 0").count() == 6
    got = {(x.r, x.c): x.cost for x in cost.costs(cost.spread(tiles, place(spark, 2, 2), move), move).collect()}
    want = dijkstra(z, (2, 2))
    assert got == {(r, c): want.get((r, c), math.inf) for (r, c), v in np.ndenumerate(z) if not math.isnan(v)}


def test_costs_over_the_limit_are_not_searched(spark):
    z, cells = raster(spark, 60, 9)
    want = dijkstra(z, (1, 1))
    most = sorted(want.values())[len(want) // 4]
    got = {(x.r, x.c): x.cost for x in cost.accumulated_cost(cells, place(spark, 1, 1), 10.0, tile=7, most=most).where(F.col("cost") < math.inf).collect()}
    assert got == {k: v for k, v in want.items() if v <= most}


def test_a_search_for_targets_ends_near_them(spark):
    z, cells = raster(spark, 120, 9)
    move, far = cost.Movement(10.0, tile=8), dijkstra(z, (1, 1))
    targets = spark.createDataFrame([(0, 9, 7), (1, 3, 0)], "path long, r long, c long")
    whole = cost.spread(cost.tiles_of(cells, move), place(spark, 1, 1), move)
    tiles = cost.spread(cost.tiles_of(cells, move), place(spark, 1, 1), move, targets)
    assert max(x.r for x in cost.costs(tiles, move).where(F.col("cost") < math.inf).collect()) < 40
    rows = lambda t: sorted(map(tuple, cost.paths(t, targets, move).collect()))
    assert rows(tiles) == rows(whole) and rows(tiles)[-1][-1] in (far[9, 7], far[3, 0])


def test_a_corridor_searches_only_its_surroundings(spark):
    z, cells = raster(spark, 120, 9)
    start, goal = place(spark, 1, 1), place(spark, 8, 7)
    there, back = (cost.accumulated_cost(cells, at, 10.0, reverse=reverse, tile=8) for at, reverse in ((start, False), (goal, True)))
    want = sorted(map(tuple, cost.corridor(there, back, 20.0).collect()))
    assert sorted(map(tuple, cost.corridor_between(cells, start, goal, 10.0, 20.0).collect())) == want and len(want) > 9


def test_sites_of_one_place_and_box_share_a_search(spark, monkeypatch):
    z, cells = raster(spark, 24, 20)
    ends = [(1, 2, 5, 5, 9, 12), (1, 3, 5, 5, 4, 4), (4, 5, 5, 5, 9, 12), (4, 6, 5, 5, 4, 4), (7, 8, 20, 3, 2, 19), (9, 2, 8, 2, 9, 12)]
    pairs = spark.createDataFrame(ends, "a long, b long, ra long, ca long, rb long, cb long")
    monkeypatch.setattr(routes, "NEAR", 1)  # every box is a search of its own
    want = sorted(map(tuple, routes.pair_costs(pairs, cells, 10.0, 2).collect()))
    seen, real = [], routes._inside
    monkeypatch.setattr(routes, "NEAR", 256)
    monkeypatch.setattr(routes, "tiles_of", None)  # must not be needed
    monkeypatch.setattr(routes, "_inside", lambda b, *a: seen.append(b.count()) or real(b, *a))
    assert sorted(map(tuple, routes.pair_costs(pairs, cells, 10.0, 2).collect())) == want and len(want) == 6
    assert seen == [1] and any(w[2] < math.inf for w in want)
