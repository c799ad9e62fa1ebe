"""Operators that SQL cannot check, against brute force and known answers."""

import heapq
import math
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from holloway.functions.movement import TIME, step_cost
from holloway.operators import cost, graph, profile, raster, routes, surfaces
from holloway.operators.components import components


def raster_of(spark, z):
    return spark.createDataFrame([(r, c, None if math.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])], "r long, c long, z double")


@pytest.mark.parametrize("cell", [1.0, 2.5])
def test_curvature(spark, cell):
    y, x = np.mgrid[0:9, 0:9] * cell
    surfaces_ = {"plane": (2 * x + y, 0, 0), "valley": (0.5 * x**2 + 0 * y, 1, 0), "bowl": (0.5 * (x - 4.1 * cell) ** 2 + 0.5 * (y - 4.1 * cell) ** 2, 1, -1), "flat": (0 * x, 0, 0)}
    for z, profile_, plan in surfaces_.values():
        rows = raster.neighbourhood(raster_of(spark, z)).select("r", "c", *[v.alias(k) for k, v in raster.curvature(cell).items()]).dropna().collect()
        inside = [r for r in rows if not (profile_ and r.c == 0)]
        assert len(rows) == 49
        assert all(abs(abs(r.profile) - abs(profile_)) < 1e-9 and abs(abs(r.plan) - abs(plan)) < 1e-9 for r in inside if r.profile or r.plan)


def test_nodata_spreads_to_neighbours(spark):
    z = np.arange(25.0).reshape(5, 5)
    z[2, 2] = np.nan
    assert raster.neighbourhood(raster_of(spark, z)).select(raster.slope(1.0).alias("s")).where("s IS NOT NULL").count() == 0


def test_contours_lie_on_the_level(spark):
    z = np.array([[math.sin(i * 0.7) * 10 + j for j in range(12)] for i in range(12)])
    for s in raster.marching_squares(raster_of(spark, z), [3.0, 6.5]).collect():
        for px, py in ((s.x1, s.y1), (s.x2, s.y2)):
            i, j = int(py), int(px)
            v, u = py - i, px - j
            at = (1 - v) * (1 - u) * z[i, j] + (v and v * (1 - u) * z[min(i + 1, 11), j]) + (u and (1 - v) * u * z[i, min(j + 1, 11)])
            assert at == pytest.approx(s.level)


GRAPHS = {
    "path": (3, [(0, 1), (1, 2)], [2 / 3, 1, 2 / 3], [0, 1, 0]), "star": (4, [(0, 1), (0, 2), (0, 3)], [1, 0.6, 0.6, 0.6], [3, 0, 0, 0]), "triangle": (3, [(0, 1), (0, 2), (1, 2)], [1, 1, 1], [0, 0, 0]),
    "parts": (5, [(0, 1), (2, 3), (2, 4), (3, 4)], [0.25, 0.25, 0.5, 0.5, 0.5], [0] * 5),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_centrality(spark, name):
    n, links, close, between = GRAPHS[name]
    t = spark.createDataFrame(links, "a long, b long").withColumn("w", F.lit(1.0))
    for weight in (None, "w"):
        rows = sorted(graph.centrality(t, spark.range(n), weight).collect())
        assert [r.closeness for r in rows] == pytest.approx(close) and [r.betweenness for r in rows] == pytest.approx(between)


def test_weights_divert(spark):
    t = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0)], "a long, b long, w double")
    assert [r.betweenness for r in sorted(graph.centrality(t, spark.range(3), "w").collect())] == [0, 1, 0]
    t = spark.createDataFrame([(0, 1, 0.0), (0, 2, -3.0)], "a long, b long, w double")
    assert all(r.closeness == 0 for r in graph.centrality(t, spark.range(3), "w").collect())


def test_centrality_by_joins_equals_that_of_tasks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    links = sorted({tuple(sorted(map(int, rng.integers(0, 25, 2)))) for _ in range(45)})
    t = spark.createDataFrame([(a, b, float(rng.integers(1, 4))) for a, b in links if a != b], "a long, b long, w double")
    for weight in (None, "w"):
        want = sorted(graph.centrality(t, spark.range(27), weight).collect())
        monkeypatch.setattr(graph, "SENT", 5)
        monkeypatch.setattr(graph, "SEARCH_ROWS", 27 * 14)
        got = sorted(graph.centrality(t, spark.range(27), weight).collect())
        monkeypatch.undo()
        assert [r.id for r in got] == [r.id for r in want] and sum(r.betweenness for r in want) > 0
        for k in ("closeness", "betweenness"):
            assert [r[k] for r in got] == pytest.approx([r[k] for r in want])


def random_sites(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, 60, (n, 2)))] + [(n, 5000, 5000)]
    return rows, spark.createDataFrame(rows, "id long, x long, y long")


def test_nearest(spark):
    rows, t = random_sites(spark, 120, 1)
    got = {(r.a, r.b): r.d2 for r in graph.nearest(t, t, 3, same=True).collect()}
    for i, x, y in rows:
        best = sorted(((x - p) ** 2 + (y - q) ** 2, j) for j, p, q in rows if j != i)[:3]
        assert sorted((d, j) for (a, j), d in got.items() if a == i) == best


@pytest.mark.parametrize("few", [100_000, 0])
def test_spanning_tree_and_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_LINKS", few)
    if few:  # the rounds of components()
        monkeypatch.setattr(sys.modules["holloway.operators.components"], "LINKS_A_TASK", 15)
    rows, t = random_sites(spark, 40, 2)
    links = sorted(((x - p) ** 2 + (y - q) ** 2, i, j) for i, x, y in rows for j, p, q in rows if i < j and (x - p) ** 2 + (y - q) ** 2 <= 100)
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    want = []
    for d, i, j in links:
        if find(i) != find(j):
            root[max(find(i), find(j))] = min(find(i), find(j))
            want.append((i, j, d))
    table = graph.within(t, 10)
    assert sorted(map(tuple, graph.spanning_tree(table).collect())) == sorted(want)
    if few:
        assert {r.node: r.root for r in components(table).collect()} == {v: find(v) for e in links for v in e[1:]}


def tobler(length, climb):
    return length / max(0.05, 6.0 * math.exp(-3.5 * abs(climb / length + 0.05)) / 3.6)


@pytest.mark.parametrize("model, mode", [*((m, "time") for m in (*TIME, "unknown")), ("pandolf", "energy")])
def test_step_costs_equal_the_columns(spark, model, mode):
    dz = np.array([-60.0, -8.0, -0.5, 0.0, 0.3, 5.0, 12.0, 70.0])
    t = spark.createDataFrame([(float(x),) for x in dz], "dz double")
    want = [r[0] for r in t.select(step_cost(model, F.lit(30.0), F.col("dz"), mode)).collect()]
    assert list(cost.step_costs(model, 30.0, dz, mode)) == pytest.approx(want)


def test_paths_over_tiles(spark):
    z = np.random.default_rng(9).normal(0, 6, (30, 26))
    cells, move = raster_of(spark, z), cost.Movement(10.0, tile=7)
    start = spark.createDataFrame([(2, 3)], "r long, c long")
    tiles = cost.spread(cost.tiles_of(cells, move), start, move)
    by = {(r.r, r.c): r.cost for r in cost.costs(tiles, move).collect()}
    targets = spark.createDataFrame([(1, 28, 25), (2, 0, 0), (3, 29, 1)], "path long, r long, c long")
    rows = sorted(cost.paths(tiles, targets, move).collect())
    for path, end in ((1, (28, 25)), (2, (0, 0)), (3, (29, 1))):
        way = [(r.r, r.c) for r in rows if r.path == path]
        assert way[0] == (2, 3) and way[-1] == end and [r.seq for r in rows if r.path == path] == list(range(len(way)))
        spent = 0.0
        for (i, j), (k, m) in zip(way, way[1:]):
            assert max(abs(i - k), abs(j - m)) == 1
            spent += tobler(10.0 * math.hypot(i - k, j - m), z[k, m] - z[i, j])
            assert by[k, m] == pytest.approx(spent)


def test_several_searches_side_by_side(spark):
    z = np.random.default_rng(10).normal(0, 6, (12, 12))
    cells = raster_of(spark, z)
    both = cells.withColumn("job", F.explode(F.array(F.lit(4), F.lit(9)))).where("job = 4 OR c < 8")
    move = cost.Movement(10.0, tile=5)
    starts = spark.createDataFrame([(4, 0, 0), (9, 6, 6)], "job long, r long, c long")
    got = {(r.job, r.r, r.c): r.cost for r in cost.costs(cost.spread(cost.tiles_of(both, move), starts, move), move).collect()}
    for job, start, part in ((4, (0, 0), cells), (9, (6, 6), cells.where("c < 8"))):
        want = {(job, r.r, r.c): r.cost for r in cost.accumulated_cost(part, spark.createDataFrame([start], "r long, c long"), 10.0).collect()}
        assert {k: v for k, v in got.items() if k[0] == job} == pytest.approx(want)


def test_accumulated_cost(spark):
    z = np.random.default_rng(4).normal(0, 8, (23, 31))
    z[5:20, 12] = np.nan
    cells = raster_of(spark, z)
    start = spark.createDataFrame([(3, 4)], "r long, c long")
    for reverse in (False, True):
        got = {(r.r, r.c): r.cost for r in cost.accumulated_cost(cells, start, 10.0, reverse=reverse, tile=8).collect()}
        want, heap = {}, [(0.0, 3, 4)]
        while heap:
            d, i, j = heapq.heappop(heap)
            if (i, j) in want:
                continue
            want[i, j] = d
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    k, m = i + a, j + b
                    if (a or b) and 0 <= k < 23 and 0 <= m < 31 and not math.isnan(z[k, m]):
                        climb = z[k, m] - z[i, j]
                        heapq.heappush(heap, (d + tobler(10.0 * math.hypot(a, b), -climb if reverse else climb), k, m))
        for p, d in got.items():
            assert d == pytest.approx(want.get(p, math.inf))


def test_corridor(spark):
    cells = raster_of(spark, np.zeros((5, 9)))
    place = lambda r, c: spark.createDataFrame([(r, c)], "r long, c long")
    there, back = cost.accumulated_cost(cells, place(2, 0), 10.0), cost.accumulated_cost(cells, place(2, 8), 10.0, reverse=True)
    assert [(r.r, r.c) for r in cost.corridor(there, back, 0.0).orderBy("cost").collect()] == [(2, c) for c in range(9)]
    assert cost.corridor(there, back, 30.0).count() > 9


def test_contour_lines(spark):
    y, x = np.mgrid[0:21, 0:21]
    z = np.minimum((x - 5.0) ** 2 + (y - 5.3) ** 2, (x - 15.2) ** 2 + (y - 14.0) ** 2)
    rows = raster.contour_lines(raster.marching_squares(raster_of(spark, z), [9.5, 400.0])).collect()
    lines = {r.line: r for r in rows}
    assert len(lines) == 2 and all(r.closed for r in rows)
    assert all(r.length == pytest.approx(2 * math.pi * 9.5**0.5, rel=0.03) for r in rows)
    slope = raster.contour_lines(raster.marching_squares(raster_of(spark, x * 1.0), [3.5, 7.5])).collect()
    assert len({r.line for r in slope}) == 2 and not any(r.closed for r in slope) and {r.length for r in slope} == {20.0}


def test_kriging(spark):
    rng = np.random.default_rng(5)
    pts = [(i, float(x), float(y), float(v)) for i, (x, y, v) in enumerate(rng.uniform(0, 100, (60, 3)))]
    points, targets = spark.createDataFrame(pts, "id long, x double, y double, z double"), spark.createDataFrame([(0, 50.0, 50.0), (1, 3.0, 97.0)], "id long, x double, y double")
    nugget, sill, reach = 0.5, 9.5, 30.0
    for r in surfaces.kriging(targets, points, 8, (nugget, sill, reach)).collect():
        tx, ty = ((50.0, 50.0), (3.0, 97.0))[r.id]
        near = sorted(pts, key=lambda p: (p[1] - tx) ** 2 + (p[2] - ty) ** 2)[:8]
        x, y, z = (np.array([p[k] for p in near]) for k in (1, 2, 3))
        m = np.ones((9, 9))
        m[:8, :8] = sill * np.exp(-np.hypot(x[:, None] - x, y[:, None] - y) / reach) + nugget * np.eye(8)
        m[8, 8] = 0
        b = np.r_[sill * np.exp(-np.hypot(x - tx, y - ty) / reach), 1]
        w = np.linalg.inv(m) @ b
        assert r.z == pytest.approx(w[:8] @ z) and r.variance == pytest.approx(max(0, sill + nugget - w @ b))


def test_ranges_and_thinning(spark):
    t = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.4, 2.0), (1, 2.6, 3.0), (1, 0.1, 0.2)], "k long, start double, stop double")
    assert sorted(map(tuple, profile.merged_ranges(t, ["k"]).select("start", "stop", "parts").collect())) == [(0.0, 2.0, 3), (2.6, 3.0, 1)]
    assert spark.range(1).select(profile.thinned(F.array(*map(F.lit, (3.0, 1.0, 1.4, 1.6, 1.9))))).first()[0] == [1.0, 1.6, 3.0]
    assert [r.id for r in profile.evenly(spark.range(11), "id", 3).collect()] == [0, 5, 10]


def test_fill(spark):
    z = np.full((5, 5), 4.0)
    z[2, 2] = np.nan
    assert raster.fill(raster_of(spark, z), 1).where("r = 2 AND c = 2").first().z == pytest.approx(4.0)


def test_pair_costs(spark):
    z = np.random.default_rng(6).normal(0, 5, (20, 20))
    cells = raster_of(spark, z)
    ends = [(0, 1, 2, 2, 15, 12), (1, 2, 15, 12, 3, 17)]
    got = {(r.a, r.b): (r.forth, r.back) for r in routes.pair_costs(spark.createDataFrame(ends, "a long, b long, ra long, ca long, rb long, cb long"), cells, 10.0, 30).collect()}
    for a, b, ra, ca, rb, cb in ends:
        start = spark.createDataFrame([(ra, ca)], "r long, c long")
        for k, reverse in enumerate((False, True)):
            want = cost.accumulated_cost(cells, start, 10.0, reverse=reverse).where((F.col("r") == rb) & (F.col("c") == cb)).first().cost
            assert got[a, b][k] == pytest.approx(want)
    costs = spark.createDataFrame([(1, 2, 5.0, 7.0), (2, 3, 1.0, 1.0), (1, 3, 2.0, 2.0), (3, 4, math.inf, 1.0)], "a long, b long, forth double, back double")
    assert sorted(map(tuple, routes.network(costs, 1).collect())) == [(1, 3, "knn"), (1, 3, "mst"), (2, 3, "knn"), (2, 3, "mst"), (3, 4, "knn")]
