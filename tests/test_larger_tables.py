"""Steps that have to stay within their limits on large tables, seen on small ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from holloway import catalog
from holloway.operators import decision, graph, overlays, vector
from holloway.operators.components import components
from holloway.plans import records, views
from holloway.sources import layers
from holloway.sources.grid import Grid
from tests.test_places_of_scale import same_as_sql


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["zonal_stats", "zonal_class_pivot", "aoi_visible_rollup"])
def test_cells_of_zones_are_not_broadcast(spark, sf, name):
    found = plan(catalog.QUERIES[name](spark, sf))
    assert "SortMergeJoin" in found and "Broadcast" not in found


@pytest.mark.parametrize("corners", [True, False])
def test_only_cells_along_block_borders_link_areas(spark, monkeypatch, corners):
    rng, seen = np.random.default_rng(8), []
    kind = {(r, c): int(k) for (r, c), k in np.ndenumerate(rng.integers(0, 3, (21, 18)))}
    cells = spark.createDataFrame([(r, c, k or None) for (r, c), k in kind.items()], "r long, c long, class int")
    monkeypatch.setattr(vector, "REGION_BLOCK", 5, raising=False)
    monkeypatch.setattr(vector, "components", lambda links: seen.append(links.count()) or components(links))
    got = {(x.r, x.c): x.region for x in vector.labelled_regions(cells, 18, corners).collect()}
    want = {}
    for start in sorted(k for k in kind if kind[k]):
        todo = [] if start in want else [start]
        while todo:
            r, c = here = todo.pop()
            if here not in want:
                want[here] = start[0] * 18 + start[1]
                near = [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (corners or not i * j)]
                todo += [n for n in near if kind.get(n) == kind[here]]
    ways = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if corners else [])
    assert got == want and seen[0] < sum(kind.get((r + i, c + j)) == k > 0 for (r, c), k in kind.items() for i, j in ways) / 2


@pytest.mark.parametrize("weight", [None, "w"])
def test_centrality_searches_once_from_sites_of_one_place(spark, monkeypatch, weight):
    rng = np.random.default_rng(3)
    places = [(0, 0), (1, 0), (2, 0), (2, 1), (4, 0), (5, 2), (9, 9)]
    at = places + [places[k] for k in (1, 1, 3, 4, 6)] + [(2, 3)]
    ids = [int(k) for k in rng.permutation(len(at))]
    sites = spark.createDataFrame([(i, *p) for i, p in zip(ids, at, strict=True)], "id long, x long, y long")
    links = graph.within(sites, 2.5).withColumn("w", F.sqrt("d2"))
    monkeypatch.setattr(graph, "SENT", 1)
    want = {r.id: r for r in graph.centrality(links, sites, weight).collect()}
    monkeypatch.setattr(graph, "SENT", links.where("d2 > 0").count() - 1)
    monkeypatch.setattr(graph, "_searches", None)  # must not be needed
    got = {r.id: r for r in graph.centrality(links, sites, weight).collect()}
    assert got.keys() == want.keys() == set(ids)
    for k, r in got.items():
        assert (r.closeness, r.betweenness) == pytest.approx((want[k].closeness, want[k].betweenness), abs=1e-9)


def test_views_from_one_place_are_taken_once(spark, sf, tmp_path, monkeypatch):
    whole, taken, real = catalog.QUERIES["higuchi_zones"], [], views.surfaces.viewsheds
    monkeypatch.setattr(views, "FAR", 6)
    monkeypatch.setattr(views.surfaces, "viewsheds", lambda cells, o, *args: taken.append(o.count()) or real(cells, o, *args))
    one = {r.zone: r.cells for r in whole(spark, sf).collect()}
    spark.read.parquet(f"{sf}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    own = spark.read.parquet(f"{sf}/supplier.parquet")
    own.unionByName(own.withColumn("s_suppkey", F.col("s_suppkey") + 149 * 97)).write.parquet(f"{tmp_path}/supplier.parquet")
    two = {r.zone: r.cells for r in whole(spark, str(tmp_path)).collect()}
    assert one and two == {k: 2 * n for k, n in one.items()} and taken[0] == taken[1]


def test_judges_are_solved_in_batches(spark, monkeypatch):
    pairs = spark.createDataFrame([(j, "a", "b", 1.0 + j % 5) for j in range(40)] + [(j, "c", "b", 0.5 + j % 3) for j in range(0, 40, 2)], "judge long, a string, b string, ratio double")
    got = decision.pair_weights(pairs, ["a", "b", "c"], "judge")
    assert "FlatMapGroupsInPandas" not in plan(got)  # not one call a judge
    rows = {(r.judge, r.criterion): r for r in got.collect()}
    assert len(rows) == 120
    for j in range(40):
        w, top, ratio = decision.weights(decision.matrix(["a", "b", "c"], {("a", "b"): 1.0 + j % 5} | ({("c", "b"): 0.5 + j % 3} if j % 2 == 0 else {})))
        for k, c in enumerate("abc"):
            r = rows[j, c]
            assert (r.weight, r.lambda_max, r.consistency) == pytest.approx((w[k], top, ratio), abs=1e-12)


def test_equal_rings_are_rasterized_once(spark, monkeypatch):
    seen, real = [], vector.rasterized
    monkeypatch.setattr(vector, "rasterized", lambda p, *a: seen.append(p.count()) or real(p, *a))
    ring = lambda x: [{"x": x, "y": 5.0}, {"x": x + 25.0, "y": 5.0}, {"x": x + 25.0, "y": 35.0}, {"x": x, "y": 35.0}]
    t = spark.createDataFrame([(k, ring(10.0 * (k % 3))) for k in range(30)], "id long, ring array<struct<x:double,y:double>>").withColumn("value", F.col("id"))
    got = {(x.r, x.c): x.value for x in vector.attribute_raster(t, Grid(0.0, 40.0, 10.0, 8, 4), "value", "id").collect()}
    assert seen == [3] and got == {(r, c): 29 if c >= 2 else 28 if c == 1 else 27 for r in range(4) for c in range(5)}


def test_suitability_is_reckoned_at_sites_only(spark, tmp_path, monkeypatch):
    seen, real = [], records.raster.neighbourhood
    monkeypatch.setattr(records.raster, "neighbourhood", lambda t, *a: seen.append(t.count()) or real(t, *a))
    rows = same_as_sql(spark, tmp_path, "suitability_check", orders="SELECT k::BIGINT AS o_orderkey, 50000 + k * 7919 % 350000::DOUBLE AS o_totalprice FROM range(14900) t(k)",
                       supplier="SELECT k::BIGINT AS s_suppkey FROM range(1, 40) t(k)", customer="SELECT 41 + 149 * 97 * (k % 4)::BIGINT AS c_custkey FROM range(12) t(k)")
    assert rows[0] and 0 < seen[0] < 9 * 41


def test_joins_of_many_pairs_have_tasks_of_their_own(spark):
    rng = np.random.default_rng(5)
    at = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 60, (300, 2)))]
    sites = spark.createDataFrame(at, "id long, x double, y double")
    pairs = graph.within(sites, 7)
    assert "REPARTITION_BY_NUM" in plan(pairs)
    assert sorted(tuple(r) for r in pairs.collect()) == sorted((a, b, (x - u) ** 2 + (y - v) ** 2) for a, x, y in at for b, u, v in at if a < b and (x - u) ** 2 + (y - v) ** 2 <= 49)
    ends = [(k, *map(float, rng.integers(0, 60, 4))) for k in range(40)]
    near = layers.beside(spark.createDataFrame(ends, "id long, x1 double, y1 double, x2 double, y2 double"), sites, 3.0)
    assert "REPARTITION_BY_NUM" in plan(near)
    want = set()
    for k, x1, y1, x2, y2 in ends:
        for s, x, y in at:
            l2 = (x2 - x1) ** 2 + (y2 - y1) ** 2
            t = ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / l2 if l2 else -1
            if 0 <= t <= 1 and ((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) ** 0.5 <= 3:
                want.add((k, s))
    assert sorted((r.id, r.site) for r in near.collect()) == sorted(want) and want


def test_buffers_of_convex_rings_need_no_union(spark, monkeypatch):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [(1, ring((0, 0), (9, 0), (9, 5), (0, 5))), (2, ring((0, 0), (0, 4), (6, 2))), (3, ring((0, 0), (9, 0), (9, 8), (4, 2), (0, 8)))]
    t = spark.createDataFrame(rows, "id long, ring array<struct<x:double,y:double>>")
    seen, real = [], overlays.united
    monkeypatch.setattr(overlays, "united", lambda p, *a: seen.append({r.key for r in p.collect()}) or real(p, *a))
    got = {r.key: r for r in overlays.ring_areas(overlays.buffered(t, 2.0)).collect()}
    assert seen == [{3}] and set(got) == {1, 2, 3}
    fan = 16 * np.sin(np.pi / 16) * 4  # 32 triangles round all corners together
    assert got[1].area == pytest.approx(45 + 2 * 28 + fan) and got[1].points == 36
    assert got[2].points == 27
    points = sorted((round(r.x, 9), round(r.y, 9)) for r in overlays.buffered(t.where("id = 2"), 2.0).collect())
    parts = overlays._pieces(t.where("id = 2"), 2.0)
    assert points == sorted((round(r.x, 9), round(r.y, 9)) for r in real(parts).collect())


def test_searches_for_nearest_broadcast_no_points(spark, tmp_path, monkeypatch):
    """Points come from a small file, as their tables do; queries far from all points are not searched."""
    rng = np.random.default_rng(12)
    spark.createDataFrame([(k, int(x), int(y)) for k, (x, y) in enumerate(rng.integers(0, 90, (400, 2)))], "id long, x long, y long").coalesce(1).write.parquet(f"{tmp_path}/p")
    points = spark.read.parquet(f"{tmp_path}/p")
    queries = points.selectExpr("id", "x", "y * 40 AS y")
    seen, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda t: seen.append((t.columns, plan(t))) or real(t))
    monkeypatch.setattr(graph, "DEALT", 100, raising=False)
    got = sorted(tuple(r) for r in graph.nearest(queries, points, 2, most=9.0).collect())
    joins = [p for columns, p in seen if columns == ["a", "b", "d2", "n"]]
    assert joins and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p and "REPARTITION_BY_NUM" in p for p in joins)
    at, want = [tuple(r) for r in points.collect()], []
    for a, x, y in [tuple(r) for r in queries.collect()]:
        near = sorted(((u - x) ** 2 + (v - y) ** 2, b) for b, u, v in at if (u - x) ** 2 + (v - y) ** 2 <= 81)[:2]
        want += [(a, b, d2) for d2, b in near]
    assert got == sorted(want) and want


def test_overlays_make_no_row_of_each_pair_of_sides(spark, monkeypatch):
    """Polygons of a bucket are dealt into parts on both sides, of few polygons and few corners; each pair counts once."""
    rng = np.random.default_rng(31)

    def table(count):
        rows = []
        for k in range(count):
            n, (x, y) = rng.integers(3, 12), rng.uniform(0, 12, 2)
            turns = (np.arange(n) + rng.uniform(0, 0.9, n)) * 2 * np.pi / n
            rows.append((k, [{"x": float(x + r * np.cos(t)), "y": float(y + r * np.sin(t))} for t, r in zip(turns.tolist(), rng.uniform(1, 5, len(turns)).tolist(), strict=True)][:: 1 if k % 2 else -1]))
        return spark.createDataFrame(rows, "id long, ring array<struct<x:double,y:double>>"), dict(rows)

    (left, p), (right, q) = table(23), table(17)
    monkeypatch.setattr(vector, "TOGETHER", 4, raising=False)
    monkeypatch.setattr(vector, "CORNERS", 30, raising=False)
    found = vector.overlay(left, right)
    assert "Generate explode(a_sides" not in plan(found) and "FlatMapCoGroupsInArrow" in plan(found)
    got = {(r.a, r.b): (r.shared, r.outside) for r in found.collect()}
    assert len(got) == found.count()

    def inside(ring, x, y):
        odd = np.zeros(x.shape, bool)
        for s, t in zip(ring, ring[1:] + ring[:1], strict=True):
            if s["y"] != t["y"]:
                odd ^= ((s["y"] > y) != (t["y"] > y)) & (x < (t["x"] - s["x"]) * (y - s["y"]) / (t["y"] - s["y"]) + s["x"])
        return odd

    x, y = np.meshgrid(np.arange(-6, 18, 0.05) + 0.025, np.arange(-6, 18, 0.05) + 0.025)
    there = [{k: inside(ring, x, y) for k, ring in rings.items()} for rings in (p, q)]
    for a, m in there[0].items():
        for b, n in there[1].items():
            shared, outside = got.get((a, b), (0.0, m.sum() * 0.0025))
            assert abs(shared - (m & n).sum() * 0.0025) < 0.35 and abs(outside - (m & ~n).sum() * 0.0025) < 0.35
