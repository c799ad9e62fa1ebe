"""Whole jobs on small tables: what the review of larger ones found."""

import importlib
import random

import numpy as np
import pytest

from holloway import catalog
from holloway.operators import chains, graph, overlays, surfaces
from tests.test_larger_tables import plan
from tests.test_overlays import SHAPES, table
from tests.test_places_of_scale import same_as_sql

components_of = importlib.import_module("holloway.operators.components")


def test_wheeled_costs_square_as_their_sql(spark, tmp_path):
    # The square of this step's slope lies so near the middle of two numbers that the C library's pow takes the other one: one of 60 million steps.
    same_as_sql(spark, tmp_path, "cost_wheeled", orders="SELECT k::BIGINT AS o_orderkey, v AS o_totalprice FROM (VALUES (0, 362728.99), (1, 1000.0), (100, 490000.0), (101, 212185.09)) t(k, v)")


@pytest.mark.parametrize("name", ["overlay_outlines", "difference_outlines"])
def test_pairs_are_outlined_where_they_meet(spark, sf, name):
    """No pair of sides, part or point of an outline is a row of a shuffle."""
    found = plan(catalog.QUERIES[name](spark, sf))
    assert "FlatMapCoGroupsInArrow" in found and "Window" not in found and "HashAggregate" not in found.split("FlatMapCoGroupsInArrow")[0]


@pytest.mark.parametrize("kind", overlays.KINDS)
def test_measures_equal_the_rings(spark, monkeypatch, kind):
    left, right = table(spark, list(enumerate(SHAPES))), table(spark, list(enumerate(SHAPES[::-1])))
    want = {}
    for r in overlays.ring_areas(overlays.overlay_rings(left, right, kind)).collect():
        area, rings, points = want.get(tuple(r.key), (0.0, 0, 0))
        want[tuple(r.key)] = (area + r.area, rings + 1, points + r.points)
    for together, at_once in ((400, 1 << 18), (2, 7)):
        monkeypatch.setattr(overlays, "TOGETHER", together)
        monkeypatch.setattr(overlays, "AT_ONCE", at_once)
        got = {(r.a, r.b): (r.area, r.rings, r.points) for r in overlays.overlay_measures(left, right, kind).collect()}
        assert got == want and want


def test_unions_cut_polygons_with_those_round_them(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, "ab"[k % 2], [(x + i, y + j) for i, j in ((0, 0), (9, 0), (9, 8), (4.5, 2), (0, 8))]) for k in range(60) for x, y in [(rng.uniform(0, 40), rng.uniform(0, 30))]]
    rows += [(100, "b", rows[1][2]), (101, "a", [(200, 0), (204, 0), (204, 4)])]
    found = table(spark, rows, "key string, ")
    rings = lambda: sorted((r.key, round(r.area, 6), r.points) for r in overlays.ring_areas(overlays.united(found)).collect())
    monkeypatch.setattr(overlays, "WIDEST", 0)
    want = rings()
    monkeypatch.setattr(overlays, "WIDEST", 8)
    monkeypatch.setattr(overlays, "_cuts", None)  # no pair of sides is a row
    assert rings() == want
    monkeypatch.setattr(overlays, "TOGETHER", 3)
    monkeypatch.setattr(overlays, "AT_ONCE", 50)
    assert rings() == want


@pytest.mark.parametrize("held,wider", [(500_000, 16), (12, 4), (0, 4)])
def test_chains_in_wider_blocks(spark, monkeypatch, held, wider):
    """Lines and rings over a raster of blocks: put together in one task, in wider blocks, or in rounds, they are ranked alike."""
    rng = np.random.default_rng(4)
    place, after = {}, {}
    ways = [[(i, 3) for i in range(30)], [(29 - i, 9 + i % 3) for i in range(30)], [(12, 12), (12, 13), (13, 13), (13, 12)]]
    ways += [[(a, i) for i in range(a, b)] + [(i, b) for i in range(a, b)] + [(b, i) for i in range(b, a, -1)] + [(i, a) for i in range(b, a, -1)] for a, b in ((0, 29), (7, 20), (14, 16))]
    ids = iter(rng.permutation(2000))
    for k, way in enumerate(ways):
        nodes = [int(next(ids)) for _ in way]
        place |= dict(zip(nodes, way, strict=True))
        after |= dict(zip(nodes, nodes[1:] + [nodes[0] if k > 1 else None], strict=True))
    t = spark.createDataFrame([(n, m, (place[n][0] // 3, place[n][1] // 3)) for n, m in after.items()], "node long, next long, block struct<r:long,c:long>")
    rows = lambda: sorted(tuple(r) for r in chains.ranked(t).select("node", "chain", "at", "size", "closed").collect())
    rounds, real = [], chains._doubled
    monkeypatch.setattr(chains, "_doubled", lambda s: rounds.append(1) or real(s))
    monkeypatch.setattr(chains, "_put_together", lambda *a: None)
    want = rows()
    assert rounds and len(want) == len(after)
    monkeypatch.undo()
    monkeypatch.setattr(chains, "HELD", held)
    monkeypatch.setattr(chains, "WIDER", wider)
    rounds.clear()
    monkeypatch.setattr(chains, "_doubled", lambda s: rounds.append(1) or real(s))
    assert rows() == want and bool(rounds) == (not held)


@pytest.mark.parametrize("held", [10**6, 0])
def test_forests_and_parts_of_dealt_links(spark, monkeypatch, held):
    """Links are thinned in tasks; what these leave is one task's, or goes on in rounds. All give the same forest and parts."""
    rng = np.random.default_rng(6)
    links = sorted({(int(min(p)), int(max(p)), float(rng.integers(1, 4))) for p in rng.integers(0, 120, (400, 2)) // 3 * 3 + 1 if p[0] != p[1]})
    t = spark.createDataFrame(links, "a long, b long, d2 double")
    root = {v: v for k in links for v in k[:2]}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    want = []
    for w, a, b in sorted((w, a, b) for a, b, w in {(a, b): k for k in links for a, b in [k[:2]]}.values()):
        if (ra := find(a)) != (rb := find(b)):
            root[max(ra, rb)] = min(ra, rb)
            want.append((a, b, w))
    links = list({k[:2]: k for k in links}.values())
    t = spark.createDataFrame(links, "a long, b long, d2 double")
    rounds, real = [], components_of._state
    monkeypatch.setattr(components_of, "_state", lambda x: rounds.append(1) or real(x))
    for module, names in ((components_of, ("LINKS_A_TASK", "HELD")), (graph, ("FOREST_A_TASK", "FOREST_HELD"))):
        monkeypatch.setattr(module, names[0], 60, raising=False)
        monkeypatch.setattr(module, names[1], held, raising=False)
    assert sorted(map(tuple, graph.spanning_tree(t).collect())) == sorted(want)
    assert sorted(map(tuple, components_of.components(t.select("a", "b")).collect())) == sorted((v, find(v)) for v in root)
    assert bool(rounds) == (not held)


@pytest.mark.parametrize("shared", [64, 2])
def test_observers_at_one_place_share_a_view(spark, monkeypatch, shared):
    rng = np.random.default_rng(2)
    cells = spark.createDataFrame([(int(r), int(c), float(z)) for (r, c), z in np.ndenumerate(rng.random((12, 12)) * 40) if (r, c) != (5, 7)], "r long, c long, z double")
    places = [(4, 4, 1.6), (9, 2, 1.6), (4, 4, 5.0), (5, 7, 1.6), (40, 40, 1.6)]
    where = {k: places[k % 5] for k in range(23)}
    o = spark.createDataFrame([(k, *p) for k, p in where.items()] + [(0, *where[0])], "obs int, r int, c int, h double")
    found = lambda t: sorted(tuple(r) for r in surfaces.viewsheds(cells, t, 4, 30.0).collect())
    one = {p: [r[1:] for r in found(o.where(f"obs = {k}"))] for k, p in list(where.items())[:5]}
    monkeypatch.setattr(surfaces, "SHARED", shared, raising=False)
    seen = surfaces.viewsheds(cells, o, 4, 30.0)
    assert sorted(map(tuple, seen.collect())) == sorted((k, *r) for k, p in where.items() for r in one[p]) and one[4, 4, 1.6] != one[4, 4, 5.0]
    assert "FlatMapCoGroupsInPandas" in plan(seen)  # surroundings meet places, not observers
