"""Outlines of shared areas, unions and differences against counted cells and against the areas of vector.overlay."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from holloway.operators import overlays, vector

RING = "array<struct<x:double,y:double>>"


def table(spark, rows, extra=""):
    return spark.createDataFrame([(*r[:-1], [{"x": float(x), "y": float(y)} for x, y in r[-1]]) for r in rows], f"id int, {extra}ring {RING}")


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


#: L, U and comb shapes on whole numbers, some clockwise.
SHAPES = [box(0, 0, 6, 6), box(6, 0, 4, 6)[::-1], box(2, 2, 2, 2), [(0, 0), (9, 0), (9, 3), (3, 3), (3, 9), (0, 9)], [(1, 1), (8, 1), (8, 8), (6, 8), (6, 3), (3, 3), (3, 8), (1, 8)],
          box(20, 20, 3, 3), box(0, 6, 6, 2), [(4, -2), (5, -2), (5, 12), (4, 12)][::-1], box(0, 0, 6, 6)]


def cells(ring):
    """The unit cells inside a polygon on whole numbers."""
    out = set()
    for r in range(-3, 30):
        for c in range(-3, 30):
            x, y, inside = c + 0.5, r + 0.5, False
            for (a, b), (d, e) in zip(ring, [*ring[1:], ring[0]], strict=True):
                if (b > y) != (e > y) and x < (d - a) * (y - b) / (e - b) + a:
                    inside = not inside
            if inside:
                out.add((r, c))
    return out


def areas(rings):
    out = defaultdict(float)
    for r in overlays.ring_areas(rings).collect():
        out[tuple(r.key) if hasattr(r.key, "asDict") else r.key] += r.area
    return out


@pytest.mark.parametrize("kind,joined", [("shared", set.__and__), ("union", set.__or__), ("difference", set.__sub__)])
def test_pairs_equal_counted_cells(spark, kind, joined):
    left, right = table(spark, list(enumerate(SHAPES))), table(spark, list(enumerate(SHAPES)))
    got = areas(overlays.overlay_rings(left, right, kind).repartition(3))
    have = [cells(s) for s in SHAPES]
    boxes = [(min(x for x, _ in s), max(x for x, _ in s), min(y for _, y in s), max(y for _, y in s)) for s in SHAPES]
    meets = lambda p, q: p[0] <= q[1] and q[0] <= p[1] and p[2] <= q[3] and q[2] <= p[3]
    want = {(a, b): len(joined(have[a], have[b])) for a in range(len(SHAPES)) for b in range(len(SHAPES)) if meets(boxes[a], boxes[b])}
    assert {k: v for k, v in got.items() if v} == pytest.approx({k: v for k, v in want.items() if v})


def test_slanting_polygons(spark):
    rng = random.Random(7)
    shapes = []
    for k in range(12):
        cx, cy, n = rng.uniform(0, 20), rng.uniform(0, 20), rng.randrange(3, 9)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        shapes.append([(cx + (r := rng.uniform(2, 9)) * math.cos(a), cy + r * math.sin(a)) for a in turns][:: rng.choice((1, -1))])
    left, right = table(spark, list(enumerate(shapes[:6]))), table(spark, list(enumerate(shapes[6:])))
    shared = {(r.a, r.b): r.shared for r in vector.overlay(left, right).collect()}
    whole = [[r[0] for r in t.orderBy("id").select(vector.area(F.col("ring"))).collect()] for t in (left, right)]
    got = {kind: areas(overlays.overlay_rings(left, right, kind)) for kind in overlays.KINDS}
    assert {k: v for k, v in got["shared"].items() if v > 1e-6} == pytest.approx({k: v for k, v in shared.items() if v > 1e-6})
    for (a, b), v in got["union"].items():
        assert v == pytest.approx(whole[0][a] + whole[1][b] - shared.get((a, b), 0.0))
        assert got["difference"].get((a, b), 0.0) == pytest.approx(whole[0][a] - shared.get((a, b), 0.0), abs=1e-6)


def test_union_of_many(spark):
    rng = random.Random(9)
    rows, have = [], defaultdict(set)
    for k in range(40):
        g = "ab"[k % 2]
        ring = box(rng.randrange(24), rng.randrange(24), rng.randrange(1, 6), rng.randrange(1, 6))
        rows.append((k, g, ring if k % 3 else ring[::-1]))
        have[g] |= cells(ring)
    rows += [(100 + k, "c", box(x, y, w, h)) for k, (x, y, w, h) in enumerate([(0, 0, 10, 2), (0, 8, 10, 2), (0, 0, 2, 10), (8, 0, 2, 10)])]  # a frame round a hole
    out = overlays.united(table(spark, rows, "key string, ")).cache()
    assert areas(out) == pytest.approx({"a": len(have["a"]), "b": len(have["b"]), "c": 64})
    frame = {r.area for r in overlays.ring_areas(out).where("key = 'c'").collect()}
    assert frame == {100.0, -36.0}
    # Outlines hold no point inside the union and come in order: every step runs along one side.
    steps = [r for r in out.where("key = 'c'").orderBy("ring", "at").collect()]
    assert all((p.x == q.x) != (p.y == q.y) for p, q in zip(steps, steps[1:], strict=False) if p.ring == q.ring)
    out.unpersist()


def test_buffers(spark):
    """Of a square, and of an L, whose inner corner has no fan and two strips that overlap."""
    shapes = table(spark, [(1, box(0, 0, 10, 10)[::-1]), (2, [(0, 0), (20, 0), (20, 10), (10, 10), (10, 20), (0, 20)])])
    fan = 8 * 4 / 2 * math.sin(math.pi / 16)  # a quarter of a circle of radius 2
    got = areas(overlays.buffered(shapes, 2.0))
    assert got == pytest.approx({1: 100 + 40 * 2 + 4 * fan, 2: 300 + 80 * 2 - 4 + 5 * fan})
