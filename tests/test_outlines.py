"""Chains, outlines and ordered contours against in-memory tracers."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from holloway.operators import chains, outlines, raster, vector


def follow(after):
    """The chains of {node: next or None}, rings as lists that begin anywhere."""
    left, out = dict(after), []
    for start in sorted(set(after) - set(after.values())):
        chain = []
        while start is not None and start in left:
            chain.append(start)
            start = left.pop(start)
        out.append((False, chain))
    while left:
        start = next(iter(left))
        ring = []
        while start in left:
            ring.append(start)
            start = left.pop(start)
        out.append((True, ring))
    return out


def turned(ring):
    k = ring.index(min(ring))
    return tuple(ring[k:] + ring[:k])


@pytest.mark.parametrize("seed,block", [(1, 1), (1, 7), (2, 1000), (3, 3)])
def test_ranked(spark, seed, block):
    rng = random.Random(seed)
    nodes = rng.sample(range(2**62, 2**62 + 1000), 400)
    after, k = {}, 0
    for size, ring in ((1, False), (1, True), (2, True), (90, True), (150, False), (3, False), (64, True), (89, False)):
        part = nodes[k : k + size]
        k += size
        after |= dict(zip(part, part[1:] + ([part[0]] if ring else [None]), strict=True))
    after[nodes[k - 1]] = 7  # leads to a node that is not there: an end
    t = spark.createDataFrame([(n, m, n % block) for n, m in after.items()], "node long, next long, block long")
    got, closed = defaultdict(dict), {}
    for r in chains.ranked(t).collect():
        got[r.chain][r.at] = r.node
        closed[r.chain] = (r.closed, r.size)
    found = {(turned(x) if closed[c][0] else tuple(x)) for c, places in got.items() for x in [[places[i] for i in range(closed[c][1])]] if len(places) == closed[c][1]}
    want = follow({n: m if m != 7 else None for n, m in after.items()})
    assert found == {turned(x) if ring else tuple(x) for ring, x in want} and sum(c for c, _ in closed.values()) == sum(ring for ring, _ in want)


def areas_of(z, corners):
    """Connected areas of equal class by flood fill: {(r, c): least cell number}."""
    height, width = z.shape
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (corners or not (i and j))]
    region = {}
    for r in range(height):
        for c in range(width):
            if z[r, c] >= 0 and (r, c) not in region:
                stack = [(r, c)]
                region[r, c] = r * width + c
                while stack:
                    a, b = stack.pop()
                    for i, j in steps:
                        p = a + i, b + j
                        if 0 <= p[0] < height and 0 <= p[1] < width and p not in region and z[p] == z[r, c]:
                            region[p] = r * width + c
                            stack.append(p)
    return region


def traced(region, corners):
    """Rings of corner points by walking each area's sides with the area on the right."""
    out = defaultdict(list)
    ahead = [(0, 1), (1, 0), (0, -1), (-1, 0)]  # the way of each side
    left = {(r, c, s) for (r, c), g in region.items() for s, (i, j) in enumerate([(-1, 0), (0, 1), (1, 0), (0, -1)]) if region.get((r + i, c + j)) != g}
    while left:
        first = at = min(left)
        points = []
        while True:
            left.discard(at)
            r, c, s = at
            i, j = ahead[s]
            oi, oj = ahead[(s - 1) % 4]
            g = region[r, c]
            straight, across = region.get((r + i, c + j)) == g, region.get((r + i + oi, c + j + oj)) == g
            end = (c + (s in (0, 1)), r + (s in (1, 2)))
            if across and (straight or corners):
                at = (r + i + oi, c + j + oj, (s - 1) % 4)
            elif straight:
                at = (r + i, c + j, s)
            else:
                at = (r, c, (s + 1) % 4)
            if at[2] != s:
                points.append(end)
            if at == first:
                break
        out[g].append(turned(points))
    return out


def shoelace(points):
    return sum(a * d - b * c for (a, b), (c, d) in zip(points, [*points[1:], points[0]], strict=True)) / 2


@pytest.mark.parametrize("corners,block", [(True, 64), (True, 3), (False, 5)])
def test_outlines_equal_a_tracer(spark, monkeypatch, corners, block):
    monkeypatch.setattr(outlines, "BLOCK", block)
    z = np.random.default_rng(4).integers(-1, 2, (17, 23))
    z[4:12, 5:15] = 1
    z[6:10, 7:13] = 0
    z[7, 8] = 1
    region = areas_of(z, corners)
    t = spark.createDataFrame([(r, c, g) for (r, c), g in region.items()], "r long, c long, region long")
    points = outlines.outlines(t, corners).cache()
    rings = defaultdict(list)
    for p in sorted(points.where("turn").collect(), key=lambda p: (p.ring, p.at)):
        rings[p.region, p.ring].append((p.x, p.y))
    got = defaultdict(list)
    for (g, _), ring in rings.items():
        got[g].append(turned(ring))
    want = traced(region, corners)
    assert {g: sorted(x) for g, x in got.items()} == {g: sorted(x) for g, x in want.items()}
    table = outlines.ring_table(points).collect()
    assert {(r.region, r.ring): r.area for r in table} == {k: shoelace(x) for k, x in rings.items()}
    for p in outlines.polygons(outlines.ring_table(points)).collect():
        assert p.area == sum(g == p.region for g in region.values()) and p.holes == len(want[p.region]) - 1 and p.shell is not None
    if corners:
        cells = spark.createDataFrame([(r, c, int(z[r, c]) if z[r, c] >= 0 else None) for r in range(17) for c in range(23)], "r long, c long, class int")
        labels = {(r.r, r.c): r.region for r in vector.labelled_regions(cells, 23).collect()}
        assert labels == region
    points.unpersist()


def raster_of(spark, z):
    return spark.createDataFrame([(r, c, float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])], "r long, c long, z double")


@pytest.mark.parametrize("block", [64, 4])
def test_contours_in_order(spark, monkeypatch, block):
    """Points follow one another by pieces, along open and closed lines, through saddles and centres on the level."""
    monkeypatch.setattr(outlines, "BLOCK", block)
    y, x = np.mgrid[0:14, 0:17]
    z = np.round(5 * np.sin(x / 2.0) + 4 * np.cos(y / 1.7)) + 10.0
    levels = [9.0, 12.5]
    pieces = raster.marching_squares(raster_of(spark, z), levels).collect()
    begin = {(p.level, p.r + (p["from"] == "bottom"), p.c + (p["from"] == "right"), p["from"] in ("top", "bottom")): p for p in pieces}
    key = lambda p: (p.level, p.r, p.c, p.part)
    after = {}
    for p in pieces:
        n = begin.get((p.level, p.r + (p.to == "bottom"), p.c + (p.to == "right"), p.to in ("top", "bottom")))
        after[key(p)] = n and key(n)
        assert n is None or (n.x1, n.y1) == (p.x2, p.y2)
        # Higher ground is on the right: a little beside the middle of the piece.
        dx, dy = p.x2 - p.x1, p.y2 - p.y1
        if math.hypot(dx, dy) > 1e-9 and (p.x1 % 1 or p.y1 % 1) and (p.x2 % 1 or p.y2 % 1):
            mx, my = (p.x1 + p.x2) / 2 - 1e-3 * dy, (p.y1 + p.y2) / 2 + 1e-3 * dx
            u, v = mx - p.c, my - p.r
            if 0 <= u <= 1 and 0 <= v <= 1 and p.part == 0 and after[key(p)] is not None and not any(q.part == 1 and (q.level, q.r, q.c) == (p.level, p.r, p.c) for q in pieces):
                a, b, c, d = z[p.r, p.c], z[p.r, p.c + 1], z[p.r + 1, p.c], z[p.r + 1, p.c + 1]
                assert (1 - u) * (1 - v) * a + u * (1 - v) * b + (1 - u) * v * c + u * v * d >= p.level - 0.6
    by = {key(p): p for p in pieces}
    want = set()
    for ring, nodes in follow(after):
        nodes = list(turned(nodes)) if ring else nodes
        line = [(by[nodes[0]].x1, by[nodes[0]].y1), *((by[n].x2, by[n].y2) for n in nodes)]
        want.add((by[nodes[0]].level, ring, turned(line[:-1]) if ring else tuple(line)))
    lines, closed = defaultdict(dict), {}
    for p in outlines.contour_paths(raster_of(spark, z), levels).collect():
        lines[p.level, p.line][p.at] = (p.x, p.y)
        closed[p.level, p.line] = p.closed
    got = set()
    for k, points in lines.items():
        line = [points[i] for i in range(len(points))]
        assert not closed[k] or line[0] == line[-1]
        got.add((k[0], closed[k], turned(line[:-1]) if closed[k] else tuple(line)))
    assert got == want and any(ring for _, ring, _ in got) and any(not ring for _, ring, _ in got)
