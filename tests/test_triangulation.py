"""Triangulations and shared areas against brute force."""

import itertools

import numpy as np
import pytest

from holloway.operators import triangulation, vector


def empty_circles(x, y):
    """Triangles whose circle has no other site strictly inside."""
    out = set()
    for a, b, c in itertools.combinations(range(len(x)), 3):
        m = 2 * np.array([[x[b] - x[a], y[b] - y[a]], [x[c] - x[a], y[c] - y[a]]])
        if abs(np.linalg.det(m)) > 1e-12:
            u = np.linalg.solve(m, [(x[b] - x[a]) ** 2 + (y[b] - y[a]) ** 2, (x[c] - x[a]) ** 2 + (y[c] - y[a]) ** 2])
            d = (x - x[a] - u[0]) ** 2 + (y - y[a] - u[1]) ** 2
            d[[a, b, c]] = np.inf
            if d.min() > u @ u:
                out.add((a, b, c))
    return out


def frame(spark, x, y):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")


@pytest.mark.parametrize("most", [triangulation.MOST_BORDER, 0])
def test_triangles_have_empty_circles(spark, monkeypatch, most):
    monkeypatch.setattr(triangulation, "MOST_BORDER", most)
    rng = np.random.default_rng(5)
    x, y = 4e5 + rng.random(60) * 900, 6e5 + rng.random(60) * 300
    assert {tuple(r) for r in triangulation.triangles(frame(spark, x, y)).collect()} == empty_circles(x, y)


def test_sites_on_circles_are_triangulated_once(spark):
    x, y = (v.ravel() for v in np.meshgrid(np.arange(7), np.arange(6)))
    sites = frame(spark, np.r_[x, 3.0], np.r_[y, 2.0])  # the last repeats a place
    t = [tuple(r) for r in triangulation.triangles(sites).collect()]
    assert len(t) == 2 * 6 * 5 and all(len({x[i] for i in k}) == len({y[i] for i in k}) == 2 for k in t)
    assert triangulation.delaunay(sites).count() == 7 * 5 + 6 * 6 + 6 * 5


def test_few_sites(spark):
    assert triangulation.triangles(frame(spark, [1, 2, 3], [1, 2, 3])).count() == 0
    assert {(r.a, r.b) for r in triangulation.delaunay(frame(spark, [1, 2, 4], [5, 5, 5])).collect()} == {(0, 1), (1, 2)}
    assert triangulation.delaunay(frame(spark, [1], [1])).count() == 0 and triangulation.delaunay(frame(spark, [], [])).count() == 0


def shared(left, right):
    """Shared area of a polygon and a convex one, by cutting the first along each side of the second."""
    out = list(left)
    for (px, py), (qx, qy) in zip(right, right[1:] + right[:1], strict=True):
        side = [(qx - px) * (b - py) - (qy - py) * (a - px) for a, b in out]
        new = []
        for i, (v, s) in enumerate(zip(out, side, strict=True)):
            w, t = out[(i + 1) % len(out)], side[(i + 1) % len(out)]
            new += [v] * int(s >= 0)
            if (s >= 0) != (t >= 0):
                new.append((v[0] + (w[0] - v[0]) * s / (s - t), v[1] + (w[1] - v[1]) * s / (s - t)))
        out = new
    return abs(sum(a * d - c * b for (a, b), (c, d) in zip(out, out[1:] + out[:1], strict=True))) / 2


def test_shared_areas(spark):
    rng = np.random.default_rng(8)
    ring = lambda n, r, x, y: [(x + k * np.cos(t), y + k * np.sin(t)) for t, k in zip(np.sort(rng.random(n)) * 2 * np.pi, r, strict=True)]
    left = [(i, ring(9, rng.uniform(2, 9, 9), *rng.uniform(0, 60, 2))) for i in range(40)]
    right = [(i, ring(6, [rng.uniform(2, 20)] * 6, *rng.uniform(0, 60, 2))) for i in range(40)]
    table = lambda t: spark.createDataFrame([(i, [{"x": float(a), "y": float(b)} for a, b in r]) for i, r in t], "id long, ring array<struct<x: double, y: double>>")
    got = {(r.a, r.b): r.shared for r in vector.overlay(table(left), table(right)).collect()}
    want = {(i, j): s for i, p in left for j, q in right if (s := shared(p, q)) > 1e-6}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
