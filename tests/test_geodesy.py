"""Ellipsoidal measures against published figures."""

import pytest
from pyspark.sql import functions as F

from holloway.functions import geodesy


def dms(d, m, s):
    return d + m / 60 + s / 3600


def test_published_lines(spark):
    lines = [
        # The line from Flinders Peak to Buninyong of the Australian datum manual.
        (dms(144, 25, 29.52440), -dms(37, 57, 3.72030), dms(143, 55, 35.38390), -dms(37, 39, 10.15610), 54972.271, geodesy.GRS80),
        (0.0, 0.0, 0.0, 90.0, 10001965.729, geodesy.WGS84),  # a quarter of a meridian
        (0.0, 0.0, 1.0, 0.0, 111319.491, geodesy.WGS84),  # a degree along the equator
        (179.5, 0.0, -179.5, 0.0, 111319.491, geodesy.WGS84),  # the same across the date line
        (5.0, 45.0, 5.0, 45.0, 0.0, geodesy.WGS84),
    ]
    for x1, y1, x2, y2, want, e in lines:
        got = spark.range(1).select(geodesy.length(*map(F.lit, (x1, y1, x2, y2)), e).alias("m")).first().m
        assert got == pytest.approx(want, abs=6e-4)
    far = spark.range(1).select(geodesy.length(*map(F.lit, (0.0, 0.0, 179.9, 0.1))).alias("m")).first().m
    assert far is None or 1.99e7 < far < 2.01e7


def test_areas(spark):
    """An eighth of the earth, of 510,065,621,724,089 square metres, in either direction, and a square near a pole of the date line."""
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    eighth = [(0, 0), (45, 0), (90, 0), (90, 90), (45, 90), (0, 90)]
    got = spark.range(1).select(geodesy.area(ring(*eighth)).alias("a"), geodesy.area(ring(*eighth[::-1])).alias("b"), geodesy.perimeter(ring((0, 0), (1, 0), (1, 0))).alias("p")).first()
    assert got.a == pytest.approx(510065621724089 / 8, rel=1e-12) and got.b == pytest.approx(got.a) and got.p == pytest.approx(2 * 111319.491, abs=1e-2)
    east, over = [(10, 60), (11, 60), (11, 61), (10, 61)], [(179.5, 60), (-179.5, 60), (-179.5, 61), (179.5, 61)]
    a, b = spark.range(1).select(geodesy.area(ring(*east)), geodesy.area(ring(*over))).first()
    assert a == pytest.approx(b)
