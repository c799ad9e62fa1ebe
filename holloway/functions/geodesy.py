"""Lengths and areas on an ellipsoid of places in degrees of longitude and latitude, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    """Semi-major axis in metres and flattening."""

    a: float
    f: float


WGS84, GRS80 = Ellipsoid(6378137.0, 1 / 298.257223563), Ellipsoid(6378137.0, 1 / 298.257222101)
#: Rounds of the inverse problem; lines that are nearly half round the earth take more and have no length.
ROUNDS, SETTLED = 40, 1e-13
#: Places along a side and their weights, for the mean of a function over it (Gauss and Legendre, five places).
_PLACES = [(0.5 + s * x / 2, w / 2) for x, w in ((0.0, 128 / 225), (math.sqrt(5 - 2 * math.sqrt(10 / 7)) / 3, (322 + 13 * math.sqrt(70)) / 900), (math.sqrt(5 + 2 * math.sqrt(10 / 7)) / 3, (322 - 13 * math.sqrt(70)) / 900)) for s in ((1, -1) if x else (1,))]


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.transform(F.array(value), f)[0]


def length(lon1: Column, lat1: Column, lon2: Column, lat2: Column, e: Ellipsoid = WGS84) -> Column:
    """Metres along the shortest line between two places (Vincenty's inverse formula); null where it does not settle.

    The difference of longitudes on the auxiliary sphere is improved in turn until it stands still.
    """
    b = e.a * (1 - e.f)
    reduced = lambda lat: F.atan((1 - e.f) * F.tan(F.radians(lat)))
    ends = F.struct(reduced(lat1).alias("u"), reduced(lat2).alias("v"), (F.pmod(F.radians(lon2 - lon1) + math.pi, F.lit(2 * math.pi)) - math.pi).alias("l"))

    def on_sphere(p: Column, lam: Column) -> Column:
        """Of a difference of longitudes: sine and cosine of the arc, the squared cosine of its azimuth at the equator, and the cosine of twice its middle."""
        su, cu, sv, cv = F.sin(p["u"]), F.cos(p["u"]), F.sin(p["v"]), F.cos(p["v"])
        sine = F.hypot(cv * F.sin(lam), cu * sv - su * cv * F.cos(lam))
        cosine = su * sv + cu * cv * F.cos(lam)
        azimuth = F.when(sine > 0, cu * cv * F.sin(lam) / F.nullif(sine, F.lit(0.0))).otherwise(0.0)
        across = 1 - azimuth * azimuth
        middle = F.when(across > 1e-30, cosine - 2 * su * sv / F.greatest(across, F.lit(1e-30))).otherwise(0.0)
        return F.struct(sine.alias("s"), cosine.alias("c"), azimuth.alias("z"), across.alias("q"), middle.alias("m"))

    def better(state: Column, p: Column) -> Column:
        def with_arc(g: Column) -> Column:
            c = e.f / 16 * g["q"] * (4 + e.f * (4 - 3 * g["q"]))
            arc = F.atan2(g["s"], g["c"])
            lam = p["l"] + (1 - c) * e.f * g["z"] * (arc + c * g["s"] * (g["m"] + c * g["c"] * (2 * g["m"] * g["m"] - 1)))
            return F.struct(lam.alias("lam"), F.abs(lam - state["lam"]).alias("step"))

        return F.when(state["step"] <= SETTLED, state).otherwise(_let(on_sphere(p, state["lam"]), with_arc))

    def metres(p: Column) -> Column:
        start = F.struct(p["l"].alias("lam"), F.lit(math.inf).alias("step"))
        settled = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: better(state, p))

        def along(g: Column) -> Column:
            u2 = g["q"] * (e.a * e.a / (b * b) - 1)
            big = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
            small = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
            m, s, c = g["m"], g["s"], g["c"]
            off = small * s * (m + small / 4 * (c * (2 * m * m - 1) - small / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))
            return b * big * (F.atan2(s, c) - off)

        return _let(settled, lambda state: F.when(state["step"] <= SETTLED, _let(on_sphere(p, state["lam"]), along)))

    return _let(ends, metres)


def _sides(ring: Column) -> Column:
    return F.arrays_zip(ring.alias("p"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("q"))


def perimeter(ring: Column, e: Ellipsoid = WGS84) -> Column:
    """Metres round a ring of places (struct of x, the longitude, and y, the latitude; not closed)."""
    parts = F.transform(_sides(ring), lambda s: length(s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"], e))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def area(ring: Column, e: Ellipsoid = WGS84) -> Column:
    """Square metres inside a ring of places whose sides are straight in longitude and latitude: the sum over its sides of the exact area between them and the equator."""
    ex = math.sqrt(e.f * (2 - e.f))

    def upto(sine: Column) -> Column:
        """The area from the equator to a latitude, of one radian of longitude and half a square axis."""
        return (1 - ex * ex) * (sine / (1 - ex * ex * sine * sine) + F.log((1 + ex * sine) / (1 - ex * sine)) / (2 * ex))

    def under(s: Column) -> Column:
        mean = sum(w * upto(F.sin(F.radians(s["p"]["y"] + t * (s["q"]["y"] - s["p"]["y"])))) for t, w in _PLACES)
        east = F.pmod(F.radians(s["q"]["x"] - s["p"]["x"]) + math.pi, F.lit(2 * math.pi)) - math.pi
        return east * mean

    return F.abs(F.aggregate(F.transform(_sides(ring), under), F.lit(0.0), lambda a, x: a + x)) * (e.a * e.a / 2)
