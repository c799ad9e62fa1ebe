"""Class tables of terrain measures and small labels, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of classes.
SLOPE_SCHEMES = {"korean": (15, 20, 25, 30, 90), "tobler": (6, 12, 18, 25, 90), "minetti": (3, 9, 15, 25, 90), "llobera": (2, 6, 12, 20, 90)}
ROUGHNESS = (1, 3, 6, 15, math.inf)
ASPECT = (0, 45, 90, 135, 180, 225, 270, 315, 360)
TRI_SHARES = (0.1, 0.25, 0.5, 1.0, math.inf)
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def by_upper_bound(v: Column, bounds) -> Column:
    """1 to n: the first class whose upper bound is not below the value; above all bounds null."""
    out = F.when(v.isNull(), F.lit(None).cast("int"))
    for k, b in enumerate(bounds, 1):
        out = out.when(v <= float(b), F.lit(k))
    return out


def tri_class(tri: Column, top: float = 20.0) -> Column:
    return by_upper_bound(tri, [s * top for s in TRI_SHARES])


def tpi_class(tpi: Column, threshold: float = 1.0) -> Column:
    """1 valley, 2 slope or flat, 3 ridge."""
    return F.when(tpi < -threshold, 1).when(tpi <= threshold, 2).when(tpi.isNotNull(), 3)


def slope_position(tpi: Column, slope: Column, low: float | Column = -1.0, high: float | Column = 1.0, flat: float = 5.0) -> Column:
    """1 incised valley, 2 lower slope, 3 flat, 4 mid slope, 5 upper slope, 6 ridge; 0 where either input is missing."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    middle = (F.when(tpi < low, 1).when(tpi < low / 2, 2).when((tpi <= high / 2) & (slope <= flat), 3)
              .when(tpi <= high / 2, 4).when(tpi <= high, 5).otherwise(6))
    return F.when(tpi.isNull() | slope.isNull(), F.lit(0)).otherwise(middle)


def compass8(bearing: Column) -> Column:
    """N, NE, ... by the nearest of eight directions; null without a bearing."""
    # element_at alone gives the last element at a null place of an array without nulls.
    return F.when(bearing.isNotNull(), F.element_at(F.array(*[F.lit(c) for c in COMPASS]), (F.floor((F.pmod(bearing, F.lit(360.0)) + 22.5) / 45.0) % 8 + 1).cast("int")))


def direction8(aspect: Column) -> Column:
    """0 to 7 by the nearest of eight directions of the aspect in whole degrees (half-even)."""
    return (F.floor((F.pmod(F.bround(aspect), F.lit(360.0)) + 22.5) / 45.0) % 8).cast("int")


def distance_phrase(metres: Column) -> Column:
    return (F.when(metres <= 0.5, F.lit("touching")).when(metres < 1000, F.concat(F.format_string("%.0f", metres), F.lit(" m")))
            .when(metres.isNotNull(), F.concat(F.format_string("%.1f", metres / 1000), F.lit(" km"))))


def higuchi_zone(distance: Column, visible: Column) -> Column:
    """Distance zones of visible cells: 85 near, 170 middle, 255 far; 0 where nothing is seen."""
    return F.when(~visible, 0).when(distance <= 500, 85).when(distance <= 2500, 170).otherwise(255)
