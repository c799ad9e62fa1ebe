"""Outlines of areas of a raster as rings of points, and contours as lines of points in order.

Sides of cells and pieces of lines are nodes that each know the one after them; ``chains.ranked`` puts them in order, so no task holds an
area or a line. Coordinates are in cells from the raster's upper left corner, y downwards; ``Grid`` maps them to the plane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import stored
from .chains import ranked
from .raster import marching_squares

#: Cells along a side of the blocks in which sides and pieces are followed first.
BLOCK = 64
_SIDES = {"top": 0, "right": 1, "bottom": 2, "left": 3}


def _edge(r: Column, c: Column, side: str) -> Column:
    """The number of a cell's side; rows and columns from -1 to 2**29."""
    return (((r + 1) * F.lit(1 << 30) + (c + 1)) * 4 + _SIDES[side]).cast("long")


def sides(areas: DataFrame, corners: bool = True) -> DataFrame:
    """(node, next, region, r, c, side, turn) of cells (r, c, region): the sides where an area ends, clockwise round it (anticlockwise round
    holes), each with the one after it and whether the outline turns there. With ``corners``, cells that touch at a corner hang together.

    Cells meet at their corners: each corner knows its four cells and so what follows the up to four sides that end there.
    """
    at = lambda i, j, k: F.struct((F.col("r") + i).alias("i"), (F.col("c") + j).alias("j"), F.lit(k).alias("k"))
    spread = areas.where("region IS NOT NULL").select("region", F.inline(F.array(at(1, 1, 0), at(1, 0, 1), at(0, 1, 2), at(0, 0, 3))))
    around = spread.groupBy("i", "j").agg(*[F.max(F.when(F.col("k") == k, F.col("region"))).alias(q) for k, q in enumerate(("nw", "ne", "sw", "se"))])
    place = {"nw": (-1, -1), "ne": (-1, 0), "sw": (0, -1), "se": (0, 0)}
    edge = lambda q, side: _edge(F.col("i") + place[q][0], F.col("j") + place[q][1], side)
    same = lambda p, q: F.col(p).eqNullSafe(F.col(q))

    def ending(own: str, side: str, out: str, ahead: str, across: str, turn: str, onward: str) -> Column:
        """The side of ``own`` that ends here; beyond it lies ``out``, before it ``ahead``, and ``across`` is the fourth cell."""
        crossing = same(across, own) if corners else same(across, own) & same(ahead, own)
        after = F.when(crossing, edge(across, onward)).when(same(ahead, own), edge(ahead, side)).otherwise(edge(own, turn))
        return F.when(F.col(own).isNotNull() & ~same(own, out), F.struct(
            edge(own, side).alias("node"), after.alias("next"), F.col(own).alias("region"), (F.col("i") + place[own][0]).alias("r"), (F.col("j") + place[own][1]).alias("c"), F.lit(_SIDES[side]).alias("side"), (~(same(ahead, own) & ~crossing)).alias("turn")))

    found = F.array(ending("sw", "top", "nw", "se", "ne", "right", "left"), ending("nw", "right", "ne", "sw", "se", "bottom", "top"),
                    ending("ne", "bottom", "se", "nw", "sw", "left", "right"), ending("se", "left", "sw", "ne", "nw", "top", "bottom"))
    return around.select("i", "j", F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e")).select("e.*", F.col("j").alias("x"), F.col("i").alias("y"))


def outlines(areas: DataFrame, corners: bool = True) -> DataFrame:
    """(region, ring, at, x, y, turn, dx, dy) of cells (r, c, region): the ends of all sides of each ring in order, and the way that each side goes. Points where ``turn`` is false lie on a straight line."""
    found = stored(sides(areas, corners)).withColumn("block", F.struct(F.floor(F.col("r") / BLOCK).alias("r"), F.floor(F.col("c") / BLOCK).alias("c")))
    order = ranked(found.select("node", "next", "block")).select("node", F.col("chain").alias("ring"), "at")
    step = lambda *by_side: F.element_at(F.array(*map(F.lit, by_side)), F.col("side") + 1)
    return found.join(order, "node").select("region", "ring", "at", "x", "y", "turn", step(1, 0, -1, 0).alias("dx"), step(0, 1, 0, -1).alias("dy"))


def ring_table(points: DataFrame) -> DataFrame:
    """(region, ring, shell, area, length, points) of outlines(): areas in cells, negative for holes; ``shell`` is the ring round the area that a hole lies in."""
    cross = (F.col("x") - F.col("dx")) * F.col("y") - F.col("x") * (F.col("y") - F.col("dy"))
    rings = points.groupBy("region", "ring").agg((F.sum(cross) / 2).alias("area"), F.count(F.lit(1)).alias("length"), F.count_if("turn").alias("points"))
    shells = rings.where("area > 0").select("region", F.col("ring").alias("shell"))  # the cells of an area hang together, so it has one
    return rings.join(shells, "region", "left").select("region", "ring", "shell", "area", "length", "points")


def polygons(rings: DataFrame) -> DataFrame:
    """(region, shell, holes, area, length) of ring_table(): one row for each area."""
    return rings.groupBy("region").agg(F.max("shell").alias("shell"), F.count_if(F.col("area") < 0).alias("holes"), F.sum("area").alias("area"), F.sum("length").alias("length"))


def contour_paths(cells: DataFrame, levels: list[float]) -> DataFrame:
    """(level, line, at, x, y, size, closed) of cells (r, c, z): the points of each contour in order, higher ground on the right; the first point of a closed one comes again at its end.

    A piece of a line ends on the side between two cell centres on which the next one begins, also where it goes through a centre.
    """
    pieces = marching_squares(cells, levels)
    number = F.array_position(F.array(*[F.lit(float(x)) for x in levels]), F.col("level")) - 1
    side = lambda name: F.struct("level", (F.col("r") + (F.col(name) == "bottom").cast("int")).alias("r"), (F.col("c") + (F.col(name) == "right").cast("int")).alias("c"), F.col(name).isin("top", "bottom").alias("flat"))
    pieces = pieces.withColumn("node", (((number * F.lit(1 << 25) + F.col("r")) * F.lit(1 << 25) + F.col("c")) * 2 + F.col("part")).cast("long")).withColumns({"begin": side("from"), "end": side("to")})
    links = pieces.join(pieces.select(F.col("begin").alias("end"), F.col("node").alias("next")), "end", "left")
    block = F.struct("level", F.floor(F.col("r") / BLOCK).alias("r"), F.floor(F.col("c") / BLOCK).alias("c"))
    placed = pieces.join(ranked(links.select("node", "next", block.alias("block"))), "node")
    ends = F.when(F.col("at") == 0, F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit(1).cast("long").alias("at"), F.col("x2").alias("x"), F.col("y2").alias("y"))))
    return placed.select("level", F.col("chain").alias("line"), "size", "closed", F.inline(ends.otherwise(F.array(F.struct((F.col("at") + 1).alias("at"), F.col("x2").alias("x"), F.col("y2").alias("y")))))).select("level", "line", "at", "x", "y", "size", "closed")
