"""Rasters as cells (r, c, z): rows grow south, columns east; a cell without data has a null z.

Neighbourhoods come from two window passes (along rows, then along columns), so a raster is sorted twice and never
multiplied; a window's partition is one row or column of one raster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..sources.grid import Grid
from .components import components

NEIGHBOURS = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}


def neighbourhood(cells: DataFrame, value: str = "z", keys: tuple[str, ...] = ()) -> DataFrame:
    """``cells`` with the eight neighbours' values (nw, n, ne, w, e, sw, s, se); null where there is no cell or no data.

    ``keys`` tell rasters apart. A neighbour in another row is found through the cell above or below, so rasters
    should have all their cells, those without data as null.
    """
    across = Window.partitionBy(*keys, "r").orderBy("c")
    west = F.when(F.lag("c").over(across) == F.col("c") - 1, F.lag(value).over(across))
    east = F.when(F.lead("c").over(across) == F.col("c") + 1, F.lead(value).over(across))
    lines = cells.withColumns({"w": west, "e": east}).withColumn("__line", F.struct("w", F.col(value).alias("m"), "e"))
    down = Window.partitionBy(*keys, "c").orderBy("r")
    above = F.when(F.lag("r").over(down) == F.col("r") - 1, F.lag("__line").over(down))
    below = F.when(F.lead("r").over(down) == F.col("r") + 1, F.lead("__line").over(down))
    both = lines.withColumns({"__a": above, "__b": below})
    return both.withColumns({"nw": F.col("__a.w"), "n": F.col("__a.m"), "ne": F.col("__a.e"), "sw": F.col("__b.w"), "s": F.col("__b.m"), "se": F.col("__b.e")}).drop("__line", "__a", "__b")


def _all(value: str = "z") -> Column:
    """Whether a cell and its eight neighbours have data."""
    out = F.col(value).isNotNull()
    for k in NEIGHBOURS:
        out = out & F.col(k).isNotNull()
    return out


def _gradient(cell: float) -> tuple[Column, Column]:
    """Horn's slopes eastwards and southwards."""
    c = F.col
    east = ((c("ne") + 2 * c("e") + c("se")) - (c("nw") + 2 * c("w") + c("sw"))) / (8 * cell)
    south = ((c("sw") + 2 * c("s") + c("se")) - (c("nw") + 2 * c("n") + c("ne"))) / (8 * cell)
    return east, south


def slope(cell: float) -> Column:
    """Slope in degrees (Horn) of a neighbourhood."""
    east, south = _gradient(cell)
    return F.when(_all(), F.degrees(F.atan(F.sqrt(east * east + south * south))))


def aspect(cell: float) -> Column:
    """The direction that a neighbourhood faces, in degrees clockwise from north; flat ones are 0."""
    east, south = _gradient(cell)
    facing = F.degrees(F.atan2(south, -east))
    turned = F.when(facing > 90, F.lit(450.0) - facing).otherwise(F.lit(90.0) - facing)
    return F.when(_all(), F.when((east == 0) & (south == 0), F.lit(0.0)).when(turned == 360, F.lit(0.0)).otherwise(turned))


def ruggedness() -> Column:
    """Riley's index: the root of the summed squared differences from the neighbours."""
    return F.when(_all(), F.sqrt(sum((F.col(k) - F.col("z")) * (F.col(k) - F.col("z")) for k in NEIGHBOURS)))


def position_index() -> Column:
    """Elevation above the mean of the eight neighbours."""
    return F.when(_all(), F.col("z") - sum(F.col(k) for k in NEIGHBOURS) / 8)


def roughness() -> Column:
    names = ["z", *NEIGHBOURS]
    return F.when(_all(), F.greatest(*names) - F.least(*names))


def curvature(cell: float) -> dict[str, Column]:
    """Zevenbergen-Thorne profile and plan curvature; 0 on flat ground."""
    c, area = F.col, cell * cell
    d, e = ((c("w") + c("e")) / 2 - c("z")) / area, ((c("n") + c("s")) / 2 - c("z")) / area
    f = (c("ne") + c("sw") - c("nw") - c("se")) / (4 * area)
    g, h = (c("e") - c("w")) / (2 * cell), (c("n") - c("s")) / (2 * cell)
    steep = g * g + h * h
    flat = steep < 1e-12
    profile = 2 * (d * g * g + e * h * h + f * g * h) / F.when(flat, 1.0).otherwise(steep)
    plan = -2 * (d * h * h + e * g * g - f * g * h) / F.when(flat, 1.0).otherwise(steep)
    return {"profile": F.when(_all(), F.when(flat, 0.0).otherwise(profile)), "plan": F.when(_all(), F.when(flat, 0.0).otherwise(plan))}


def facing(aspect_deg: Column, slope_deg: Column) -> dict[str, Column]:
    """Northness, eastness and a solar radiation index of an aspect; flat ground is 0, 0 and one half."""
    flat, a = slope_deg == 0, F.radians(aspect_deg)
    return {"northness": F.when(flat, 0.0).otherwise(F.cos(a)), "eastness": F.when(flat, 0.0).otherwise(F.sin(a)),
            "trasp": F.when(flat, 0.5).otherwise((1 - F.cos(F.radians(aspect_deg - 30))) / 2)}


def hillshade(slope_deg: Column, aspect_deg: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """0 to 255 by the light from an azimuth and altitude."""
    import math

    zenith, s = math.radians(90 - altitude), F.radians(slope_deg)
    light = math.cos(zenith) * F.cos(s) + math.sin(zenith) * F.sin(s) * F.cos(F.radians(F.lit(azimuth) - aspect_deg))
    return F.greatest(F.lit(0.0), light * 255)


# Sampling and resampling


def sample_nearest(points: DataFrame, cells: DataFrame, grid: Grid, value: str = "z") -> DataFrame:
    """``points`` (x, y, ...) with the value of the cell that each is in; null outside and without data."""
    at = points.withColumns({"r": grid.row("y"), "c": grid.col("x")})
    return at.join(cells.select("r", "c", F.col(value).alias("__v")), ["r", "c"], "left").drop("r", "c").withColumnRenamed("__v", value)


def sample_bilinear(points: DataFrame, cells: DataFrame, grid: Grid, key: str = "id", value: str = "z") -> DataFrame:
    """(key, value) between the four cell centres round each point; the nearest cell's value if any of them has none.

    Each point becomes four rows, joined on (r, c) and summed again: one shuffle for the join, one for the sum.
    """
    fr, fc = (F.lit(grid.ymax) - F.col("y")) / grid.res - 0.5, (F.col("x") - grid.xmin) / grid.res - 0.5
    at = points.select(key, F.floor(fr).alias("r0"), F.floor(fc).alias("c0"), (fr - F.floor(fr)).alias("v"), (fc - F.floor(fc)).alias("u"))
    corners = F.array(*[F.struct((F.col("r0") + i).alias("r"), (F.col("c0") + j).alias("c"),
                                 ((F.col("v") if i else 1 - F.col("v")) * (F.col("u") if j else 1 - F.col("u"))).alias("w"),
                                 (((F.col("v") >= 0.5) == bool(i)) & ((F.col("u") >= 0.5) == bool(j))).alias("near")) for i in (0, 1) for j in (0, 1)])
    four = at.select(key, F.inline(corners)).join(cells.select("r", "c", F.col(value).alias("z")), ["r", "c"], "left")
    return four.groupBy(key).agg(F.when(F.count("z") == 4, F.sum(F.col("w") * F.col("z"))).otherwise(F.max(F.when(F.col("near"), F.col("z")))).alias(value))


def resample(cells: DataFrame, source: Grid, target: Grid, method: str = "bilinear") -> DataFrame:
    """The cells of ``target``: nearest (classes), bilinear (measures) or average (mean of the centres that fall in)."""
    if method == "average":
        x, y = source.x("c"), source.y("r")
        return (cells.select(x.alias("x"), y.alias("y"), "z").select(target.row("y").alias("r"), target.col("x").alias("c"), "z")
                .where(target.inside("r", "c")).groupBy("r", "c").agg(F.avg("z").alias("z")))
    centres = target.cells(cells.sparkSession).select("r", "c", target.x("c").alias("x"), target.y("r").alias("y"))
    if method == "nearest":
        return centres.select(F.col("r").alias("tr"), F.col("c").alias("tc"), source.row("y").alias("r"), source.col("x").alias("c")).join(cells, ["r", "c"]).select(F.col("tr").alias("r"), F.col("tc").alias("c"), "z")
    named = centres.withColumn("id", F.struct("r", "c"))
    return sample_bilinear(named, cells, source).where("z IS NOT NULL").select("id.r", "id.c", "z")


def position_index_wide(cells: DataFrame, grid: Grid, radius: int = 3) -> DataFrame:
    """(r, c, z, tpi): elevation above the bilinear surface through means of radius x radius blocks."""
    blocks = Grid(grid.xmin, grid.ymax, grid.res * radius, -(-grid.width // radius), -(-grid.height // radius))
    means = cells.groupBy(F.floor(F.col("r") / radius).alias("r"), F.floor(F.col("c") / radius).alias("c")).agg(F.avg("z").alias("z"))
    points = cells.select(F.struct("r", "c").alias("id"), grid.x("c").alias("x"), grid.y("r").alias("y"))
    smooth = sample_bilinear(points, means, blocks).select("id.r", "id.c", F.col("z").alias("m"))
    return cells.join(smooth, ["r", "c"]).select("r", "c", "z", (F.col("z") - F.col("m")).alias("tpi"))


def fill(cells: DataFrame, reach: int) -> DataFrame:
    """``cells`` with nulls filled from cells within ``reach``, weighted by the inverse squared distance."""
    around = [(i, j, float(i * i + j * j)) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if 0 < i * i + j * j <= reach * reach]
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(d).alias("d2")) for i, j, d in around])
    holes = cells.where("z IS NULL").select(F.col("r").alias("hr"), F.col("c").alias("hc"), F.inline(near))
    holes = holes.withColumns({"r": F.col("hr") + F.col("i"), "c": F.col("hc") + F.col("j")})
    found = holes.join(cells.where("z IS NOT NULL"), ["r", "c"]).groupBy(F.col("hr").alias("r"), F.col("hc").alias("c")).agg((F.sum(F.col("z") / F.col("d2")) / F.sum(1 / F.col("d2"))).alias("filled"))
    return cells.join(found, ["r", "c"], "left").select("r", "c", F.coalesce("z", "filled").alias("z"))


def keep(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells that are in the mask."""
    return cells.join(mask.select("r", "c").distinct(), ["r", "c"], "left_semi")


def burn(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """All cells; those in the mask lose their data."""
    out = mask.select("r", "c", F.lit(True).alias("__m")).distinct()
    return cells.join(out, ["r", "c"], "left").withColumn("z", F.when(F.col("__m").isNull(), F.col("z"))).drop("__m")


def edges(cells: DataFrame, cell: float, diagonal: bool = True) -> DataFrame:
    """Steps (r, c, dr, dc, horizontal, climb) from each cell to its neighbours with data."""
    steps = [F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc"), F.lit(cell * (i * i + j * j) ** 0.5).alias("horizontal"), (F.col(k) - F.col("z")).alias("climb"))
             for k, (i, j) in NEIGHBOURS.items() if diagonal or not (i and j)]
    return neighbourhood(cells).select("r", "c", F.inline(F.array(*steps))).where("climb IS NOT NULL")


def marching_squares(cells: DataFrame, levels: list[float]) -> DataFrame:
    """Contour segments (level, r, c, part, x1, y1, x2, y2, from, to) in cell units: a row for each piece of line between four cell centres, and the sides on which it begins and ends.

    A square of four centres is crossed on the sides whose ends lie on different sides of the level; a saddle is
    split by the mean of its corners. The higher ground is on the right of each piece.
    """
    a = Window.partitionBy("r").orderBy("c")
    pairs = cells.withColumn("e", F.when(F.lead("c").over(a) == F.col("c") + 1, F.lead("z").over(a)))
    b = Window.partitionBy("c").orderBy("r")
    squares = pairs.withColumns({k: F.when(F.lead("r").over(b) == F.col("r") + 1, F.lead(v).over(b)) for k, v in (("s", "z"), ("se", "e"))}).where("z IS NOT NULL AND e IS NOT NULL AND s IS NOT NULL AND se IS NOT NULL")
    at = squares.select("*", F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level")).where("level > least(z, e, s, se) AND level <= greatest(z, e, s, se)")
    cross = lambda p, q: (F.col("level") - F.col(p)) / (F.col(q) - F.col(p))
    point = {"top": F.struct((F.col("c") + cross("z", "e")).alias("x"), F.col("r").cast("double").alias("y")), "right": F.struct((F.col("c") + 1).cast("double").alias("x"), (F.col("r") + cross("e", "se")).alias("y")),
             "bottom": F.struct((F.col("c") + cross("s", "se")).alias("x"), (F.col("r") + 1).cast("double").alias("y")), "left": F.struct(F.col("c").cast("double").alias("x"), (F.col("r") + cross("z", "s")).alias("y"))}
    code = sum(F.when(F.col(k) >= F.col("level"), v).otherwise(0) for k, v in (("z", 8), ("e", 4), ("se", 2), ("s", 1)))
    line = lambda *names: F.array(*[F.struct(point[p].alias("a"), point[q].alias("b"), F.lit(p).alias("from"), F.lit(q).alias("to")) for p, q in names])
    middle = (F.col("z") + F.col("e") + F.col("s") + F.col("se")) / 4 >= F.col("level")
    table = {1: ("left", "bottom"), 2: ("bottom", "right"), 3: ("left", "right"), 4: ("right", "top"), 6: ("bottom", "top"), 7: ("left", "top")}
    lines = F.when(F.col("code") == 5, F.when(middle, line(("left", "top"), ("right", "bottom"))).otherwise(line(("left", "bottom"), ("right", "top"))))
    lines = lines.when(F.col("code") == 10, F.when(middle, line(("bottom", "left"), ("top", "right"))).otherwise(line(("top", "left"), ("bottom", "right"))))
    for k, (p, q) in table.items():
        lines = lines.when(F.col("code") == k, line((p, q))).when(F.col("code") == 15 - k, line((q, p)))
    return at.withColumn("code", code).select("level", "r", "c", F.posexplode(lines).alias("part", "s")).select("level", "r", "c", "part", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"), "s.from", "s.to")


def contour_lines(segments: DataFrame) -> DataFrame:
    """``segments`` of marching_squares() with ``line`` (the same for pieces that hang together), ``closed`` and ``length`` (in cells) of it.

    A line crosses each side of a square of centres once, so a side names the point; pieces are joined by links between their two sides.
    """
    # The side of a point: where x is whole it is the side below (x, floor y), else the one to the right of (floor x, y).
    name = lambda x, y: F.xxhash64(F.col("level"), F.floor(F.col(x)), F.floor(F.col(y)), F.col(x) == F.floor(F.col(x)), F.col(y) == F.floor(F.col(y)))
    ends = cut(segments.withColumns({"a": name("x1", "y1"), "b": name("x2", "y2")}))
    # Points that fall on a centre belong to several sides: such pieces are joined by the point itself.
    roots = components(ends.select("a", "b"))
    named = ends.join(roots, F.col("a") == F.col("node"), "left").withColumn("line", F.coalesce("root", "a"))
    single = named.select("line", F.explode(F.array("a", "b")).alias("p")).groupBy("line", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("line").agg(F.min("n").alias("least"))
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    whole = named.groupBy("line").agg(F.sum(size).alias("length"), F.count(F.lit(1)).alias("pieces")).join(single, "line")
    return named.join(whole, "line").select("level", "line", "r", "c", "part", "x1", "y1", "x2", "y2", "length", "pieces", (F.col("least") > 1).alias("closed"))
