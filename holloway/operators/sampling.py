"""Samples of points, rasters and pictures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.grid import Grid


def averaged(t: DataFrame, seq: str, digits: int = 6) -> DataFrame:
    """(x, y, z, n): samples (x, y, z) whose places agree in ``digits`` digits are averaged; the last one's place stays."""
    valid = t.where("z IS NOT NULL AND NOT isnan(z)")
    last = F.max_by(F.struct("x", "y"), seq).alias("p")
    return valid.groupBy(F.round("x", digits).alias("u"), F.round("y", digits).alias("v")).agg(last, F.avg("z").alias("z"), F.count("*").alias("n")).select("p.x", "p.y", "z", "n")


def bar_colours(px: DataFrame, column: int, top: int, bottom: int, n: int) -> DataFrame:
    """(i, red, green, blue) at ``n`` places down a colour bar of a picture (r, c, red, green, blue), each the mean of the 3 x 3 pixels there."""
    spark = px.sparkSession
    places = spark.createDataFrame([(i, round(top + i * (bottom - top) / max(1, n - 1))) for i in range(n)], "i int, at int")
    near = places.select("i", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)).alias("r"))
    inside = px.where(F.col("c").between(column - 1, column + 1)).join(F.broadcast(near), "r")
    return inside.groupBy("i").agg(*[F.avg(k).alias(k) for k in ("red", "green", "blue")])


def even_grid(spark: SparkSession, xmin: float, xmax: float, ymin: float, ymax: float, target: int) -> DataFrame:
    """(id, x, y): about ``target`` points evenly over an extent, made on the executors."""
    aspect = (xmax - xmin) / (ymax - ymin) if ymax > ymin else 1.0
    ny = max(2, round(math.sqrt(max(1, target) / max(aspect, 1e-9))))
    nx = max(2, round(target / ny))
    i, j = F.col("id") % nx, F.floor(F.col("id") / nx)
    return spark.range(nx * ny).select("id", (F.lit(xmin) + (i + 0.5) * ((xmax - xmin) / nx)).alias("x"), (F.lit(ymin) + (j + 0.5) * ((ymax - ymin) / ny)).alias("y"))


def matrix(points: DataFrame, layers: dict[str, DataFrame], grid: Grid) -> DataFrame:
    """(id, one column a layer): the layers' cells (r, c, z) at points; only points where every layer has data.

    The layers are stacked and aggregated once, in place of a join for each.
    """
    at = points.select("id", grid.row("y").alias("r"), grid.col("x").alias("c"))
    stacked = None
    for name, cells in layers.items():
        part = cells.where("z IS NOT NULL").select("r", "c", F.lit(name).alias("layer"), F.col("z").cast("double").alias("z"))
        stacked = part if stacked is None else stacked.unionAll(part)
    found = at.join(stacked, ["r", "c"]).groupBy("id").agg(*[F.max(F.when(F.col("layer") == k, F.col("z"))).alias(k) for k in layers])
    return found.dropna(subset=list(layers))


def downslope(points: DataFrame, cells: DataFrame, cell: float, radius: float) -> DataFrame:
    """(id, bearing, coherence): the mean direction in which the ground falls at a point (x, y, rows southwards) and eight places round it, weighted
    by slope; ``cells`` have aspect and slope. The bearing is null where directions cancel out."""
    rose = [(0.0, 0.0)] + [(radius * math.cos(math.radians(45 * k)), radius * math.sin(math.radians(45 * k))) for k in range(8)]
    at = points.select("id", "x", "y", F.inline(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in rose])))
    at = at.select("id", F.floor(F.round((F.col("y") - F.col("dy")) / cell, 9)).alias("r"), F.floor(F.round((F.col("x") + F.col("dx")) / cell, 9)).alias("c"))
    near = at.join(cells.where("slope > 0 AND slope <= 90 AND aspect BETWEEN 0 AND 360"), ["r", "c"])
    a = F.radians("aspect")
    sums = near.groupBy("id").agg(F.sum(F.col("slope") * F.sin(a)).alias("e"), F.sum(F.col("slope") * F.cos(a)).alias("n"), F.sum("slope").alias("w"))
    size = F.hypot("e", "n")
    return sums.select("id", F.when(size > 1e-9, F.pmod(F.degrees(F.atan2("e", "n")), F.lit(360.0))).alias("bearing"), (size / F.col("w")).alias("coherence"))
