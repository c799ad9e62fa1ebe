"""Whole runs put together from the operators: surfaces from drawings, aligned stacks, views from lines and outlines, tables to hand on."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import of_codes
from ..sources.files import drop_stage, publish, stage_folder
from ..sources.grid import Grid
from . import profile, raster, sampling, surfaces, triangulation, vector

METHODS = ("idw", "kriging", "tin")


def merged(layers: list[DataFrame]) -> DataFrame:
    """All rows of some layers; a field that one has not is null there."""
    out = layers[0]
    for t in layers[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def surface(layers: list[DataFrame], grid: Grid, method: str = "idw", codes=None, field: str = "Layer", seq: str = "id", **options) -> DataFrame:
    """(r, c, z): a raster from the heights (id, x, y, z) of some layers: merged, thinned to ``codes``, samples of one place averaged, then carried to the grid's cells."""
    if method not in METHODS:
        raise ValueError(f"no method {method}; there are {', '.join(METHODS)}")
    points = merged(layers)
    points = sampling.averaged(of_codes(points, codes, field) if codes else points, seq)
    place = F.struct(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))  # of equally near samples the western and southern ones count
    points = points.withColumn("id", F.xxhash64("x", "y") if method == "tin" else place)
    if method == "tin":
        return triangulation.linear_surface(points.select("id", "x", "y", "z"), grid).select("r", "c", "z")
    targets = grid.cells(points.sparkSession).select((F.col("r") * grid.width + F.col("c")).alias("id"), grid.x("c").alias("x"), grid.y("r").alias("y"))
    found = (surfaces.inverse_distance if method == "idw" else surfaces.kriging)(targets, points.select("id", "x", "y", "z"), **options)
    return found.select(F.expr(f"id DIV {grid.width}").alias("r"), (F.col("id") % grid.width).alias("c"), "z")


def aligned(layers: dict[str, tuple[DataFrame, Grid, str]], target: Grid) -> dict[str, DataFrame]:
    """Each layer (cells, grid, kind) on the target grid: classes by the nearest cell, measures between cells; a layer that is on it already stays."""
    return {k: cells if not grid.mismatches(target) else raster.resample(cells, grid, target, "nearest" if kind == "classes" else "bilinear") for k, (cells, grid, kind) in layers.items()}


def write_stack(layers: dict[str, tuple[DataFrame, Grid, str]], target: Grid, path: str, run: str) -> None:
    """All layers on one grid in one folder, with a manifest and the grid: all of it appears, or nothing. A layer without any cell on the grid is an error."""
    spark = next(iter(layers.values()))[0].sparkSession
    staged = stage_folder(spark, path.rstrip("/").rsplit("/", 1)[0], run, "stack")
    try:
        for name, cells in aligned(layers, target).items():
            inside = cells.select("r", "c", "z").where(target.inside("r", "c") & F.col("z").isNotNull())
            inside.write.parquet(f"{staged}/out/{name}")
            if spark.read.parquet(f"{staged}/out/{name}").isEmpty():
                raise ValueError(f"{name} has no cell on the grid")
        rows = [(name, name, kind, "nearest" if kind == "classes" else "bilinear") for name, (_, _, kind) in layers.items()]
        spark.createDataFrame(rows, "variable string, file string, kind string, resampling string").coalesce(1).write.option("header", True).csv(f"{staged}/out/manifest.csv")
        spark.createDataFrame([(json.dumps(asdict(target)),)], "value string").coalesce(1).write.text(f"{staged}/out/grid.json")
        publish(spark, f"{staged}/out", path)
    finally:
        drop_stage(spark, staged)


def observers_along(lines: DataFrame, step: float, grid: Grid, height: float = 1.6) -> DataFrame:
    """(obs, line, no, r, c, h): observers at most ``step`` apart along lines (id, x1, y1, x2, y2), numbered along each; those in one cell are one."""
    at = profile.densified(lines, step).select(F.col("id").alias("line"), "i", grid.row("y").cast("long").alias("r"), grid.col("x").cast("long").alias("c"))
    cells = at.groupBy("line", "r", "c").agg(F.min("i").alias("i"))
    no = F.row_number().over(Window.partitionBy("line").orderBy("i"))
    return cells.withColumn("no", no).select(F.concat_ws(":", "line", "no").alias("obs"), "line", "no", "r", "c", F.lit(height).alias("h"))


def outline_view(polygons: DataFrame, cells: DataFrame, grid: Grid, step: float, reach: int, cut_out: bool = False, height: float = 1.6) -> DataFrame:
    """(r, c, visible): what is seen from any point of the polygons' (id, ring) outlines; with ``cut_out`` without the cells that the polygons cover."""
    points = vector.boundary_points(polygons, step)
    o = points.select(grid.row("y").cast("long").alias("r"), grid.col("x").cast("long").alias("c")).distinct()
    seen = surfaces.viewsheds(cells, o.select(F.concat_ws(":", "r", "c").alias("obs"), "r", "c", F.lit(height).alias("h")), reach, grid.res)
    out = seen.groupBy("r", "c").agg(F.max("visible").alias("visible"))
    return out.join(vector.rasterized(polygons, grid, touched=True).select("r", "c").distinct(), ["r", "c"], "left_anti") if cut_out else out


def covariate_table(correlations: DataFrame, inflation: DataFrame) -> DataFrame:
    """(section, a, b, value) to hand on as text: variance inflation, then correlations, four digits; infinite is ``inf``, missing is blank."""
    text = lambda v: F.when(v.isNull() | F.isnan(v), "").when(F.abs(v) == float("inf"), "inf").otherwise(F.format_string("%.4f", v))
    first = inflation.select(F.lit("vif").alias("section"), F.col("column").alias("a"), F.lit("").alias("b"), text(F.col("vif")).alias("value"))
    return first.unionByName(correlations.select(F.lit("r").alias("section"), "a", "b", text(F.col("r")).alias("value")))


def profile_table(t: DataFrame, keys: list[str], distance: str, z: str, segment: float) -> DataFrame:
    """The samples of each profile to hand on: distance, height, slope and climbs so far to three digits, and the number of the stretch of ``segment`` metres."""
    out = profile.climbs(t, keys, distance, z)
    return out.select(*keys, *[F.round(F.col(c), 3).alias(c) for c in (distance, z, "slope_pct", "ascent", "descent")], F.floor(F.col(distance) / segment).alias("segment"))
