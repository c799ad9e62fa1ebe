"""Movement cost, criterion scores, legends, zones: queries over the orders raster."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import legend, movement, scoring
from ..operators import raster, zonal
from .tables import CELL, DEM_SQL, NEAR_SQL, SLOPE_SQL, ZONES_SQL, dem, read, zones

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# Steps between neighbours; the model's elevations are scaled to metres that can be walked.
STEPS_SQL = DEM_SQL + """, st AS (SELECT a.r, a.c, i AS dr, j AS dc, 30 * sqrt(i * i + j * j) AS h, (b.z - a.z) / 20 AS dz
FROM dem a, (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) m(i, j), dem b WHERE b.r = a.r + i AND b.c = a.c + j)"""
COSTS = {
    "tobler": ("time", {}, "h / greatest(0.05, 6.0 * exp(-3.5 * abs(dz / h + 0.05)) / 3.6)"),
    "naismith": ("time", {}, "h * 0.72 + greatest(0, dz) * 6"),
    "pandolf": ("energy", {"load_kg": 20.0}, "greatest(105.0, 105.0 + 180.0 * pow(20.0 / 70.0, 2) + 90.0 * (1.5 * pow(5 / 3.6, 2) + 0.35 * (5 / 3.6) * (dz / h * 100))) * h / (5 / 3.6)"),
    "herzog": ("time", {}, "h / greatest(0.05, 5 / 3.6 * 1.64 / greatest(1e-9, 1337.8 * pow(s, 6) + 278.19 * pow(s, 5) - 517.39 * pow(s, 4) - 78.199 * pow(s, 3) + 93.419 * pow(s, 2) + 19.825 * s + 1.64))"),
    "conolly": ("time", {"ref_deg": 15.0}, "h / (5 / 3.6) * greatest(1, s / tan(radians(15.0)))"),
    "wheeled": ("time", {"max_deg": 20.0}, "CASE WHEN degrees(atan(s)) > 20 + 1e-9 THEN 'Infinity'::DOUBLE ELSE h / greatest(0.05, 4 / 3.6 / (1 + pow(s / tan(radians(12.0)), 2))) END"),
}


@F.pandas_udf(DoubleType())
def _pow2(x: pd.Series) -> pd.Series:
    """Squares as the C library's pow gives them, which SQL uses: fewer than one in a thousand is a last digit off x * x."""
    return pd.Series([math.nan if math.isnan(v) else math.pow(v, 2.0) for v in x], dtype="float64")


def _cost(model: str, mode: str, params: dict):
    def run(spark, sf_dir):
        # Climbs are scaled after they are taken, and costs rounded by way of whole numbers, as in the SQL: else some of millions round the other way.
        step = lambda **more: movement.step_cost(model, F.col("horizontal"), F.col("climb") / 20, mode, **params, **more)
        cost = step()
        if model == "wheeled":  # only costs beside a half of the last digit can tell one square from the other
            half = F.abs(cost * 1e8 - F.floor(cost * 1e8) - 0.5) < 1e-3
            cost = F.when(half, step(square=lambda x: _pow2(F.when(half, x)))).otherwise(cost)
        return raster.edges(dem(spark, sf_dir), CELL).select("r", "c", "dr", "dc", (F.round(cost * 1e8) / 1e8).alias("cost"))

    return run


for _m, (_mode, _p, _sql) in COSTS.items():
    query(f"WITH {STEPS_SQL}, k AS (SELECT *, abs(dz) / h AS s FROM st) SELECT r, c, dr, dc, round({_sql}, 8) AS cost FROM k", f"cost_{_m}")(_cost(_m, _mode, _p))


def _levels(spark, sf_dir, levels, per: float, out: str):
    """The levels that each row of the raster reaches, its heights taken as minutes or kcal."""
    tops = dem(spark, sf_dir).groupBy("r").agg((F.max("z") * per).alias("top"))
    most = tops.agg(F.coalesce(F.max("top"), F.lit(0.0))).first()[0]
    every = F.array(*[F.lit(float(x)) for x in levels(most)]).cast("array<double>")
    return tops.select("r", F.explode(F.filter(every, lambda x: x <= F.col("top") + 1e-6)).alias(out))


@query(f"WITH {DEM_SQL}, t AS (SELECT r, max(z) AS top FROM dem GROUP BY r), v AS (SELECT CAST(unnest([15, 30, 45]) AS DOUBLE) AS m UNION ALL SELECT CAST(unnest(range(60, 181, 30)) AS DOUBLE) UNION ALL SELECT CAST(unnest(range(240, 3000, 60)) AS DOUBLE)) SELECT r, m AS minutes FROM t JOIN v ON m <= top + 1e-6")
def isochrone_levels(spark, sf_dir):
    return _levels(spark, sf_dir, movement.isochrone_levels, 1.0, "minutes")


@query(f"WITH {DEM_SQL}, t AS (SELECT r, max(z) * 10 AS top FROM dem GROUP BY r), v AS (SELECT CAST(unnest(range(50, 601, 50)) AS DOUBLE) AS k UNION ALL SELECT CAST(unnest(range(800, 2001, 200)) AS DOUBLE) UNION ALL SELECT CAST(unnest(range(2500, 20000, 500)) AS DOUBLE)) SELECT r, k AS kcal FROM t JOIN v ON k <= top + 1e-6")
def isoenergy_levels(spark, sf_dir):
    return _levels(spark, sf_dir, movement.isoenergy_levels, 10.0, "kcal")


SCORES = {
    "benefit": ({"low": 50.0, "high": 400.0}, "greatest(0, least(1, (z - 50) / 350))"),
    "cost": ({"low": 50.0, "high": 400.0}, "greatest(0, least(1, (400 - z) / 350))"),
    "target": ({"low": 50.0, "high": 400.0, "target": 150.0}, "greatest(0, least(1, CASE WHEN z <= 150 THEN (z - 50) / 100 ELSE (400 - z) / 250 END))"),
    "range": ({"low": 50.0, "high": 400.0, "prefer": (120.0, 200.0)}, "greatest(0, least(1, CASE WHEN z < 120 THEN (z - 50) / 70 WHEN z > 200 THEN (400 - z) / 200 ELSE 1 END))"),
    "reclass": ({"low": 50.0, "high": 400.0, "ranges": [{"min": 0, "max": 100, "score": 0.2}, {"min": 250, "max": 100, "score": 0.9}, {"min": 250, "max": 600, "score": 1.4}]}, "CASE WHEN z >= 0 AND z < 100 THEN 0.2 WHEN z >= 100 AND z < 250 THEN 0.9 WHEN z >= 250 AND z <= 600 THEN 1 ELSE 0 END"),
}


def _score(mode: str, options: dict):
    def run(spark, sf_dir):
        return dem(spark, sf_dir).select("r", "c", F.round(scoring.score(F.col("z"), mode, **options), 9).alias("score"))

    return run


for _k, (_o, _sql) in SCORES.items():
    query(f"WITH {DEM_SQL} SELECT r, c, CAST(round({_sql}, 9) AS DOUBLE) AS score FROM dem", f"score_{_k}")(_score(_k, _o))

RGB = "CAST(o_orderkey * 37 % 256 AS INT) AS r, CAST(o_orderkey * 61 % 256 AS INT) AS g, CAST(o_orderkey * 101 % 256 AS INT) AS b"


def _segment(k: int) -> str:
    (v1, c1), (v2, c2) = legend.preset("fe2o3")[k : k + 2]
    d = [q - p for p, q in zip(c1, c2, strict=True)]
    t = f"greatest(0, least(1, ((r - {c1[0]}) * ({d[0]}) + (g - {c1[1]}) * ({d[1]}) + (b - {c1[2]}) * ({d[2]})) / {float(sum(x * x for x in d))}))"
    t = f"(CASE WHEN {t} > 0.7 THEN 1 ELSE {t} END)" if k == 9 else t
    return f"SELECT k, {k} AS seg, {v1} + t * ({v2 - v1}) AS value, pow(r - ({c1[0]} + t * ({d[0]})), 2) + pow(g - ({c1[1]} + t * ({d[1]})), 2) + pow(b - ({c1[2]} + t * ({d[2]})), 2) AS apart FROM (SELECT *, {t} AS t FROM px)"


@query(f"WITH px AS (SELECT o_orderkey AS k, {RGB} FROM orders), s AS ({' UNION ALL '.join(map(_segment, range(10)))}), m AS (SELECT k, arg_min(value, (round(apart, 6), seg)) AS value FROM s GROUP BY k) SELECT k AS pixel, round(value, 6) AS value FROM m")
def legend_invert(spark, sf_dir):
    px = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS pixel", *RGB.replace(" AS INT)", " AS INT)").split(", "))
    return px.select("pixel", F.round(legend.value_of_colour(F.col("r"), F.col("g"), F.col("b"), legend.preset("fe2o3"), 0.7), 6).alias("value"))


@query(f"SELECT k AS pixel, r < 75 AND g < 75 AND b < 75 AND abs(r - g) < 15 AND abs(g - b) < 15 AS linework FROM (SELECT o_orderkey AS k, {RGB} FROM orders)")
def linework_mask(spark, sf_dir):
    px = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS pixel", *RGB.split(", "))
    return px.select("pixel", legend.is_linework(F.col("r"), F.col("g"), F.col("b")).alias("linework"))


BREAKS = [0.0, 60.0, 120.0, 180.0, 240.0, 480.0]
BIN_SQL = "1 + (z >= 60)::INT + (z >= 120)::INT + (z >= 180)::INT + (z >= 240)::INT"


@query(f"WITH {DEM_SQL}, k AS (SELECT {BIN_SQL} AS class, z FROM dem) SELECT class, count(*) AS pix_n, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS std, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pix_pct, count(*) * 0.09::DOUBLE AS area_ha, ['0-60ppm','60-120ppm','120-180ppm','180-240ppm','240-480ppm'][class] AS label FROM k GROUP BY class")
def class_stats(spark, sf_dir):
    """Classes of values with statistics, share, area and label."""
    from pyspark.sql import Window

    k = zonal.class_stats(dem(spark, sf_dir).withColumn("class", legend.class_of(F.col("z"), BREAKS)))
    share = 100.0 * F.col("pix_n") / F.sum("pix_n").over(Window.partitionBy(F.lit(1)))  # one row a class
    label = F.element_at(F.array(*[F.lit(x) for x in legend.interval_labels(BREAKS, "ppm")]), F.col("class"))
    return k.select("class", "pix_n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(share, 6).alias("pix_pct"), (F.col("pix_n") * F.lit(0.09)).alias("area_ha"), label.alias("label"))


def _channel(k: int) -> str:
    pts = [(0.0, 204, 204, 204), (100.0, 0, 38, 115), (400.0, 230, 0, 0)]
    return f"CAST(CASE WHEN z <= 0 THEN 204 WHEN z <= 100 THEN round_even({pts[0][k]} + z / 100 * ({pts[1][k] - pts[0][k]}), 0) WHEN z <= 400 THEN round_even({pts[1][k]} + (z - 100) / 300 * ({pts[2][k] - pts[1][k]}), 0) ELSE {pts[2][k]} END AS INT) AS {'_rgb'[k]}"


@query(f"WITH dem AS (SELECT o_orderkey AS pixel, o_totalprice / 1000 AS z FROM orders) SELECT pixel, {_channel(1)}, {_channel(2)}, {_channel(3)} FROM dem")
def value_to_rgb(spark, sf_dir):
    pts = [(0.0, (204, 204, 204)), (100.0, (0, 38, 115)), (400.0, (230, 0, 0))]
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pixel"), legend.colour_of_value(F.col("o_totalprice") / 1000, pts).alias("k")).select("pixel", "k.*")


STRETCH_SQL = f"WITH {DEM_SQL}, m AS (SELECT max(z) AS top FROM dem) SELECT r, c, CASE WHEN z < 20 THEN NULL ELSE round(z * CASE WHEN top < 1363 THEN 1363 / top ELSE 1 END, 6) END AS z FROM dem, m"


@query(STRETCH_SQL)
def legend_stretch(spark, sf_dir):
    """Values under the second break lose their data; the rest are scaled so that the greatest meets the legend's last."""
    cells, top = dem(spark, sf_dir), legend.breaks(legend.preset("pb"))[-1]
    most = cells.agg(F.max("z").alias("top"))
    return cells.crossJoin(F.broadcast(most)).select("r", "c", F.when(F.col("z") >= 20, F.round(F.col("z") * F.when(F.col("top") < top, F.lit(top) / F.col("top")).otherwise(1.0), 6)).alias("z"))


@query(f"WITH {DEM_SQL}, {ZONES_SQL}, i AS (SELECT zone, CASE WHEN z >= 60 THEN z END AS z FROM zones JOIN dem ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1) SELECT zone, count(*) AS pix_in, count(z) AS pix_val, round(100.0 * count(z) / count(*), 6) AS cov_pct, round(avg(z), 9) AS mean, round(stddev_pop(z), 9) AS std, min(z) AS min, max(z) AS max FROM i GROUP BY zone")
def zonal_stats(spark, sf_dir):
    cells = dem(spark, sf_dir).withColumn("z", F.when(F.col("z") >= 60, F.col("z")))
    out = zonal.zonal_stats(cells, zonal.zone_cells(zones(spark, sf_dir)))
    return out.select("zone", "pix_in", "pix_val", F.round("cov_pct", 6).alias("cov_pct"), *[F.round(k, 9).alias(k) for k in ("mean", "std")], "min", "max")


@query(f"WITH {DEM_SQL}, {ZONES_SQL}, i AS (SELECT zone, {BIN_SQL} AS k FROM zones JOIN dem ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1) SELECT zone, {', '.join(f'count(*) FILTER (k = {k}) AS n_{k}, round(100.0 * count(*) FILTER (k = {k}) / count(*), 6) AS pct_{k}, count(*) FILTER (k = {k}) * 900.0::DOUBLE AS area_{k}' for k in range(1, 6))} FROM i GROUP BY zone")
def zonal_class_pivot(spark, sf_dir):
    cells = dem(spark, sf_dir).withColumn("class", legend.class_of(F.col("z"), BREAKS))
    out = zonal.zonal_classes(cells, zonal.zone_cells(zones(spark, sf_dir)), [1, 2, 3, 4, 5], 900.0)
    return out.select(*[F.round(k, 6).alias(k) if k.startswith("pct") else k for k in out.columns])


@query(f"WITH {DEM_SQL}, {ZONES_SQL}, i AS (SELECT brand, (z > 200)::INT AS v FROM zones JOIN dem ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1) SELECT brand, count(*) AS cells, CAST(sum(v) AS BIGINT) AS visible, round(100.0 * sum(v) / count(*), 6) AS pct FROM i GROUP BY ROLLUP (brand)")
def aoi_visible_rollup(spark, sf_dir):
    """Visible cells of each area and of all, in one pass."""
    inside = zonal.valued(dem(spark, sf_dir), zonal.zone_cells(zones(spark, sf_dir).withColumn("zone", F.col("brand"))))
    v = (F.col("z") > 200).cast("int")
    return inside.rollup(F.col("zone").alias("brand")).agg(F.count("*").alias("cells"), F.sum(v).alias("visible"), F.round(100.0 * F.sum(v) / F.count("*"), 6).alias("pct"))


WEIGHTS = {"value": "z", "power": "pow(z, 2)", "threshold": "CASE WHEN z >= 120 THEN z ELSE 0 END", "binary": "CASE WHEN z >= 120 THEN 1.0 ELSE 0 END"}


def _centre(rule: str):
    def run(spark, sf_dir):
        out = zonal.weighted_centre(dem(spark, sf_dir), rule, **({} if rule == "top_pct" else {"threshold": 120.0}))
        return out.select(*[F.round(k, 3).alias(k) for k in ("r", "c", "weight")])

    return run


for _k, _sql in WEIGHTS.items():
    query(f"WITH {DEM_SQL}, k AS (SELECT r, c, CAST({_sql} AS DOUBLE) AS w FROM dem) SELECT round(sum(w * r) / sum(w), 3) AS r, round(sum(w * c) / sum(w), 3) AS c, round(sum(w), 3) AS weight FROM k", f"weighted_centre_{_k}")(_centre(_k))
query(f"WITH {DEM_SQL}, p AS (SELECT quantile_cont(z, 0.9) AS q FROM dem) SELECT round(sum(z * r) / sum(z), 3) AS r, round(sum(z * c) / sum(z), 3) AS c, round(sum(z), 3) AS weight FROM dem, p WHERE z >= q", "weighted_centre_top_pct")(_centre("top_pct"))


@query(f"WITH {DEM_SQL} SELECT r, c, z FROM dem ORDER BY z DESC, r, c LIMIT 1")
def peak_centre(spark, sf_dir):
    return zonal.peak(dem(spark, sf_dir))


PARCELS = "SELECT p_partkey AS id, p_partkey * 37 % 991 AS xmin, p_partkey * 37 % 991 + 5 + p_size % 23 AS xmax, p_partkey * 53 % 983 AS ymin, p_partkey * 53 % 983 + 5 + p_size % 17 AS ymax FROM part"
AREAS = "SELECT n_nationkey AS id, n_nationkey * 41 % 900 AS xmin, n_nationkey * 41 % 900 + 130 AS xmax, n_nationkey * 67 % 900 AS ymin, n_nationkey * 67 % 900 + 110 AS ymax FROM nation"


@query(f"WITH a AS ({PARCELS}), b AS ({AREAS}), o AS (SELECT a.id AS a_id, b.id AS b_id, CAST((a.xmax - a.xmin) * (a.ymax - a.ymin) AS BIGINT) AS a_m2, CAST((least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS BIGINT) AS in_m2 FROM a JOIN b ON least(a.xmax, b.xmax) > greatest(a.xmin, b.xmin) AND least(a.ymax, b.ymax) > greatest(a.ymin, b.ymin)) SELECT *, round(100.0 * in_m2 / a_m2, 6) AS in_pct FROM o")
def parcel_overlap_by_aoi(spark, sf_dir):
    """Parcels inside each survey area."""
    a, b = (read(spark, sf_dir, t).selectExpr(*sql[7:].rsplit(" FROM ", 1)[0].split(", ")) for t, sql in (("part", PARCELS), ("nation", AREAS)))
    return zonal.overlay_rectangles(a, b, 64).select("a_id", "b_id", "a_m2", "in_m2", F.round("in_pct", 6).alias("in_pct"))


NEEDED = 3


@query(f"""WITH {NEAR_SQL}, k AS (SELECT r, c, z, {SLOPE_SQL} AS slope FROM nb) SELECT r, c,
round(100 * (0.5 * greatest(0, least(1, (z - 50) / 350)) + 0.3 * greatest(0, least(1, (85 - slope) / 85)) + 0.2 * greatest(0, least(1, CASE WHEN z <= 150 THEN (z - 50) / 100 ELSE (400 - z) / 250 END))), 6) AS suitability FROM k""")
def suitability_weighted(spark, sf_dir):
    """Weighted overlay of three criteria: one aggregation over all layers; a cell needs data in each."""
    cells = dem(spark, sf_dir)
    slopes = raster.neighbourhood(cells).select("r", "c", raster.slope(CELL).alias("z"))
    layers = [(cells, 0.5, "benefit", {"low": 50.0, "high": 400.0}), (slopes, 0.3, "cost", {"low": 0.0, "high": 85.0}), (cells, 0.2, "target", {"low": 50.0, "high": 400.0, "target": 150.0})]
    scored = [t.select("r", "c", (w * scoring.score(F.col("z"), mode, **o)).alias("s")) for t, w, mode, o in layers]
    stacked = scored[0].unionAll(scored[1]).unionAll(scored[2])
    return stacked.groupBy("r", "c").agg(F.sum("s").alias("s"), F.count("s").alias("n")).where(F.col("n") == NEEDED).select("r", "c", F.round(100 * F.col("s"), 6).alias("suitability"))
