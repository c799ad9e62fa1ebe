"""Polygons, regions and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geodesy, legend
from ..operators import outlines, overlays, report, vector
from ..sources.grid import Grid
from .rings import outlined, quads_sql
from .tables import CELL, DEM_SQL, SITES_SQL, WIDTH, XMIN, YMAX, dem, read, sites

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def trenches(spark, sf_dir):
    """A trench of 20 m by 2 m and more round each part's place, turned by its size."""
    t = read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "200000 + p_partkey * 37 % 2900 AS x", "599900 - p_partkey * 53 % 400 AS y", "p_size * 7.0D AS bearing")
    return t.select("id", "x", "y", vector.rectangle(F.col("x"), F.col("y"), 120.0, 45.0, F.col("bearing")).alias("ring"))


@query("SELECT p_partkey AS id, 5400.0::DOUBLE AS area, 330.0::DOUBLE AS perimeter, CAST(200000 + p_partkey * 37 % 2900 AS DOUBLE) AS cx, CAST(599900 - p_partkey * 53 % 400 AS DOUBLE) AS cy FROM part")
def polygon_measures(spark, sf_dir):
    t = trenches(spark, sf_dir).select("id", vector.area(F.col("ring")).alias("area"), vector.perimeter(F.col("ring")).alias("perimeter"), vector.centroid(F.col("ring")).alias("k"))
    return t.select("id", F.round("area", 3).alias("area"), F.round("perimeter", 3).alias("perimeter"), F.round("k.x", 3).alias("cx"), F.round("k.y", 3).alias("cy"))


@query("WITH t AS (SELECT p_partkey AS id, 200000 + p_partkey * 37 % 2900 AS x, 599900 - p_partkey * 53 % 400 AS y, radians(p_size * 7.0::DOUBLE) AS b FROM part), k AS (SELECT id, r, c, 200000 + (c + 0.5) * 30 - x AS dx, 600000 - (r + 0.5) * 30 - y AS dy, b FROM t, range(0, 20) q(r), range(0, 100) w(c) WHERE abs(200000 + (c + 0.5) * 30 - x) < 70 AND abs(600000 - (r + 0.5) * 30 - y) < 70) "
       "SELECT id, count(*) AS cells, min(r) AS r0, max(c) AS c1 FROM k WHERE abs(dx * sin(b) + dy * cos(b)) < 60 AND abs(dx * cos(b) - dy * sin(b)) < 22.5 GROUP BY id")
def polygon_cells(spark, sf_dir):
    """Cells whose centre is inside each trench."""
    inside = vector.rasterized(trenches(spark, sf_dir), Grid(XMIN, YMAX, CELL, WIDTH, 20))
    return inside.groupBy("id").agg(F.count("*").alias("cells"), F.min("r").alias("r0"), F.max("c").alias("c1"))


RING_SQL = """t AS (SELECT p_partkey AS id, 200000 + p_partkey * 37 % 2900 AS x, 599900 - p_partkey * 53 % 400 AS y, sin(radians(p_size * 7.0::DOUBLE)) AS dx, cos(radians(p_size * 7.0::DOUBLE)) AS dy FROM part),
v AS (SELECT 0 AS side, id, k, x + dx * (i * 60) + dy * (j * 22.5) AS x, y + dy * (i * 60) - dx * (j * 22.5) AS y FROM t, (VALUES (0, 1, 1), (1, -1, 1), (2, -1, -1), (3, 1, -1)) w(k, i, j)
  UNION ALL SELECT 1, s_suppkey, k, 200000.0 + s_suppkey * 41 % 2900 + i, 599500.0 + s_suppkey * 59 % 380 + j FROM supplier, (VALUES (0, 0, 0), (1, 90, 0), (2, 90, 80), (3, 45, 20), (4, 0, 80)) w(k, i, j)),
e AS (SELECT side, id, x - 200000 AS x, y - 599000 AS y, coalesce(lead(x) OVER w, first(x) OVER w) - 200000 AS qx, coalesce(lead(y) OVER w, first(y) OVER w) - 599000 AS qy FROM v WINDOW w AS (PARTITION BY side, id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
m AS (SELECT a.id AS a, b.id AS b, sign(a.qx - a.x) * sign(b.qx - b.x) AS s, greatest(least(a.x, a.qx), least(b.x, b.qx)) AS lo, least(greatest(a.x, a.qx), greatest(b.x, b.qx)) AS hi,
  a.x AS ax, a.y AS ay, (a.qy - a.y) / (a.qx - a.x) AS fs, b.x AS bx, b.y AS by_, (b.qy - b.y) / (b.qx - b.x) AS gs
  FROM e a JOIN e b ON a.side = 0 AND b.side = 1 AND a.x <> a.qx AND b.x <> b.qx AND greatest(least(a.x, a.qx), least(b.x, b.qx)) < least(greatest(a.x, a.qx), greatest(b.x, b.qx))),
h AS (SELECT *, ay + fs * (lo - ax) AS f0, ay + fs * (hi - ax) AS f1, by_ + gs * (lo - bx) AS g0, by_ + gs * (hi - bx) AS g1 FROM m WHERE hi > lo),
q AS (SELECT a, b, abs(sum(s * (hi - lo) * (f0 + f1 + g0 + g1 - CASE WHEN (f0 - g0) * (f1 - g1) >= 0 THEN abs(f0 - g0 + f1 - g1) ELSE ((f0 - g0) ** 2 + (f1 - g1) ** 2) / (abs(f0 - g0) + abs(f1 - g1)) END) / 4)) AS shared FROM h GROUP BY a, b)"""


def pits(spark, sf_dir):
    """Five-sided areas, one corner of which points inwards: one for each supplier."""
    s = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "200000.0D + s_suppkey * 41 % 2900 AS x", "599500.0D + s_suppkey * 59 % 380 AS y")
    corner = lambda i, j: F.struct((F.col("x") + float(i)).alias("x"), (F.col("y") + float(j)).alias("y"))
    return s.select("id", F.array(corner(0, 0), corner(90, 0), corner(90, 80), corner(45, 20), corner(0, 80)).alias("ring"))


@query(f"WITH {RING_SQL} SELECT a, b, round(shared, 2) AS shared, round(5400 - shared, 2) AS outside FROM q WHERE shared > 0.01")
def polygon_overlay(spark, sf_dir):
    """Area that each trench shares with each pit, and what is left of it."""
    found = vector.overlay(trenches(spark, sf_dir), pits(spark, sf_dir)).where("shared > 0.01")
    return found.select("a", "b", F.round("shared", 2).alias("shared"), F.round("outside", 2).alias("outside"))


@query(f"WITH {RING_SQL} SELECT a, b, round(shared, 2) AS shared FROM q WHERE shared > 0.01")
def overlay_outlines(spark, sf_dir):
    """The ground that each trench shares with each pit as outlines, and its area."""
    return overlays.overlay_measures(trenches(spark, sf_dir), pits(spark, sf_dir)).where("area > 0.01").select("a", "b", F.round("area", 2).alias("shared"))


@query(f"WITH {RING_SQL} SELECT a, b, round(5400 - shared, 2) AS outside FROM q WHERE shared > 0.01")
def difference_outlines(spark, sf_dir):
    """What each pit leaves of each trench that it meets, as outlines, and its area."""
    return overlays.overlay_measures(trenches(spark, sf_dir), pits(spark, sf_dir), "difference").where("area < 5400 - 0.01").select("a", "b", F.round("area", 2).alias("outside"))


@query("SELECT p_partkey AS id, 1::BIGINT AS rings, 36::BIGINT AS points, round(5400 + 330 * 30 + 4 * 8 * 450 * sin(pi() / 16), 3) AS area FROM part")
def trench_buffers(spark, sf_dir):
    """The ground within 30 m of each trench."""
    rings = overlays.ring_areas(overlays.buffered(trenches(spark, sf_dir).select("id", "ring"), 30.0))
    return rings.groupBy(F.col("key").alias("id")).agg(F.count(F.lit(1)).alias("rings"), F.sum("points").alias("points"), F.round(F.sum("area"), 3).alias("area"))


_AREA_SQL = "(1 - ee) * (sin(radians({0})) / (1 - ee * sin(radians({0})) ** 2) + ln((1 + sqrt(ee) * sin(radians({0}))) / (1 - sqrt(ee) * sin(radians({0})))) / (2 * sqrt(ee)))"
_ARC_SQL = "6378137.0 / (1 + n) * ((1 + n ** 2 / 4 + n ** 4 / 64) * radians({0}) - 1.5 * (n - n ** 3 / 8) * sin(2 * radians({0})) + 15.0 / 16 * (n ** 2 - n ** 4 / 4) * sin(4 * radians({0})) - 35.0 / 48 * n ** 3 * sin(6 * radians({0})) + 315.0 / 512 * n ** 4 * sin(8 * radians({0})))"


@query(f"WITH f AS (SELECT 1 / 298.257223563 AS f), k AS (SELECT f * (2 - f) AS ee, f / (2 - f) AS n FROM f), p AS (SELECT p_partkey AS id, 126 + p_partkey % 300 / 100.0::DOUBLE AS x, 33 + p_size / 10.0::DOUBLE AS y, (1 + p_size % 5) / 100.0::DOUBLE AS w, 0.02::DOUBLE AS h FROM part) "
       f"SELECT id, round(6378137.0 ** 2 / 2 * radians(w) * ({_AREA_SQL.format('(y + h)')} - {_AREA_SQL.format('y')}), 3) AS area_m2, round({_ARC_SQL.format('(y + h)')} - {_ARC_SQL.format('y')}, 3) AS height_m FROM p, k")
def lonlat_measures(spark, sf_dir):
    """Areas and heights of plots in degrees, on the ellipsoid."""
    t = read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "126 + p_partkey % 300 / 100.0D AS x", "33 + p_size / 10.0D AS y", "(1 + p_size % 5) / 100.0D AS w", "0.02D AS h")
    corner = lambda i, j: F.struct((F.col("x") + i * F.col("w")).alias("x"), (F.col("y") + j * F.col("h")).alias("y"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    return t.select("id", F.round(geodesy.area(ring), 3).alias("area_m2"), F.round(geodesy.length(F.col("x"), F.col("y"), F.col("x"), F.col("y") + F.col("h")), 3).alias("height_m"))


@query()
def united_pits(spark, sf_dir):
    """The outlines of all pits of a nation together; tested against counted cells."""
    nation = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS key")
    return overlays.united(pits(spark, sf_dir).join(nation, "id"))


@query()
def class_regions(spark, sf_dir):
    """Connected areas of equal class; tested against a flood fill (SQL takes minutes for the whole raster)."""
    cells = dem(spark, sf_dir).withColumn("class", legend.class_of(F.col("z"), [0.0, 120.0, 240.0, 480.0]))
    return vector.regions(cells.select("r", "c", "class"), WIDTH).withColumn("area_ha", F.round(F.col("cells") * F.lit(0.09), 6))


def _classes(spark, sf_dir):
    return dem(spark, sf_dir).select("r", "c", legend.class_of(F.col("z"), [0.0, 120.0, 240.0, 480.0]).alias("class"))


@query(f"WITH {DEM_SQL}, k AS (SELECT r, c, 1 + (z >= 120)::INT + (z >= 240)::INT AS class FROM dem), {quads_sql('k', 'n')}, t AS (SELECT class, count(*) AS cells FROM k GROUP BY class) "
       "SELECT class, CAST((one - three - 2 * opposite) / 4 AS BIGINT) AS shells_less_holes, cells, one + two + three + 2 * opposite AS sides, one + three + 2 * opposite AS points FROM n JOIN t USING (class)")
def region_outlines(spark, sf_dir):
    """Outlines of the areas of each class, with holes; cells that touch at a corner hang together. The rings themselves are tested against a tracer."""
    return outlined(_classes(spark, sf_dir), True)


@query()
def region_rings(spark, sf_dir):
    """The points of every ring, in order; tested against a tracer."""
    return outlines.outlines(vector.labelled_regions(_classes(spark, sf_dir), WIDTH)).where("turn").select("region", "ring", "at", "x", "y")


@query(f"WITH {DEM_SQL}, k AS (SELECT r, c, 1 AS class FROM dem WHERE z BETWEEN 150 AND 320), {quads_sql('k', 'n')} SELECT class, CAST((one - three + 2 * opposite) / 4 AS BIGINT) AS shells_less_holes, (SELECT count(*) FROM k) AS cells, one + two + three + 2 * opposite AS sides, one + three + 2 * opposite AS points FROM n")
def mask_outlines(spark, sf_dir):
    """Outlines of a mask, as of a corridor: only cells with a side in common hang together."""
    return outlined(dem(spark, sf_dir).select("r", "c", F.when(F.col("z").between(150, 320), 1).alias("class")), False)


@query(f"""WITH {SITES_SQL}, p AS (SELECT CASE WHEN id < 1000000 THEN 'suppliers' ELSE 'customers' END AS layer, sqrt((x - 500) ** 2 + (y - 480) ** 2) AS m, z FROM sites)
SELECT layer, count(*) AS features, count(*) FILTER (m <= 250) AS inside, round(min(m), 6) AS nearest, round(avg(m) FILTER (m <= 250), 6) AS mean, min(z) FILTER (m <= 250) AS z_min, max(z) FILTER (m <= 250) AS z_max, round(avg(z) FILTER (m <= 250), 6) AS z_mean FROM p GROUP BY layer""")
def aoi_report(spark, sf_dir):
    return _report(spark, sf_dir).select("layer", "features", "inside", F.round("nearest", 6).alias("nearest"), F.round("mean", 6).alias("mean"), "z_min", "z_max", F.round("z_mean", 6).alias("z_mean"))


def _report(spark, sf_dir):
    s = sites(spark, sf_dir)
    return report.layer_report({"suppliers": s.where("id < 1000000"), "customers": s.where("id >= 1000000")}, 500.0, 480.0, 250.0)


@query(f"""WITH {SITES_SQL}, p AS (SELECT CASE WHEN id < 1000000 THEN 'suppliers' ELSE 'customers' END AS layer, sqrt((x - 500) ** 2 + (y - 480) ** 2) AS m, ['N','NE','E','SE','S','SW','W','NW'][CAST(floor(((degrees(atan2(x - 500, y - 480)) + 360) % 360 + 22.5) / 45) AS INT) % 8 + 1] AS way FROM sites),
t AS (SELECT layer, count(*) AS features, count(*) FILTER (m <= 250) AS inside, min(m) AS nearest FROM p GROUP BY layer),
w AS (SELECT layer, way FROM p WHERE m <= 250 GROUP BY layer, way QUALIFY row_number() OVER (PARTITION BY layer ORDER BY count(*) DESC, way) = 1),
f AS (SELECT *, CASE WHEN nearest <= 0.5 THEN 'touching' WHEN nearest < 1000 THEN printf('%.0f m', nearest) ELSE printf('%.1f km', nearest / 1000) END AS phrase FROM t LEFT JOIN w USING (layer))
SELECT layer, CASE WHEN inside > 0 THEN layer || ': ' || inside || ' of ' || features || ' inside, mostly ' || way || '; the nearest ' || phrase || '.' ELSE layer || ': none inside; the nearest ' || phrase || '.' END AS sentence FROM f""")
def aoi_sentences(spark, sf_dir):
    return report.sentences(_report(spark, sf_dir))
