"""Terrain queries over the elevation model of the orders table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes
from ..operators import outlines, raster
from ..sources.grid import Grid
from .rings import outlined, quads_sql
from .tables import CELL, DEM_SQL, NEAR_SQL, SLOPE_SQL, WIDTH, XMIN, YMAX, dem, dem_grid

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.neighbourhood(dem(spark, sf_dir))


def measured(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    """(r, c, ...) of the cells with all neighbours, rounded."""
    out = near(spark, sf_dir).withColumns(columns).dropna(subset=list(columns))
    return out.select("r", "c", *[F.round(k, 9).alias(k) for k in columns])


SX, SY = "((ne + 2 * e + se) - (nw + 2 * w + sw))", "((sw + 2 * s + se) - (nw + 2 * n + ne))"
TURNED = f"CASE WHEN degrees(atan2({SY}, -{SX})) > 90 THEN 450 - degrees(atan2({SY}, -{SX})) ELSE 90 - degrees(atan2({SY}, -{SX})) END"
ASPECT_SQL = f"CASE WHEN {SX} = 0 AND {SY} = 0 THEN 0 WHEN ({TURNED}) = 360 THEN 0 ELSE {TURNED} END"
TPI_SQL = "z - (nw + n + ne + w + e + sw + s + se) / 8"
TRI_SQL = "sqrt(" + " + ".join(f"pow({k} - z, 2)" for k in raster.NEIGHBOURS) + ")"
ROUGH_SQL = "greatest(z, nw, n, ne, w, e, sw, s, se) - least(z, nw, n, ne, w, e, sw, s, se)"


@query(f"WITH {NEAR_SQL} SELECT r, c, round({SLOPE_SQL}, 9) AS slope FROM nb")
def slope_horn(spark, sf_dir):
    return measured(spark, sf_dir, slope=raster.slope(CELL))


@query(f"WITH {NEAR_SQL} SELECT r, c, round({ASPECT_SQL}, 9) AS aspect FROM nb")
def aspect_horn(spark, sf_dir):
    return measured(spark, sf_dir, aspect=raster.aspect(CELL))


@query(f"WITH {NEAR_SQL} SELECT r, c, round({TRI_SQL}, 9) AS tri FROM nb")
def tri_riley(spark, sf_dir):
    return measured(spark, sf_dir, tri=raster.ruggedness())


@query(f"WITH {NEAR_SQL} SELECT r, c, round({TPI_SQL}, 9) AS tpi FROM nb")
def tpi3(spark, sf_dir):
    return measured(spark, sf_dir, tpi=raster.position_index())


@query(f"WITH {NEAR_SQL} SELECT r, c, round({ROUGH_SQL}, 9) AS roughness FROM nb")
def roughness3(spark, sf_dir):
    return measured(spark, sf_dir, roughness=raster.roughness())


CURVE_SQL = f"""{NEAR_SQL}, k AS (SELECT r, c, ((w + e) / 2 - z) / 900 AS d, ((n + s) / 2 - z) / 900 AS e2, (ne + sw - nw - se) / 3600 AS f, (e - w) / 60 AS g, (n - s) / 60 AS h FROM nb),
curv AS (SELECT r, c, CASE WHEN g*g + h*h < 1e-12 THEN 0 ELSE 2 * (d*g*g + e2*h*h + f*g*h) / (g*g + h*h) END AS profile,
  CASE WHEN g*g + h*h < 1e-12 THEN 0 ELSE -2 * (d*h*h + e2*g*g - f*g*h) / (g*g + h*h) END AS plan FROM k)"""


@query(f"WITH {CURVE_SQL} SELECT r, c, round(profile, 9) AS profile, round(plan, 9) AS plan FROM curv")
def curvature_zt(spark, sf_dir):
    return measured(spark, sf_dir, **raster.curvature(CELL))


@query(f"""WITH {CURVE_SQL}, sd AS (SELECT stddev_samp(profile) AS a, stddev_samp(plan) AS b FROM curv)
SELECT round(100.0 * avg((profile > 0.1 * a)::INT), 4) AS convex_pct, round(100.0 * avg((profile < -0.1 * a)::INT), 4) AS concave_pct,
  round(100.0 * avg((plan > 0.1 * b)::INT), 4) AS spreading_pct, round(100.0 * avg((plan < -0.1 * b)::INT), 4) AS gathering_pct, count(*) AS cells FROM curv, sd""")
def curvature_summary(spark, sf_dir):
    """Shares of cells beyond a tenth of the standard deviation; the deviations are one row, joined to all cells."""
    k = near(spark, sf_dir).withColumns(raster.curvature(CELL)).dropna(subset=["profile"])
    sd = k.agg(F.stddev_samp("profile").alias("a"), F.stddev_samp("plan").alias("b"))
    share = lambda cond: F.round(100.0 * F.avg(F.expr(cond).cast("int")), 4)
    return k.crossJoin(F.broadcast(sd)).agg(share("profile > 0.1 * a").alias("convex_pct"), share("profile < -0.1 * a").alias("concave_pct"),
                                           share("plan > 0.1 * b").alias("spreading_pct"), share("plan < -0.1 * b").alias("gathering_pct"), F.count("*").alias("cells"))


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = near(spark, sf_dir).withColumns({"a": raster.aspect(CELL), "sl": raster.slope(CELL)}).dropna(subset=["a"])
    return m.select("r", "c", *[v.alias(k) for k, v in raster.facing(F.col("a"), F.col("sl")).items()])


FACE_SQL = f"{NEAR_SQL}, fa AS (SELECT r, c, {SLOPE_SQL} AS sl, {ASPECT_SQL} AS a FROM nb), face AS (SELECT r, c, CASE WHEN sl = 0 THEN 0 ELSE cos(radians(a)) END AS northness, CASE WHEN sl = 0 THEN 0 ELSE sin(radians(a)) END AS eastness, CASE WHEN sl = 0 THEN 0.5 ELSE (1 - cos(radians(a - 30))) / 2 END AS trasp FROM fa)"


@query(f"WITH {FACE_SQL} SELECT r, c, round(northness, 9) AS northness, round(eastness, 9) AS eastness, round(trasp, 9) AS trasp FROM face")
def aspect_derivatives(spark, sf_dir):
    return _faces(spark, sf_dir).select("r", "c", *[F.round(k, 9).alias(k) for k in ("northness", "eastness", "trasp")])


@query(f"WITH {FACE_SQL} SELECT round(100.0 * avg((trasp > 0.6)::INT), 4) AS warm_pct, round(100.0 * avg((trasp < 0.4)::INT), 4) AS cool_pct, round(100.0 * avg((northness > 0.3)::INT), 4) AS north_pct, round(100.0 * avg((northness < -0.3)::INT), 4) AS south_pct FROM face")
def aspect_summary(spark, sf_dir):
    k = _faces(spark, sf_dir)
    share = lambda cond: F.round(100.0 * F.avg(F.expr(cond).cast("int")), 4)
    return k.agg(share("trasp > 0.6").alias("warm_pct"), share("trasp < 0.4").alias("cool_pct"), share("northness > 0.3").alias("north_pct"), share("northness < -0.3").alias("south_pct"))


@query(f"""WITH {NEAR_SQL}, m AS (SELECT r, c, {TPI_SQL} AS tpi, {SLOPE_SQL} AS slope FROM nb), sd AS (SELECT stddev_samp(tpi) AS d FROM m)
SELECT r, c, CASE WHEN tpi < -d THEN 1 WHEN tpi < -d / 2 THEN 2 WHEN tpi <= d / 2 AND slope <= 80 THEN 3 WHEN tpi <= d / 2 THEN 4 WHEN tpi <= d THEN 5 ELSE 6 END AS class FROM m, sd""")
def slope_position(spark, sf_dir):
    """Six slope positions; the thresholds are one standard deviation of the position index."""
    m = near(spark, sf_dir).select("r", "c", raster.position_index().alias("tpi"), raster.slope(CELL).alias("slope")).dropna()
    sd = m.agg(F.stddev_samp("tpi").alias("d"))
    return m.crossJoin(F.broadcast(sd)).select("r", "c", classes.slope_position(F.col("tpi"), F.col("slope"), -F.col("d"), F.col("d"), 80).alias("class"))


def _case(v: str, bounds) -> str:
    return "CASE " + " ".join(f"WHEN {v} <= {b} THEN {k}" for k, b in enumerate(bounds, 1) if b != float("inf")) + (f" ELSE {len(bounds)}" if bounds[-1] == float("inf") else "") + " END"


@query(" UNION ALL ".join(f"(WITH {NEAR_SQL}, m AS (SELECT {_case(SLOPE_SQL, b)} AS class FROM nb) SELECT '{k}' AS scheme, class, count(*) AS cells, count(*) * 0.09::DOUBLE AS area_ha FROM m GROUP BY class)" for k, b in classes.SLOPE_SCHEMES.items()))
def terrain_classes(spark, sf_dir):
    """Cells and area of the slope classes of each scheme; all schemes in one pass."""
    m = near(spark, sf_dir).select(raster.slope(CELL).alias("slope")).dropna()
    rows = F.array(*[F.struct(F.lit(k).alias("scheme"), classes.by_upper_bound(F.col("slope"), b).alias("class")) for k, b in classes.SLOPE_SCHEMES.items()])
    return m.select(F.inline(rows)).groupBy("scheme", "class").agg(F.count("*").alias("cells")).withColumn("area_ha", F.col("cells") * F.lit(0.09))


@query(f"WITH {NEAR_SQL}, m AS (SELECT {_case(TRI_SQL, [s * 400 for s in classes.TRI_SHARES])} AS tri, {_case(ROUGH_SQL, classes.ROUGHNESS)} AS rough, CASE WHEN {TPI_SQL} < -50 THEN 1 WHEN {TPI_SQL} <= 50 THEN 2 ELSE 3 END AS tpi FROM nb) SELECT tri, rough, tpi, count(*) AS cells FROM m GROUP BY ALL")
def ruggedness_classes(spark, sf_dir):
    m = near(spark, sf_dir).select(raster.ruggedness().alias("tri"), raster.roughness().alias("rough"), raster.position_index().alias("tpi")).dropna()
    m = m.select(classes.tri_class(F.col("tri"), 400.0).alias("tri"), classes.by_upper_bound(F.col("rough"), classes.ROUGHNESS).alias("rough"), classes.tpi_class(F.col("tpi"), 50.0).alias("tpi"))
    return m.groupBy("tri", "rough", "tpi").agg(F.count("*").alias("cells"))


@query(f"WITH {NEAR_SQL}, m AS (SELECT {ASPECT_SQL} AS a, {SLOPE_SQL} AS sl FROM nb) SELECT CAST(floor(((round_even(a, 0) % 360) + 22.5) / 45) AS INT) % 8 AS dir8, {_case('a', classes.ASPECT)} AS class, count(*) AS cells FROM m WHERE sl > 0.5 GROUP BY ALL")
def aspect_arrows(spark, sf_dir):
    """Eight directions of the cells that are not flat."""
    m = near(spark, sf_dir).select(raster.aspect(CELL).alias("a"), raster.slope(CELL).alias("sl")).where("sl > 0.5")
    return m.groupBy(classes.direction8(F.col("a")).alias("dir8"), classes.by_upper_bound(F.col("a"), classes.ASPECT).alias("class")).agg(F.count("*").alias("cells"))


@query(f"WITH {NEAR_SQL}, m AS (SELECT r, c, least(90, greatest(0, round_even({SLOPE_SQL}, 0))) AS deg FROM nb WHERE r % 5 = 2 AND c % 5 = 2) SELECT r // 5 AS r, c // 5 AS c, CAST(deg AS INT) AS deg, CAST(floor(deg / 5) * 5 AS INT) AS class FROM m")
def slope_grid_sample(spark, sf_dir):
    """Slope of the centre of each block of 5 x 5 cells, in whole degrees and steps of 5: the drafting grid."""
    m = near(spark, sf_dir).where("r % 5 = 2 AND c % 5 = 2").select("r", "c", F.greatest(F.lit(0.0), F.least(F.lit(90.0), F.bround(raster.slope(CELL)))).alias("deg")).dropna()
    return m.select(F.expr("r DIV 5").alias("r"), F.expr("c DIV 5").alias("c"), F.col("deg").cast("int").alias("deg"), (F.floor(F.col("deg") / 5) * 5).cast("int").alias("class"))


@query(f"WITH {NEAR_SQL}, fa AS (SELECT r, c, radians({SLOPE_SQL}) AS sl, {ASPECT_SQL} AS a FROM nb) SELECT r, c, round(greatest(0, (cos(radians(45)) * cos(sl) + sin(radians(45)) * sin(sl) * cos(radians(315 - a))) * 255), 7) AS shade FROM fa")
def hillshade(spark, sf_dir):
    m = near(spark, sf_dir).select("r", "c", raster.slope(CELL).alias("sl"), raster.aspect(CELL).alias("a")).dropna()
    return m.select("r", "c", F.round(raster.hillshade(F.col("sl"), F.col("a")), 7).alias("shade"))


@query(f"WITH {DEM_SQL} SELECT r, c, z, CAST({XMIN} + (c + 0.5) * 30 AS DOUBLE) AS x, CAST({YMAX} - (r + 0.5) * 30 AS DOUBLE) AS y FROM dem")
def cell_centres(spark, sf_dir):
    cells = dem(spark, sf_dir)
    grid = Grid(XMIN, YMAX, CELL, WIDTH, 1)
    return cells.select("r", "c", "z", grid.x("c").alias("x"), grid.y("r").alias("y"))


@query(f"WITH {DEM_SQL} SELECT r, c, z FROM dem WHERE r BETWEEN 3 AND 66 AND c BETWEEN 10 AND 59")
def raster_scan_window(spark, sf_dir):
    """The cells that a box touches; the box becomes a range of rows and columns."""
    cells = dem(spark, sf_dir)
    r0, r1, c0, c1 = Grid(XMIN, YMAX, CELL, WIDTH, 10_000).window(200_310.0, 201_790.0, 598_000.0, 599_900.0)
    return cells.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))


@query(f"""WITH {DEM_SQL}, b AS (SELECT r // 3 AS r, c // 3 AS c, avg(z) AS z FROM dem GROUP BY ALL),
p AS (SELECT r, c, z, floor((r + 0.5) / 3 - 0.5) AS r0, floor((c + 0.5) / 3 - 0.5) AS c0, (r + 0.5) / 3 - 0.5 AS fr, (c + 0.5) / 3 - 0.5 AS fc FROM dem),
q AS (SELECT p.*, fr - r0 AS v, fc - c0 AS u FROM p)
SELECT q.r, q.c, round(q.z - coalesce((1-v)*(1-u)*a.z + (1-v)*u*b2.z + v*(1-u)*c2.z + v*u*d.z, CASE WHEN v < 0.5 AND u < 0.5 THEN a.z WHEN v < 0.5 THEN b2.z WHEN u < 0.5 THEN c2.z ELSE d.z END), 9) AS tpi
FROM q LEFT JOIN b a ON a.r = r0 AND a.c = c0 LEFT JOIN b b2 ON b2.r = r0 AND b2.c = c0 + 1 LEFT JOIN b c2 ON c2.r = r0 + 1 AND c2.c = c0 LEFT JOIN b d ON d.r = r0 + 1 AND d.c = c0 + 1""")
def tpi_radius_approx(spark, sf_dir):
    cells = dem(spark, sf_dir)
    return raster.position_index_wide(cells, Grid(0.0, 0.0, 1.0, WIDTH, 3), 3).select("r", "c", F.round("tpi", 9).alias("tpi"))


TARGET_SQL = "h AS (SELECT max(r) + 1 AS n FROM dem), t AS (SELECT r, c, 200010.0 + (c + 0.5) * 45 AS x, 599990.0 - (r + 0.5) * 45 AS y FROM range(0, (SELECT greatest(1, CAST(floor((n * 30 - 20) / 45) AS BIGINT)) FROM h)) a(r), range(0, 66) b(c))"


def _target(grid: Grid) -> Grid:
    import math

    return Grid(200_010.0, 599_990.0, 45.0, 66, max(1, math.floor((grid.height * 30 - 20) / 45)))


@query(f"WITH {DEM_SQL}, {TARGET_SQL} SELECT t.r, t.c, d.z FROM t JOIN dem d ON d.r = CAST(floor((600000.0 - y) / 30) AS BIGINT) AND d.c = CAST(floor((x - 200000.0) / 30) AS BIGINT)")
def resample_nearest(spark, sf_dir):
    cells = dem(spark, sf_dir)
    grid = dem_grid(cells)
    return raster.resample(cells, grid, _target(grid), "nearest")


@query(f"""WITH {DEM_SQL}, {TARGET_SQL}, p AS (SELECT r, c, (600000.0 - y) / 30 - 0.5 AS fr, (x - 200000.0) / 30 - 0.5 AS fc FROM t), q AS (SELECT *, floor(fr) AS r0, floor(fc) AS c0, fr - floor(fr) AS v, fc - floor(fc) AS u FROM p)
SELECT q.r, q.c, round(coalesce((1-v)*(1-u)*a.z + (1-v)*u*b.z + v*(1-u)*e.z + v*u*d.z, CASE WHEN v < 0.5 AND u < 0.5 THEN a.z WHEN v < 0.5 THEN b.z WHEN u < 0.5 THEN e.z ELSE d.z END), 9) AS z
FROM q LEFT JOIN dem a ON a.r = r0 AND a.c = c0 LEFT JOIN dem b ON b.r = r0 AND b.c = c0 + 1 LEFT JOIN dem e ON e.r = r0 + 1 AND e.c = c0 LEFT JOIN dem d ON d.r = r0 + 1 AND d.c = c0 + 1
WHERE coalesce((1-v)*(1-u)*a.z + (1-v)*u*b.z + v*(1-u)*e.z + v*u*d.z, CASE WHEN v < 0.5 AND u < 0.5 THEN a.z WHEN v < 0.5 THEN b.z WHEN u < 0.5 THEN e.z ELSE d.z END) IS NOT NULL""")
def resample_bilinear(spark, sf_dir):
    cells = dem(spark, sf_dir)
    grid = dem_grid(cells)
    return raster.resample(cells, grid, _target(grid), "bilinear").select("r", "c", F.round("z", 9).alias("z"))


@query(f"WITH {DEM_SQL}, h AS (SELECT max(r) + 1 AS n FROM dem) SELECT CAST(floor((r + 0.5) / 4) AS BIGINT) AS r, CAST(floor((c + 0.5) / 4) AS BIGINT) AS c, round(avg(z), 9) AS z FROM dem, h WHERE floor((r + 0.5) / 4) < ceil(n / 4.0) GROUP BY 1, 2")
def resample_average(spark, sf_dir):
    cells = dem(spark, sf_dir)
    grid = dem_grid(cells)
    return raster.resample(cells, grid, Grid(XMIN, YMAX, 120.0, 25, -(-grid.height // 4)), "average").select("r", "c", F.round("z", 9).alias("z"))


@query(f"""WITH {DEM_SQL}, holes AS (SELECT r, c, CASE WHEN z < 60 THEN NULL ELSE z END AS z FROM dem),
f AS (SELECT a.r, a.c, sum(b.z / ((b.r - a.r) ** 2 + (b.c - a.c) ** 2)) / sum(1 / ((b.r - a.r) ** 2 + (b.c - a.c) ** 2)) AS z FROM holes a JOIN holes b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2
 WHERE a.z IS NULL AND b.z IS NOT NULL AND (b.r - a.r) ** 2 + (b.c - a.c) ** 2 <= 4 GROUP BY ALL)
SELECT h.r, h.c, round(coalesce(h.z, f.z), 9) AS z FROM holes h LEFT JOIN f ON f.r = h.r AND f.c = h.c""")
def fill_nodata(spark, sf_dir):
    """Cells under 60 lose their data and are filled from within two cells."""
    holes = dem(spark, sf_dir).withColumn("z", F.when(F.col("z") >= 60, F.col("z")))
    return raster.fill(holes, 2).select("r", "c", F.round("z", 9).alias("z"))


@query(f"""WITH {DEM_SQL}, q AS (SELECT a.r, a.c, a.z, b.z AS e, d.z AS s, f.z AS se FROM dem a JOIN dem b ON b.r = a.r AND b.c = a.c + 1 JOIN dem d ON d.r = a.r + 1 AND d.c = a.c JOIN dem f ON f.r = a.r + 1 AND f.c = a.c + 1),
l AS (SELECT q.*, level, (z >= level)::INT * 8 + (e >= level)::INT * 4 + (se >= level)::INT * 2 + (s >= level)::INT AS code FROM q, (SELECT unnest([100.0, 250.0, 400.0]::DOUBLE[]) AS level))
SELECT level, count(*) AS squares, CAST(sum(CASE WHEN code IN (5, 10) THEN 2 ELSE 1 END) AS BIGINT) AS segments FROM l WHERE code NOT IN (0, 15) GROUP BY level""")
def contour_counts(spark, sf_dir):
    """Contour pieces of three levels by marching squares."""
    lines = raster.marching_squares(dem(spark, sf_dir), [100.0, 250.0, 400.0])
    return lines.groupBy("level").agg(F.count_if(F.col("part") == 0).alias("squares"), F.count("*").alias("segments"))


@query()
def contours(spark, sf_dir):
    """The pieces themselves; tested against linear interpolation along the sides."""
    return raster.marching_squares(dem(spark, sf_dir), [100.0, 250.0, 400.0])


def pieces_sql(cells: str, levels: str) -> str:
    """The pieces of contours of cells (r, c, z): their level, ends, the sides on which these lie, and lengths."""
    x = lambda k: f"CASE {k} WHEN 'T' THEN c + (level - z) / (e - z) WHEN 'B' THEN c + (level - s) / (se - s) WHEN 'L' THEN c ELSE c + 1 END"
    y = lambda k: f"CASE {k} WHEN 'L' THEN r + (level - z) / (s - z) WHEN 'R' THEN r + (level - e) / (se - e) WHEN 'T' THEN r ELSE r + 1 END"
    side = lambda k: f"(r + ({k} = 'B')::INT, c + ({k} = 'R')::INT, {k} IN ('T', 'B'))"
    return f"""q AS (SELECT a.r, a.c, a.z, b.z AS e, d.z AS s, f.z AS se FROM {cells} a JOIN {cells} b ON b.r = a.r AND b.c = a.c + 1 JOIN {cells} d ON d.r = a.r + 1 AND d.c = a.c JOIN {cells} f ON f.r = a.r + 1 AND f.c = a.c + 1),
l AS (SELECT q.*, level, (z >= level)::INT * 8 + (e >= level)::INT * 4 + (se >= level)::INT * 2 + (s >= level)::INT AS code, (z + e + s + se) / 4 >= level AS m FROM q, (SELECT unnest({levels}::DOUBLE[]) AS level)),
w AS (SELECT *, unnest(CASE WHEN code IN (1, 14) THEN ['LB'] WHEN code IN (2, 13) THEN ['BR'] WHEN code IN (3, 12) THEN ['LR'] WHEN code IN (4, 11) THEN ['RT'] WHEN code IN (6, 9) THEN ['BT'] WHEN code IN (7, 8) THEN ['LT'] WHEN (code = 5) = m THEN ['LT', 'RB'] ELSE ['LB', 'RT'] END) AS p FROM l WHERE code NOT IN (0, 15)),
pieces AS (SELECT level, {side('p[1]')} AS a, {side('p[2]')} AS b, sqrt((({x('p[1]')}) - ({x('p[2]')})) ** 2 + (({y('p[1]')}) - ({y('p[2]')})) ** 2) AS length FROM w),
ends AS (SELECT level, k, count(*) AS n FROM (SELECT level, a AS k FROM pieces UNION ALL SELECT level, b FROM pieces) GROUP BY level, k)
SELECT t.level, t.pieces, coalesce(o.n, 0) // 2 AS open_lines, round(t.length, 4) AS length FROM (SELECT level, count(*) AS pieces, sum(length) AS length FROM pieces GROUP BY level) t LEFT JOIN (SELECT level, count(*) AS n FROM ends WHERE n = 1 GROUP BY level) o USING (level)"""


def path_report(points):
    """Of each level of contour_paths(): pieces between points that follow one another, open lines, and length along them."""
    after = points.select("level", "line", (F.col("at") - 1).alias("at"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    steps = points.join(after, ["level", "line", "at"]).groupBy("level").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).alias("length"))
    lines = points.where("at = 0").groupBy("level").agg(F.count_if(~F.col("closed")).alias("open_lines"))
    return steps.join(lines, "level").select("level", "pieces", "open_lines", F.round("length", 4).alias("length"))


@query(f"WITH {DEM_SQL}, {pieces_sql('dem', '[100.0, 250.0, 400.0]')}")
def contour_order(spark, sf_dir):
    """Contours as lines of points in order: how many pieces and open lines there are, and how long the lines are."""
    return path_report(outlines.contour_paths(dem(spark, sf_dir), [100.0, 250.0, 400.0]))


@query()
def contour_paths(spark, sf_dir):
    """The points of every contour in order; tested against a tracer."""
    return outlines.contour_paths(dem(spark, sf_dir), [100.0, 250.0, 400.0])


@query(f"WITH {NEAR_SQL}, k AS (SELECT r, c, CAST(floor(least(90, greatest(0, round_even({SLOPE_SQL}, 0))) / 5) * 5 AS INT) AS class FROM nb), {quads_sql('k', 'n')}, t AS (SELECT class, count(*) AS cells FROM k GROUP BY class) "
       "SELECT class, CAST((one - three - 2 * opposite) / 4 AS BIGINT) AS shells_less_holes, cells, one + two + three + 2 * opposite AS sides, one + three + 2 * opposite AS points FROM n JOIN t USING (class)")
def slope_parts(spark, sf_dir):
    """The drafting grid dissolved: outlines of the areas whose slopes are in one step of five degrees."""
    slope = raster.slope(CELL)
    m = near(spark, sf_dir).select("r", "c", F.when(slope.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(90.0), F.bround(slope)))).alias("deg"))
    return outlined(m.select("r", "c", (F.floor(F.col("deg") / 5) * 5).cast("int").alias("class")), True)
