"""Vector layers as tables: which features are read, how they lie to an area, and what is beside a line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import compass8
from ..lineage import dealt


def in_box(t: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """Features (xmin, xmax, ymin, ymax) whose boxes meet a box; plain comparisons, which the scan takes over."""
    return t.where((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))


def selected(t: DataFrame, flag: str, keys: list[str] | None = None) -> DataFrame:
    """The features whose flag is set, for each layer (``keys``); all features of a layer in which none is."""
    if not keys:
        some = t.agg(F.coalesce(F.max(F.col(flag)), F.lit(False)).alias("__some"))
        return t.crossJoin(F.broadcast(some)).where(F.coalesce(F.col(flag), F.lit(False)) | ~F.col("__some")).drop("__some")
    some = t.groupBy(*keys).agg(F.coalesce(F.max(F.col(flag)), F.lit(False)).alias("__some"))
    return t.join(some, keys).where(F.coalesce(F.col(flag), F.lit(False)) | ~F.col("__some")).drop("__some")


def configured(t: DataFrame, column: str, rules: dict[str, tuple[str, object, Callable]]) -> DataFrame:
    """``t`` with the values of a JSON column: name -> (type, default, test); a missing, broken or failing value is the default."""
    parsed = F.from_json(column, ", ".join(f"{k} {kind}" for k, (kind, _, _) in rules.items()))
    t = t.withColumn("__j", parsed)
    return t.withColumns({k: F.when(F.coalesce(test(F.col(f"__j.{k}")), F.lit(False)), F.col(f"__j.{k}")).otherwise(F.lit(default)) for k, (_, default, test) in rules.items()}).drop("__j")


def relations(t: DataFrame, aoi: tuple[float, float, float, float], around: float) -> DataFrame:
    """``t`` (xmin, xmax, ymin, ymax) with its relation to an area (xmin, xmax, ymin, ymax) and the ground ``around`` it: the relation of six, areas, shares, distance, bearing."""
    x0, x1, y0, y1 = aoi

    def lies(a, b, c, d):
        meets = (F.col("xmin") <= b) & (F.col("xmax") >= a) & (F.col("ymin") <= d) & (F.col("ymax") >= c)
        within = (F.col("xmin") >= a) & (F.col("xmax") <= b) & (F.col("ymin") >= c) & (F.col("ymax") <= d)
        side = lambda k, lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{k}max").cast("double"), F.lit(hi)) - F.greatest(F.col(f"{k}min").cast("double"), F.lit(lo)))
        return meets, within, side("x", a, b) * side("y", c, d)

    ia, wa, in_aoi = lies(x0, x1, y0, y1)
    ib, wb, in_buffer = lies(x0 - around, x1 + around, y0 - around, y1 + around)
    relation = F.when(wa, "inside_aoi").when(ia, "crosses_aoi_boundary").when(wb, "inside_buffer_only").when(ib, "crosses_buffer_boundary").otherwise("outside_buffer")
    area = ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).cast("double")
    dx, dy = F.greatest(x0 - F.col("xmax"), F.lit(0.0), F.col("xmin") - x1), F.greatest(y0 - F.col("ymax"), F.lit(0.0), F.col("ymin") - y1)
    east, north = (F.col("xmin") + F.col("xmax")) / 2 - (x0 + x1) / 2, (F.col("ymin") + F.col("ymax")) / 2 - (y0 + y1) / 2
    share = lambda v: F.when(area > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * v / area)))
    t = t.withColumns({"relation": relation, "inside_or_overlap_aoi": ia, "inside_or_overlap_buffer": ib, "crosses_aoi_boundary": ia & ~wa, "crosses_buffer_boundary": ib & ~wb, "feature_area_m2": area,
                       "overlap_aoi_area_m2": in_aoi, "outside_aoi_area_m2": F.greatest(F.lit(0.0), area - in_aoi), "overlap_buffer_area_m2": in_buffer, "outside_buffer_area_m2": F.greatest(F.lit(0.0), area - in_buffer),
                       "inside_aoi_area_pct": share(in_aoi), "inside_buffer_area_pct": share(in_buffer), "distance_to_aoi_m": F.sqrt(dx * dx + dy * dy), "distance_to_aoi_centroid_m": F.sqrt(east * east + north * north),
                       "bearing_from_aoi_deg": F.when((F.abs(east) > 1e-9) | (F.abs(north) > 1e-9), F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)))})
    return t.withColumn("compass_from_aoi", compass8(F.col("bearing_from_aoi_deg")))


def relation_counts(t: DataFrame) -> DataFrame:
    """The six counters of relations()."""
    is_ = lambda k: F.count_if(F.col("relation") == k).alias(k)
    return t.agg(F.count_if("inside_or_overlap_aoi").alias("inside_or_overlap_aoi"), *map(is_, ("inside_aoi", "crosses_aoi_boundary", "inside_buffer_only", "crosses_buffer_boundary", "outside_buffer")))


def beside(lines: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """(id, site, at_m, off_m): points (id, x, y) within ``reach`` of each line (id, x1, y1, x2, y2), with the place along it.

    Lines are cut into pieces, and pieces meet points in squares, so no line is compared with all points.
    """
    size = max(reach * 2, 1e-9)
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / size)).cast("int")
    pieces = lines.where("x1 <> x2 OR y1 <> y2").withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), "n")).alias("k"))
    mid = pieces.withColumns({"mx": F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("k") / F.col("n"), "my": F.col("y1") + (F.col("y2") - F.col("y1")) * F.col("k") / F.col("n")})
    near = F.array(*[F.struct((F.floor(F.col("mx") / size) + i).alias("bx"), (F.floor(F.col("my") / size) + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    filed = mid.select("id", "x1", "y1", "x2", "y2", F.inline(near)).distinct()
    # Squares whose middle is farther from the line than its reach and half their diagonal hold none of its points.
    middle = f"abs(((bx + 0.5) * {size!r}D - x1) * (y2 - y1) - ((by + 0.5) * {size!r}D - y1) * (x2 - x1))"
    filed = filed.where(f"{middle} <= {reach + 0.7072 * size!r}D * hypot(x2 - x1, y2 - y1) + 1e-6")
    at = points.select(F.col("id").alias("site"), "x", "y", F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by"))
    both = dealt(filed, "bx", "by").join(dealt(at, "bx", "by"), ["bx", "by"]).selectExpr("id", "site", "sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS l", "((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS t", "x - x1 AS px", "y - y1 AS py", "x2 - x1 AS dx", "y2 - y1 AS dy")
    off = both.where("t BETWEEN 0 AND 1").selectExpr("id", "site", "t * l AS at_m", "sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)) AS off_m")
    return off.where(F.col("off_m") <= reach)


def stretches(samples: DataFrame, areas: DataFrame, bucket: int) -> DataFrame:
    """(id, area, from_m, to_m, samples): successive samples (id, i, x, y, d) that lie in an area (area, xmin, xmax, ymin, ymax)."""
    span = lambda k: F.explode(F.sequence(F.floor(F.col(f"{k}min") / bucket), F.floor(F.col(f"{k}max") / bucket)))
    filed = areas.withColumn("bx", span("x")).withColumn("by", span("y"))
    at = samples.withColumns({"bx": F.floor(F.col("x") / bucket), "by": F.floor(F.col("y") / bucket)})
    inside = at.join(filed, ["bx", "by"]).where("x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax").select("id", "area", "i", "d")
    n = F.row_number().over(Window.partitionBy("id", "area").orderBy("i"))
    return inside.withColumn("run", F.col("i") - n).groupBy("id", "area", "run").agg(F.min("d").alias("from_m"), F.max("d").alias("to_m"), F.count("*").alias("samples"))


def choices(t: DataFrame, field: str) -> DataFrame:
    """(value) the distinct values of a field, without blanks, ``none`` and ``null``, by their small letters."""
    v = F.trim(F.col(field).cast("string"))
    return t.select(v.alias("value")).where("value <> '' AND lower(value) NOT IN ('none', 'null')").distinct().orderBy(F.lower("value"), "value")


def matching_field(t: DataFrame, fields: list[str], names: DataFrame) -> DataFrame:
    """(field, matches): the field with the most distinct values among the names, the first of equals; none if no value matches."""
    long = t.select(*[F.col(f).cast("string").alias(f) for f in fields]).unpivot([], fields, "field", "v").distinct()
    found = long.join(names.select(F.col(names.columns[0]).alias("v")).distinct(), "v", "left_semi").groupBy("field").agg(F.count("*").alias("matches"))
    return found.orderBy(F.desc("matches"), "field").limit(1)


def keeping_away(t: DataFrame, bad: DataFrame, reach: float) -> DataFrame:
    """The places (id, x, y) that are farther than ``reach`` from all of ``bad`` (x, y): an anti-join over squares."""
    around = F.array(*[F.struct((F.floor(F.col("x") / reach) + i).alias("bx"), (F.floor(F.col("y") / reach) + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    filed = bad.select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.floor(F.col("x") / reach).alias("bx"), F.floor(F.col("y") / reach).alias("by")).distinct()
    hit = t.select("id", "x", "y", F.inline(around)).join(filed, ["bx", "by"]).where((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")) <= reach * reach)
    return t.join(hit.select("id").distinct(), "id", "left_anti")


def zone_rings(t: DataFrame, most: str) -> DataFrame:
    """``t`` with (zone, distance_m): the radii of the distance zones, 500 m and 2,500 m, that are under a row's limit, and the limit itself."""
    rings = F.array(*[F.struct(F.lit(z).alias("zone"), F.lit(r).alias("distance_m")) for z, r in ((1, 500.0), (2, 2500.0))], F.struct(F.lit(3).alias("zone"), F.col(most).cast("double").alias("distance_m")))
    return t.select("*", F.inline(F.filter(rings, lambda x: (x["zone"] == 3) | (x["distance_m"] < F.col(most)))))


def widened_step(width: float, height: float, area: float, step: float, most: int = 8000, box_most: int = 600_000) -> float:
    """The step of a grid of candidates over an area, widened until about ``most`` fall inside it and ``box_most`` in its box."""
    share = min(1.0, max(1e-3, area / max(1e-9, width * height)))
    count = lambda s: (int(width / s) + 1) * (int(height / s) + 1)
    if count(step) * share > most:
        step *= (count(step) * share / most) ** 0.5
    return step * (count(step) / box_most) ** 0.5 if count(step) > box_most else step


