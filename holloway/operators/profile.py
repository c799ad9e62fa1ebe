"""Sequences along profiles: running measures, gaps and islands, merged ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import numbered

#: Radius of the earth in metres.
EARTH = 6_371_000.0


def smoothed(t: DataFrame, keys: list[str], order: str, value: str, half: int = 3) -> DataFrame:
    """A moving average over ``half`` rows to each side, fewer at the ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    return t.withColumn("smooth", F.avg(value).over(w))


def climbs(t: DataFrame, keys: list[str], distance: str, z: str) -> DataFrame:
    """step, climb, slope_pct, and cumulative ascent and descent along each profile."""
    w = Window.partitionBy(*keys).orderBy(distance)
    t = t.withColumns({"step": F.col(distance) - F.lag(distance).over(w), "climb": F.col(z) - F.lag(z).over(w)})
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    up, down = F.greatest(F.coalesce("climb", F.lit(0.0)), F.lit(0.0)), F.greatest(-F.coalesce("climb", F.lit(0.0)), F.lit(0.0))
    return t.withColumns({"slope_pct": F.when(F.col("step") > 0, 100 * F.col("climb") / F.col("step")), "ascent": F.sum(up).over(so_far), "descent": F.sum(down).over(so_far)})


def profile_stats(t: DataFrame, keys: list[str], distance: str, z: str) -> DataFrame:
    s = F.abs("slope_pct")
    return climbs(t, keys, distance, z).groupBy(*keys).agg((F.max(distance) - F.min(distance)).alias("length"), F.min(z).alias("low"), F.max(z).alias("high"), F.max("ascent").alias("ascent"), F.max("descent").alias("descent"),
                                                           F.avg(s).alias("mean_slope"), F.max(s).alias("max_slope"), F.min_by("slope_pct", F.when(F.col("slope_pct").isNotNull(), F.col(distance))).alias("first_slope"))


def islands(t: DataFrame, keys: list[str], order: str, state: Column) -> DataFrame:
    """``t`` with ``run``: 1, 2, ... for successive rows of one state."""
    w = Window.partitionBy(*keys).orderBy(order)
    t = t.withColumn("__s", state)
    t = t.withColumn("__turn", F.when(F.col("__s").eqNullSafe(F.lag("__s").over(w)), 0).otherwise(1))
    return t.withColumn("run", F.sum("__turn").over(w)).drop("__s", "__turn")


def merged_ranges(t: DataFrame, keys: list[str], gap: float = 0.5) -> DataFrame:
    """Ranges (start, stop) that overlap or are ``gap`` apart at most become one."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    reached = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("__new", F.when(F.col("start") <= reached + gap, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("parts")).drop("__run")


def thinned(values: Column, gap: float = 0.5) -> Column:
    """Of sorted numbers those over ``gap`` from the last one kept."""
    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"), lambda kept, x: F.when(F.size(kept) == 0, F.array(x)).when(x - F.element_at(kept, -1) > gap, F.concat(kept, F.array(x))).otherwise(kept))


def bent(lines: DataFrame, cc: float) -> DataFrame:
    """sight_lines() whose ground is lowered by the earth's curvature, of which refraction leaves the share ``cc``."""
    return lines.withColumn("z", F.col("z") - F.lit(cc) * F.col("d") * F.col("d") / (2 * EARTH))


def sight_segments(lines: DataFrame, observer: float) -> DataFrame:
    """(a, b, run, seen, from_m, to_m) of sight_lines(): ground is seen when no ground before it stands steeper."""
    first = lines.where("i = 0 AND z IS NOT NULL").select("a", "b", F.col("z").alias("z0"))
    w = Window.partitionBy("a", "b").orderBy("i")
    t = lines.where("i > 0 AND z IS NOT NULL").join(first, ["a", "b"]).withColumn("angle", (F.col("z") - F.col("z0") - observer) / F.col("d"))
    t = t.withColumn("seen", F.coalesce(F.col("angle") >= F.max("angle").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    return islands(t, ["a", "b"], "i", F.col("seen")).groupBy("a", "b", "run").agg(F.max("seen").alias("seen"), F.min("d").alias("from_m"), F.max("d").alias("to_m"))


def first_obstruction(lines: DataFrame, observer: float, target: float = 0.0) -> DataFrame:
    """(a, b, visible, hit_m, hit_z): whether ground stands over the straight line to the target, and where it first rises through that line.

    Samples without data are skipped; the first and last that are left are the observer and the target.
    """
    w = Window.partitionBy("a", "b").orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = lines.where("z IS NOT NULL").withColumns({"eye": F.first("z").over(whole) + observer, "goal": F.last("z").over(whole) + target, "length": F.last("d").over(whole), "i0": F.first("i").over(whole), "i1": F.last("i").over(whole)})
    t = t.withColumn("over", F.col("z") - (F.col("eye") + F.col("d") / F.col("length") * (F.col("goal") - F.col("eye"))))
    t = t.withColumns({"d0": F.lag("d").over(w), "z0": F.lag("z").over(w), "over0": F.when(F.lag("i").over(w) == F.col("i0"), F.lag("z").over(w) - F.col("eye")).otherwise(F.lag("over").over(w))})
    t = t.withColumn("hit", (F.col("i") > F.col("i0")) & (F.col("i") < F.col("i1")) & (F.col("over") > 0))
    share = F.when(F.col("over0") <= 0, F.col("over0") / (F.col("over0") - F.col("over"))).otherwise(F.lit(1.0))
    at = F.struct("i", (F.col("d0") + share * (F.col("d") - F.col("d0"))).alias("m"), (F.col("z0") + share * (F.col("z") - F.col("z0"))).alias("z"))
    return t.groupBy("a", "b").agg((~F.max("hit")).alias("visible"), F.min(F.when(F.col("hit"), at)).alias("x")).select("a", "b", "visible", F.col("x.m").alias("hit_m"), F.col("x.z").alias("hit_z"))


def milestones(t: DataFrame, keys: list[str], distance: str, interval: float) -> DataFrame:
    """``t`` reduced to the row nearest to each multiple of ``interval`` that the profile reaches (the earlier of two), with ``mark`` (its multiple).

    A row is nearest to the multiple below or above it or to none, so each looks at these two: no product of rows and marks.
    """
    whole = Window.partitionBy(*keys)
    t = t.withColumn("__last", F.floor(F.max(distance).over(whole) / interval))
    order = Window.partitionBy(*keys).orderBy(distance)
    below, above = F.col(distance), F.coalesce(F.lead(distance).over(order), F.col(distance))
    marks = F.when(F.floor(above / interval) >= F.ceil(below / interval), F.sequence(F.ceil(below / interval), F.floor(above / interval)))
    pairs = t.withColumn("__marks", marks).withColumn("__after", F.lead(F.struct(*[c for c in t.columns if c != "__last"])).over(order)).where("__marks IS NOT NULL")
    pairs = pairs.select("*", F.explode("__marks").alias("mark")).where("mark >= 1 AND mark <= __last")
    own = F.struct(*[c for c in t.columns if c != "__last"])
    chosen = F.when(F.col("__after").isNull() | (F.abs(F.col(distance) - F.col("mark") * interval) <= F.abs(F.col("__after")[distance] - F.col("mark") * interval)), own).otherwise(F.col("__after"))
    found = pairs.select("mark", chosen.alias("x"))
    return found.select("mark", "x.*").dropDuplicates([*keys, "mark"])


def turning_points(t: DataFrame, keys: list[str], order: str, x: str = "x", y: str = "y") -> DataFrame:
    """The rows where the direction of a line, as signs of its steps, changes; both ends stay."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = lambda c, by: F.signum(F.lead(c, by).over(w) - F.lead(c, by - 1).over(w))
    t = t.withColumns({"__in": F.struct(step(x, 0), step(y, 0)), "__out": F.struct(step(x, 1), step(y, 1)), "__first": F.row_number().over(w) == 1, "__last": F.lead(F.lit(1)).over(w).isNull()})
    return t.where(F.col("__first") | F.col("__last") | (F.col("__in") != F.col("__out"))).drop("__in", "__out", "__first", "__last")


def densified(lines: DataFrame, step: float) -> DataFrame:
    """Points (id, i, x, y) at most ``step`` apart along segments (id, x1, y1, x2, y2), both ends included."""
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / step).cast("int"))
    at = lines.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), "n")).alias("i")).withColumn("t", F.col("i") / F.col("n"))
    return at.select("id", "i", (F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("t")).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * F.col("t")).alias("y"))


def evenly(t: DataFrame, order: str, most: int) -> DataFrame:
    """At most ``most`` rows evenly over the order, both ends kept (half-even places, without repeats)."""
    n = t.count()
    if n <= most:
        return t
    places = F.bround(F.col("id") * (n - 1) / max(1, most - 1)).cast("long").alias("__n") if most > 1 else F.lit(0).cast("long").alias("__n")
    return numbered(t, order, out="__n").join(t.sparkSession.range(max(1, most)).select(places).distinct(), "__n", "left_semi").drop("__n")


def end_point(x: Column, y: Column, tx: Column, ty: Column, length: float) -> dict[str, Column]:
    """The point ``length`` from (x, y) towards (tx, ty); that point itself if both are one."""
    d = F.hypot(tx - x, ty - y)
    return {"x": F.when(d > 0, x + (tx - x) * length / d).otherwise(tx), "y": F.when(d > 0, y + (ty - y) * length / d).otherwise(ty)}


def length_of(points: Column) -> Column:
    """Length of a line given as an array of structs x, y."""
    pairs = F.arrays_zip(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))).alias("p"), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))).alias("q"))
    return F.aggregate(F.transform(pairs, lambda s: F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"])), F.lit(0.0), lambda a, d: a + d)


def saved_lines(t: DataFrame, key: str, distance: str, z: str, palette: list[tuple[int, int, int]]) -> DataFrame:
    """A row for each profile: its number, length, least and greatest height, samples, and a colour of the palette in turn."""
    rows = t.groupBy(key).agg((F.max(distance) - F.min(distance)).alias("distance"), F.min(z).alias("min_elev"), F.max(z).alias("max_elev"), F.count(z).alias("samples"))
    colours = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("rgb", c, strict=True)]) for c in palette])
    return numbered(rows, key, out="__n").withColumn("no", F.col("__n") + 1).withColumn("__c", F.element_at(colours, (F.col("__n") % len(palette) + 1).cast("int"))).select("no", key, "distance", "min_elev", "max_elev", "samples", "__c.*")
