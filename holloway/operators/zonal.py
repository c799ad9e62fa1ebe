"""Statistics of cells by zone and by class, and weighted centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantile import quantile


def zone_cells(zones: DataFrame, zone: str = "zone") -> DataFrame:
    """(zone, r, c) of rectangular zones (r0, r1, c0, c1)."""
    rows = zones.select(zone, "c0", "c1", F.explode(F.sequence("r0", "r1")).alias("r"))
    return rows.select(zone, "r", F.explode(F.sequence("c0", "c1")).alias("c"))


def valued(cells: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (zone, r, c) with the columns of ``cells`` at their places.

    Spark reckons the size of zones before they are spread over their cells and would broadcast them whole, so the join is told to sort and merge.
    """
    return members.join(cells.hint("merge"), ["r", "c"])


def zonal_stats(cells: DataFrame, members: DataFrame, zone: str = "zone") -> DataFrame:
    """Cells in each zone, cells with data and their share, mean, population deviation, least and most.

    ``members`` (zone, r, c) is joined on (r, c); each task reduces its cells to one row a zone before the shuffle.
    """
    inside = valued(cells, members)
    return inside.groupBy(zone).agg(F.count("*").alias("pix_in"), F.count("z").alias("pix_val"), (100.0 * F.count("z") / F.count("*")).alias("cov_pct"),
                                    F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"), F.min("z").alias("min"), F.max("z").alias("max"))


def zonal_classes(cells: DataFrame, members: DataFrame, classes: list[int], cell_area: float, zone: str = "zone") -> DataFrame:
    """For each zone and class (column ``class`` of ``cells``): n, share of the zone's cells, and area, as columns."""
    inside = valued(cells, members)
    n = lambda k: F.count_if(F.col("class") == k)
    out = []
    for k in classes:
        out += [n(k).alias(f"n_{k}"), (100.0 * n(k) / F.count("*")).alias(f"pct_{k}"), (n(k) * F.lit(cell_area)).alias(f"area_{k}")]
    return inside.groupBy(zone).agg(*out)


def class_stats(cells: DataFrame) -> DataFrame:
    """Count, mean and population deviation of each class."""
    return cells.groupBy("class").agg(F.count("*").alias("pix_n"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"))


def weight(rule: str, power: float = 2.0, threshold: float = 12.0) -> Column:
    """Weight of a cell's value: value, power, threshold (values over it) or binary (one over it)."""
    z = F.col("z")
    return {"value": z, "power": F.pow(z, F.lit(power)), "threshold": F.when(z >= threshold, z).otherwise(0.0), "binary": F.when(z >= threshold, 1.0).otherwise(0.0)}[rule]


def weighted_centre(cells: DataFrame, rule: str = "value", top_share: float = 0.1, **options) -> DataFrame:
    """(r, c, weight): the centre of the cells by a weight rule; ``top_pct`` takes the values over a percentile."""
    valid = cells.where("z IS NOT NULL")
    if rule == "top_pct":
        valid, w = valid.where(F.col("z") >= F.lit(quantile(valid, F.col("z"), 1 - top_share))), F.col("z")
    else:
        w = weight(rule, **options)
    return valid.select("r", "c", w.alias("w")).agg((F.sum(F.col("w") * F.col("r")) / F.sum("w")).alias("r"), (F.sum(F.col("w") * F.col("c")) / F.sum("w")).alias("c"), F.sum("w").alias("weight"))


def peak(cells: DataFrame) -> DataFrame:
    """(r, c, z) of the greatest value, the first in row order of equals."""
    return cells.where("z IS NOT NULL").agg(F.max(F.struct("z", (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))).alias("p")).select((-F.col("p.r")).alias("r"), (-F.col("p.c")).alias("c"), "p.z").where("z IS NOT NULL")


def overlay_rectangles(a: DataFrame, b: DataFrame, bucket: int) -> DataFrame:
    """Overlaps (a_id, b_id, a_m2, in_m2, in_pct) of rectangles (id, xmin, xmax, ymin, ymax), by an equi-join on buckets.

    Each rectangle is filed under the buckets that it touches; a pair counts in the bucket of its overlap's lower corner only.
    """
    def filed(t: DataFrame, p: str) -> DataFrame:
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket)))
        t = t.select(*[F.col(k).alias(f"{p}_{k}") for k in ("id", "xmin", "xmax", "ymin", "ymax")])
        return t.withColumn("bx", span(f"{p}_xmin", f"{p}_xmax")).withColumn("by", span(f"{p}_ymin", f"{p}_ymax"))

    both = filed(a, "a").join(filed(b, "b"), ["bx", "by"])
    low = lambda k: F.greatest(f"a_{k}min", f"b_{k}min")
    side = lambda k: F.least(f"a_{k}max", f"b_{k}max") - low(k)
    own = (F.floor(low("x") / bucket) == F.col("bx")) & (F.floor(low("y") / bucket) == F.col("by"))
    area = (F.col("a_xmax") - F.col("a_xmin")) * (F.col("a_ymax") - F.col("a_ymin"))
    return both.where((side("x") > 0) & (side("y") > 0) & own).select("a_id", "b_id", area.alias("a_m2"), (side("x") * side("y")).alias("in_m2"), (100.0 * side("x") * side("y") / area).alias("in_pct"))


def decorated(cells: DataFrame, breaks: list[float], cell_area: float) -> DataFrame:
    """What the polygons of each class carry: v_min, v_max, v_mid, pix_n, area_m2, area_ha, area_pct, val_mean, val_std."""
    at = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("class"))
    own = cells.where("class > 0").groupBy("class").agg(F.count("*").alias("pix_n"), F.avg("z").alias("val_mean"), F.stddev_pop("z").alias("val_std"))
    total = own.agg(F.sum("pix_n").alias("total"))
    return own.crossJoin(F.broadcast(total)).select("class", at(breaks[:-1]).alias("v_min"), at(breaks[1:]).alias("v_max"), at([(a + b) / 2 for a, b in zip(breaks, breaks[1:], strict=False)]).alias("v_mid"), "pix_n",
                                                    (F.col("pix_n") * F.lit(float(cell_area))).alias("area_m2"), (F.col("pix_n") * F.lit(cell_area / 10_000.0)).alias("area_ha"), (100.0 * F.col("pix_n") / F.col("total")).alias("area_pct"), "val_mean", "val_std")
