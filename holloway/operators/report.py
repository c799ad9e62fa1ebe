"""Area-of-interest reports: statistics of many layers in one table, and sentences from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import compass8, distance_phrase


def layer_report(layers: dict[str, DataFrame], x: float, y: float, radius: float) -> DataFrame:
    """(layer, features, inside, nearest, mean, direction, z_min, z_max, z_mean) of point layers (x, y, z) round a place.

    Each layer is reduced to one row before the layers are put together; ``direction`` is where most features inside lie.
    """
    out = None
    for name, t in sorted(layers.items()):
        dx, dy = F.col("x") - x, F.col("y") - y
        m = t.withColumns({"m": F.sqrt(dx * dx + dy * dy), "way": compass8(F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0)))})
        near = F.col("m") <= radius
        row = m.agg(F.count("*").alias("features"), F.count_if(near).alias("inside"), F.min("m").alias("nearest"), F.avg(F.when(near, F.col("m"))).alias("mean"), F.mode(F.when(near, F.col("way")), True).alias("direction"),
                    F.min(F.when(near, F.col("z"))).alias("z_min"), F.max(F.when(near, F.col("z"))).alias("z_max"), F.avg(F.when(near, F.col("z"))).alias("z_mean"))
        row = row.select(F.lit(name).alias("layer"), *row.columns)
        out = row if out is None else out.unionByName(row)
    return out


def sentences(report: DataFrame) -> DataFrame:
    """(layer, sentence): the report in words, without any outside service."""
    some = F.concat(F.col("layer"), F.lit(": "), F.col("inside").cast("string"), F.lit(" of "), F.col("features").cast("string"), F.lit(" inside, mostly "), F.coalesce("direction", F.lit("-")), F.lit("; the nearest "), distance_phrase(F.col("nearest")), F.lit("."))
    none = F.concat(F.col("layer"), F.lit(": none inside; the nearest "), F.coalesce(distance_phrase(F.col("nearest")), F.lit("is unknown")), F.lit("."))
    return report.select("layer", F.when(F.col("inside") > 0, some).otherwise(none).alias("sentence"))
