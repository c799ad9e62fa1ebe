"""Outcome of external jobs from their event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcome(log: DataFrame) -> DataFrame:
    """(run, succeeded, reason) from (run, seq, marker, diagnostic, fatal) rows.

    A run has succeeded only if its success marker came after all its diagnostics and none of these was fatal; one
    aggregation, whatever the order of the rows.
    """
    t = log.groupBy("run").agg(F.max(F.when(F.col("marker"), F.col("seq"))).alias("m"), F.max(F.when(F.col("diagnostic"), F.col("seq"))).alias("d"), F.count_if("fatal").alias("f"))
    reason = F.when(F.col("f") > 0, "fatal diagnostic").when(F.col("m").isNull(), "no marker").when(F.col("d") > F.col("m"), "diagnostic after marker").otherwise("ok")
    return t.select("run", (reason == "ok").alias("succeeded"), reason.alias("reason"))
