"""Lineage cuts, skew-safe joins and numbering for jobs of many steps, and the log of runs."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows, so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 500
#: Parts of both sides of a join that makes far more rows than it reads.
TASKS = 240


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a folder of our own where it is unset."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir")
    if told:
        return told
    if sc._jsc.sc().getCheckpointDir().isEmpty() and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = tempfile.mkdtemp(prefix="holloway-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: no lineage, safe when executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut(), but as a compressed table in the shared folder: for wide rows, of which later steps read a few columns."""
    path = f"{shared_dir(df.sparkSession)}/{unique_name('stored')}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def unique_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str, size: str, how: str = "inner", share: float = HOT_SHARE) -> DataFrame:
    """Join ``rows`` with ``keyed``, which has one row for each key and in ``size`` the number of rows with that key.

    Keys with more than ``share`` of all rows are at most 1 / share, so these few are broadcast and their
    rows stay where they are; all other rows are joined by shuffling. Both inputs should be cut or cheap to read.
    ``how`` is ``inner`` or ``left``; of a left join, rows whose key is missing from ``keyed`` get nulls.
    """
    total = keyed.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    limit = max(1000, int(total * share))
    values = [c for c in keyed.columns if c != key]
    hot = keyed.where(F.col(size) > limit).select(key, F.struct(*values).alias("__hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    near = marked.where(F.col("__hot").isNotNull()).select(*rows.columns, *[F.col(f"__hot.{c}").alias(c) for c in values])
    far = marked.where(F.col("__hot").isNull()).drop("__hot").join(keyed.where(F.col(size) <= limit), key, how)
    return near.unionByName(far.select(*rows.columns, *values))


def join_salted(rows: DataFrame, keyed: DataFrame, key: str, size: str, spread: str) -> DataFrame:
    """As join_keyed(), for wide ``keyed`` rows, which are never broadcast: a hot key's row is copied once for each part of
    its rows, which are dealt by a hash of ``spread``. Only hot keys and their numbers of parts are broadcast, 1 / HOT_SHARE at most."""
    total = keyed.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    limit = max(1000, int(total * HOT_SHARE))
    parts = F.ceil(F.col(size) / limit).cast("int")
    hot = keyed.where(F.col(size) > limit).select(key, parts.alias("__parts"))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    right = keyed.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return left.join(right, [key, "__part"]).drop("__part")


def dealt(df: DataFrame, *keys: str, tasks: int = TASKS) -> DataFrame:
    """``df`` by its keys in a fixed number of parts: for joins that make far more rows than they read, which would else be put together into a few tasks by their size."""
    return df.repartition(tasks, *keys)


def numbered(df: DataFrame, *order, out: str = "n") -> DataFrame:
    """``df`` with the place of each row (from 0) in an order that has no ties: rows are dealt by ranges, numbered in each, and moved up by the counts of those before."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = {r[0]: r[1] for r in ranged.groupBy("__part").agg(F.count(F.lit(1))).collect()}  # one row a partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    offsets = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else None
    place = F.col("__at") if offsets is None else F.col("__at") + offsets[F.col("__part")]
    return ranged.withColumn(out, place.cast("long")).drop("__part", "__at")


RUN = "tool_id string, run_id string, kind string, units string, params_json string, created_at timestamp"


def log_run(spark: SparkSession, path: str, tool: str, run: str, kind: str, units: str = "", params: dict | None = None) -> None:
    """Append what made a result to the run log, a Parquet table."""
    spark.createDataFrame([(tool, run, kind, units, json.dumps(params or {}, sort_keys=True, ensure_ascii=False))], RUN.rsplit(", ", 1)[0]).withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """The latest entry of each run and kind in a run log."""
    last = F.max_by(F.struct("tool_id", "units", "params_json", "created_at"), "created_at").alias("x")
    return spark.read.schema(RUN).parquet(path).groupBy("run_id", "kind").agg(last).select("x.tool_id", "run_id", "kind", "x.units", "x.params_json", "x.created_at")
