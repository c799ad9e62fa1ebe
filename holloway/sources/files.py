"""Readers and writers: ASCII grids, legend tables, zipped bundles, manifests, staged folders."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import numbered
from .grid import Grid

NODATA = -9999.0
#: Limits of a bundle that is unpacked: entries, bytes, and the ratio of sizes from RATIO_FROM bytes on.
ENTRIES, BYTES, RATIO, RATIO_FROM = 5000, 2 << 30, 200, 10 << 20


def read_ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """Cells and grid of an ASCII grid; its six head lines are read on the driver, its rows in tasks. No-data cells are null."""
    lines = spark.read.text(path, wholetext=False)
    head = {k.lower(): float(v) for k, v in (r[0].split()[:2] for r in lines.limit(6).collect())}
    grid = Grid(head["xllcorner"], head["yllcorner"] + head["nrows"] * head["cellsize"], head["cellsize"], int(head["ncols"]), int(head["nrows"]))
    body = lines.where("NOT value RLIKE '^[A-Za-z]' AND trim(value) <> ''").select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("v"))
    rows = numbered(body, "line", out="r")  # one row a raster row
    cells = rows.select(F.col("r").cast("long"), F.posexplode("v").alias("c", "z")).select("r", F.col("c").cast("long"), F.col("z").cast("double").alias("z"))
    return cells.withColumn("z", F.when((F.col("z") != head.get("nodata_value", NODATA)) & ~F.isnan("z"), F.col("z"))), grid


def write_ascii_grid(cells: DataFrame, grid: Grid, path: str) -> None:
    """An ASCII grid as text parts in order: each task writes a range of raster rows, the head comes first. Read in name order, the parts are the file.
    Every cell of the grid is written; those without a row or a value have no data, those outside the grid are left out."""
    head = [f"ncols {grid.width}", f"nrows {grid.height}", f"xllcorner {grid.xmin!r}", f"yllcorner {grid.ymin!r}", f"cellsize {grid.res!r}", f"NODATA_value {NODATA!r}"]
    whole = grid.cells(cells.sparkSession).join(cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.when(~F.isnan("z"), F.col("z")).alias("z")), ["r", "c"], "left")
    lines = whole.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", F.coalesce("z", F.lit(NODATA)).alias("z")))).alias("v")).select("r", F.array_join(F.transform("v.z", lambda z: z.cast("string")), " ").alias("value"))
    first = cells.sparkSession.createDataFrame([(k - len(head), v) for k, v in enumerate(head)], "r long, value string")
    first.unionByName(lines.select(F.col("r").cast("long"), "value")).repartitionByRange("r").sortWithinPartitions("r").select("value").write.mode("errorifexists").text(path)


def read_legend(spark: SparkSession, path: str) -> DataFrame:
    """(value, r, g, b) of a legend table: comments and heads skipped, channels clamped, the last row of a value wins."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s*,\s*").alias("v")).where("size(v) >= 4 AND NOT v[0] LIKE '#%'")
    number = lambda k: F.expr(f"try_cast(v[{k}] AS DOUBLE)")
    parsed = rows.select("line", number(0).alias("value"), *[F.greatest(F.lit(0), F.least(F.lit(255), number(k).cast("int"))).alias("rgb"[k - 1]) for k in (1, 2, 3)]).dropna()
    return parsed.groupBy("value").agg(F.max_by(F.struct("r", "g", "b"), "line").alias("k")).select("value", "k.*").orderBy("value")


def bundle_fault(sizes: list[tuple[int, int]]) -> str | None:
    """Why a bundle of (size, packed size) entries is not unpacked; None if it may be."""
    total = sum(s for s, _ in sizes)
    if len(sizes) > ENTRIES:
        return f"more than {ENTRIES} entries"
    if total > BYTES:
        return f"more than {BYTES} bytes"
    if any(s > RATIO_FROM and s > RATIO * max(1, p) for s, p in sizes):
        return f"an entry grows more than {RATIO} times"
    return None


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, name, content, fault) of the files in zipped bundles; a bundle with a fault has one row and no content."""
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle, raw in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        infos = [i for i in z.infolist() if not i.is_dir()]
                        fault = bundle_fault([(i.file_size, i.compress_size) for i in infos])
                        if not fault:
                            for i in infos:
                                yield pd.DataFrame([(bundle, i.filename, z.read(i), None)], columns=["bundle", "name", "content", "fault"])
                except zipfile.BadZipFile as e:
                    fault = str(e)
                if fault:
                    yield pd.DataFrame([(bundle, None, None, fault)], columns=["bundle", "name", "content", "fault"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "bundle string, name string, content binary, fault string")


def manifest(layers: list[dict], spark: SparkSession) -> DataFrame:
    """(variable, file, source, kind, units, resampling) of an aligned stack; classes are resampled by the nearest cell."""
    rows = [(v["variable"], f"{v['variable']}.parquet", v.get("source"), v.get("kind", "continuous"), v.get("units"), "nearest" if v.get("kind") == "classes" else "bilinear") for v in layers]
    return spark.createDataFrame(rows, "variable string, file string, source string, kind string, units string, resampling string")


def _store(spark: SparkSession, *paths: str):
    """The store of some paths, and the paths on it."""
    jvm = spark.sparkContext._jvm
    found = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return found[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


MARK, STAGED = "_staged.json", ".staged-"


def stage_folder(spark: SparkSession, parent: str, run: str, purpose: str) -> str:
    """A new folder beside the final one, with a mark that says whose it is."""
    path = f"{parent.rstrip('/')}/{STAGED}{run}-{uuid.uuid4().hex[:8]}"
    store, (folder, mark) = _store(spark, path, f"{path}/{MARK}")
    if not store.mkdirs(folder, spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsPermission("700")):
        raise OSError(f"could not make {path}")
    out = store.create(mark, False)
    out.write(bytearray(json.dumps({"run": run, "purpose": purpose}).encode()))
    out.close()
    return path


def drop_stage(spark: SparkSession, path: str) -> bool:
    """Remove a folder made by stage_folder(); what has no mark or another name is left alone. Whether it was removed."""
    store, (folder, mark) = _store(spark, path, f"{path}/{MARK}")
    if not folder.getName().startswith(STAGED) or not store.exists(mark) or store.getFileLinkStatus(folder).isSymlink():
        return False
    return bool(store.delete(folder, True))


def publish_all(spark: SparkSession, moves: list[tuple[str, str]]) -> None:
    """Rename several staged files or folders; all are looked at before the first is moved, and none overwrites."""
    finals = [f for _, f in moves]
    if len(set(finals)) < len(finals):
        raise FileExistsError("two results have one name")
    for staged, final in moves:
        store, (source, target) = _store(spark, staged, final)
        if not store.exists(source):
            raise FileNotFoundError(staged)
        if store.exists(target):
            raise FileExistsError(final)
    for staged, final in moves:
        publish(spark, staged, final)


def write_raster(cells: DataFrame, grid: Grid, path: str, parent: str | None = None) -> None:
    """Cells and grid (grid.json) of one raster as a folder that appears whole or not at all: staged beside its place, checked, then renamed."""
    if not {"r", "c", "z"} <= set(cells.columns):
        raise ValueError("a raster has cells r, c and z")
    spark = cells.sparkSession
    staged = stage_folder(spark, parent or path.rstrip("/").rsplit("/", 1)[0], "raster", "write_raster")
    try:
        cells.select("r", "c", "z").where(grid.inside("r", "c")).write.parquet(f"{staged}/out/cells")
        spark.createDataFrame([(json.dumps(asdict(grid)),)], "value string").coalesce(1).write.text(f"{staged}/out/grid.json")
        publish(spark, f"{staged}/out", path)
    finally:
        drop_stage(spark, staged)


def read_raster(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """Cells and grid of write_raster()."""
    return spark.read.parquet(f"{path}/cells"), Grid(**json.loads(spark.read.text(f"{path}/grid.json").first()[0]))


def publish(spark: SparkSession, staged: str, final: str) -> None:
    """Rename a staged folder to its final name, on whatever store it is; never overwrites."""
    store, (source, target) = _store(spark, staged, final)
    if not store.exists(source):
        raise FileNotFoundError(staged)
    if store.exists(target):
        raise FileExistsError(final)
    if not store.rename(source, target):
        raise OSError(f"could not rename {staged} to {final}")
