"""The driver's tables as landscape data, in Spark and in the same words in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.grid import Grid

CELL, WIDTH = 30.0, 100
XMIN, YMAX = 200_000.0, 600_000.0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rough elevation model: an order for each cell, 100 cells wide."""
    return read(spark, sf_dir, "orders").select(F.expr("o_orderkey DIV 100").alias("r"), (F.col("o_orderkey") % 100).alias("c"), (F.col("o_totalprice") / 1000).alias("z"))


def dem_grid(cells: DataFrame) -> Grid:
    """The grid of a 100 cells wide raster, as high as its last row."""
    return Grid(XMIN, YMAX, CELL, WIDTH, int(cells.agg(F.coalesce(F.max("r"), F.lit(0))).first()[0]) + 1)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites: suppliers and customers at whole-number places; suppliers of every fifth nation are hubs."""
    s = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_suppkey * 37 % 1009 AS x", "s_suppkey * 53 % 997 AS y", "s_acctbal AS z", "s_nationkey % 5 = 0 AS hub")
    c = read(spark, sf_dir, "customer").selectExpr("c_custkey + 1000000 AS id", "c_custkey * 41 % 1013 AS x", "c_custkey * 59 % 991 AS y", "c_acctbal AS z", "false AS hub")
    return s.unionByName(c)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangular zones of whole cells: a part each; first and last row and column."""
    return read(spark, sf_dir, "part").selectExpr("p_partkey AS zone", "p_partkey * 53 % 131 AS r0", "p_partkey * 37 % 89 AS c0", "p_partkey * 53 % 131 + p_size % 12 AS r1", "p_partkey * 37 % 89 + p_size % 7 AS c1", "p_brand AS brand")


DEM_SQL = "dem AS (SELECT o_orderkey // 100 AS r, o_orderkey % 100 AS c, o_totalprice / 1000 AS z FROM orders)"
NEAR_SQL = DEM_SQL + """, lines AS (SELECT r, c, z, CASE WHEN lag(c) OVER a = c - 1 THEN lag(z) OVER a END AS w, CASE WHEN lead(c) OVER a = c + 1 THEN lead(z) OVER a END AS e FROM dem WINDOW a AS (PARTITION BY r ORDER BY c)),
around AS (SELECT *, lag(r) OVER b = r - 1 AS above, lead(r) OVER b = r + 1 AS below, lag(w) OVER b AS nw, lag(z) OVER b AS n, lag(e) OVER b AS ne, lead(w) OVER b AS sw, lead(z) OVER b AS s, lead(e) OVER b AS se FROM lines WINDOW b AS (PARTITION BY c ORDER BY r)),
nb AS (SELECT r, c, z, nw, n, ne, w, e, sw, s, se FROM around WHERE above AND below AND w IS NOT NULL AND e IS NOT NULL AND nw IS NOT NULL AND ne IS NOT NULL AND sw IS NOT NULL AND se IS NOT NULL)"""
SLOPE_SQL = "degrees(atan(sqrt(pow(((ne + 2 * e + se) - (nw + 2 * w + sw)) / 240.0, 2) + pow(((sw + 2 * s + se) - (nw + 2 * n + ne)) / 240.0, 2))))"
SITES_SQL = ("sites AS (SELECT s_suppkey AS id, s_suppkey * 37 % 1009 AS x, s_suppkey * 53 % 997 AS y, s_acctbal AS z, s_nationkey % 5 = 0 AS hub FROM supplier UNION ALL "
             "SELECT c_custkey + 1000000, c_custkey * 41 % 1013, c_custkey * 59 % 991, c_acctbal, false FROM customer)")
ZONES_SQL = "zones AS (SELECT p_partkey AS zone, p_partkey * 53 % 131 AS r0, p_partkey * 37 % 89 AS c0, p_partkey * 53 % 131 + p_size % 12 AS r1, p_partkey * 37 % 89 + p_size % 7 AS c1, p_brand AS brand FROM part)"
