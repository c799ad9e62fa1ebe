"""What the training-data operators share: tables, row keys and the library's lineage helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, join_keyed, join_salted, shared_dir, stored, unique_name

__all__ = ["cut", "free_name", "join_keyed", "join_salted", "keep_rows", "read", "row_key", "shared_dir", "stored", "unique_name"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    name, taken = "__own", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def row_key(id_col: str, text_col: str):
    """A key of a row made of its id and text; rows with equal keys are copies of one another."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.hex(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose row_key is in ``keys.key``, one for each key, with the columns of ``docs``.

    The semi-join and the removal of repeats share one shuffle and one sort.
    """
    name = free_name(docs)
    tagged = docs.withColumn(name, row_key(id_col, text_col))
    found = tagged.join(keys.select(F.col("key").alias(name)), name, "left_semi")
    return found.dropDuplicates([name]).select(*docs.columns)
