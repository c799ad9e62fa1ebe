"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text, with a partition for each batch. A batch is reduced to
one row for each digest (a partial aggregation, so a group of any size shuffles as one row a task), sort-merge anti-joined with
the index, whose side needs no shuffle, and what is new is appended. A batch that is added again replaces its
own partition, so a retry adds nothing. A new index is an empty table and takes the same way. Only DataFrame operations are used.

``deduplicate`` sends a whole table through a new index in batches of ascending ids, so the smallest id of each text is always the
first one seen, and reads every row's result from the index.

Defined cases: a null text counts as empty; runs of the six ASCII white-space characters count as one space, and
nothing else is changed (case, accents and other spaces matter); of equal texts the row with the smallest id
stays (null ids come last); of rows that repeat the id too, exactly one stays; an empty table gives an empty result; ids may be of any type that can be
ordered; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import cut, join_keyed, keep_rows, read, row_key, unique_name

SPACES = "[\\x20\\x09-\\x0D]+"
#: Rows of the index that one bucket is meant to hold, and the least number of buckets.
BUCKET_ROWS, BUCKETS = 1 << 22, 8
#: Batches in which a whole table is sent through a new index.
BATCHES = 2


def digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text after white space is normalised; null as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(id, digest, row) of each row of a batch, with ``keyed`` also key, by which keep_rows() finds the row again."""
    rows = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"), *[row_key(id_col, text_col).alias("key")] * keyed)
    return cut(rows).withColumn("row", F.monotonically_increasing_id())


class DigestIndex:
    """A bucketed, sorted table of every text seen so far, partitioned by batch.

    A batch has a row (digest, keep_id, row, group_size) for each of its digests; keep_id and row are those of the text's first
    row if the batch was the first to have it. ``group_size`` of all batches add up.
    """

    def __init__(self, spark: SparkSession, table: str, rows: int = 0, id_type: str = "bigint"):
        self.spark, self.table = spark, table
        if not spark.catalog.tableExists(table):
            self._create(max(BUCKETS, -(-rows // BUCKET_ROWS)), id_type)
        self.id_type = spark.table(table).schema["keep_id"].dataType
        self.buckets = int(next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r.col_name == "Num Buckets"))

    def _create(self, buckets: int, id_type: str) -> None:
        self.spark.sql(f"CREATE TABLE {self.table} (digest STRING, keep_id {id_type}, row BIGINT, group_size BIGINT, batch BIGINT) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') "
                       f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS")

    def _write(self, df: DataFrame) -> None:
        """Replace the partitions of the batches in ``df`` (the table overwrites dynamically); one file a bucket."""
        columns = df.select("digest", F.col("keep_id").cast(self.id_type), "row", "group_size", F.col("batch").cast("long"))
        columns.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table, overwrite=True)

    def seen(self, before: int | None = None) -> DataFrame:
        """(digest, first, group_size) of the index, or of the batches before one; first is (batch, row, keep_id). The aggregation
        runs inside the buckets, without a shuffle."""
        t = self.spark.table(self.table)
        t = t if before is None else t.where(F.col("batch") < before)
        first = F.max(F.when(F.col("row").isNotNull(), F.struct("batch", "row", "keep_id")))
        return t.groupBy("digest").agg(first.alias("first"), F.sum("group_size").alias("group_size"))

    def add(self, rows: DataFrame, batch: int) -> None:
        """Deduplicate a batch of digest_rows() against itself and the batches before it, and append it. Batches are numbered upwards."""
        order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
        groups = rows.groupBy("digest").agg(F.min(order).alias("one"), F.count(F.lit(1)).alias("group_size"))
        known = self.spark.table(self.table).where(F.col("batch") < batch).select("digest")
        novel = groups.join(known.hint("merge"), "digest", "left_anti").select("digest", F.col("one.id").alias("keep_id"), F.col("one.row").alias("row"), "group_size")
        again = groups.join(known.hint("merge"), "digest", "left_semi").select("digest", F.lit(None).cast(self.id_type).alias("keep_id"), F.lit(None).cast("long").alias("row"), "group_size")
        self._write(cut(novel.unionByName(again)).withColumn("batch", F.lit(batch)))

    def result(self, rows: DataFrame, batch: str | int, id_col: str = "doc_id") -> DataFrame:
        """For each row of digest_rows() of ``batch`` (a number, or the column that has it): id, keep_id, group_size (of all batches so far), kept, text_sha256, and key if
        ``rows`` have it. A text that an earlier batch had is never kept, whatever its id."""
        number = F.col(batch) if isinstance(batch, str) else F.lit(batch)
        mine = rows.select("digest").distinct()
        known = cut(self.seen().join(mine.hint("merge"), "digest", "left_semi"))
        return join_keyed(rows, known, "digest", "group_size").select(
            F.col("id").alias(id_col), F.col("first.keep_id").alias("keep_id"), "group_size",
            ((F.col("first.batch") == number) & (F.col("first.row") == F.col("row"))).alias("kept"),
            F.col("digest").alias("text_sha256"), *["key"] * ("key" in rows.columns))

    def compact(self) -> None:
        """Join all batches to one: one row for each digest and one sorted file for each bucket, in a table of its size."""
        rows = cut(self.seen().select("digest", "first.keep_id", "first.row", "group_size", F.coalesce("first.batch", F.lit(0)).alias("batch")))
        last = rows.agg(F.max("batch"), F.count(F.lit(1))).first()
        self.drop()
        self._create(max(BUCKETS, -(-last[1] // BUCKET_ROWS)), self.id_type.simpleString())
        self.__init__(self.spark, self.table)
        self._write(rows.withColumn("batch", F.lit(last[0] or 0)))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False, batches: int = BATCHES) -> DataFrame:
    """Every row of ``docs`` through a new index, in batches of ascending ids: id, keep_id, group_size, kept, text_sha256, with ``keyed`` also key."""
    rows = digest_rows(docs, id_col, text_col, keyed)
    kind = rows.schema["id"].dataType
    if isinstance(kind, NumericType):
        total, cuts = rows.agg(F.count(F.lit(1)), F.percentile_approx("id", [k / batches for k in range(1, batches)], 10_000)).first()
    else:  # where the ranges begin that Spark samples from the ids
        starts = [r.id for r in rows.select("id").where("id IS NOT NULL").repartitionByRange(batches, "id").groupBy(F.spark_partition_id()).agg(F.min("id").alias("id")).orderBy("id").collect()]
        total, cuts = rows.count(), starts[1:]
    number = F.lit(0)
    for at in cuts or []:
        number = number + F.when(F.col("id") <= F.lit(at), 0).otherwise(1)
    rows = rows.withColumn("batch", number.cast("long"))
    index = DigestIndex(docs.sparkSession, unique_name("digests"), total, kind.simpleString())
    for k in range(batches):
        index.add(rows.where(F.col("batch") == k), k)
    out = index.result(rows, "batch", id_col)
    index.drop()  # result() has cut what it read of it
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one for each text."""
    return keep_rows(docs, deduplicate(docs, id_col, text_col, keyed=True).where("kept"), id_col, text_col)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents through a new index: doc_id, keep_id, group_size, kept, text_sha256."""
    return deduplicate(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)
"""
