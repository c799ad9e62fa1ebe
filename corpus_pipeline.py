"""The training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Stages 1 to 4 return the columns of documents; the last returns doc_id, lang, source, n_tokens, token_ids and round_trip. SQL can
express neither the network, the similarities nor the encoding, so the rows are tested against a brute-force version.

Defined cases: a null, empty or letterless text goes in the first stage; texts of any length are read whole; of equal texts and of near
copies the row with the smallest id stays, null ids last, and of rows that repeat id and text one; an empty table gives an empty
result; further columns, whatever their names, stay up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holloway.llm import decontaminate, exact_dedup, lang_id, near_copies, sentencepiece
from holloway.llm.common import read, shared_dir, unique_name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those that are ``und`` (no letters) go."""
    return lang_id.identify(docs).where("lang_pred <> 'und'").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: candidates by SimHash, and by MinHash for those farther apart in bits; five-word similarity of 0.8 or more."""
    return near_copies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, checked by decoding them."""
    coded = sentencepiece.tokenize(docs.select("doc_id", "lang", "source", "text"))
    plain = F.translate(F.coalesce("text", F.lit("")), sentencepiece.SPACE, " ")
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.col("decoded") == plain).alias("round_trip"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminated), ("tokens", tokens)]

#: The stages are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, home = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/{unique_name('pipeline')}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
