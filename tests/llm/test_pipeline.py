import re

import corpus_pipeline
from pyspark.sql import functions as F

from .cases import documents
from .test_decontaminate import brute
from .test_near_copies import left


def want(docs, items):
    """Ids of the (id, text) rows that stay, by plain loops."""
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    first = {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    docs = sorted(first.values(), key=lambda d: (d[0] is None, d[0] or 0))
    near = left([(k, t) for k, (_, t) in enumerate(docs)])
    docs = [docs[k] for k in near]
    leaked = {k for k, *_ in brute([(k, t) for k, (_, t) in enumerate(docs)], items)}
    return [i for k, (i, _) in enumerate(docs) if k not in leaked]


def test_rows_are_those_of_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    out = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in out.collect()) == sorted(want(docs, items))
    assert out.where("NOT round_trip").count() == 0


def test_odd_rows(spark, sf, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns; then a table with no rows."""
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    # Without labels no text has a language; one label is enough for all that have letters.
    docs = documents(spark).withColumn("lang", F.lit("en"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    key = lambda i: (i is None, i or 0)
    assert sorted(got, key=key) == sorted(want([(r.doc_id, r.text) for r in docs.collect()], items), key=key)
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
