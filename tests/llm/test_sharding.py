import zlib

import numpy as np
from pyspark.sql import functions as F

from holloway.llm.sharding import communication_matrix, hypergeometric, op1_sharding, shuffle, write_shards

from .cases import TEXTS, documents, empty


def test_draws_follow_the_hypergeometric_law(spark):
    for good, bad, sample in ((5, 5, 4), (3, 40, 10), (1000, 3000, 500), (20, 7, 20), (2, 2, 1)):
        got = np.array([r[0] for r in spark.range(3000).select(F.expr(hypergeometric(f"{good}L", f"{bad}L", f"{sample}L", "id")).alias("x")).collect()])
        want = np.random.default_rng(1).hypergeometric(good, bad, sample, 200_000)
        n = sample + 1
        assert np.abs(np.bincount(got, minlength=n) / len(got) - np.bincount(want, minlength=n) / len(want)).sum() / 2 < 0.1
        assert abs(got.mean() - want.mean()) < 4 * want.std() / 3000**0.5 + 0.05


def test_matrix_has_exact_margins(spark):
    sizes = [(i, 1 + i % 7) for i in range(300)]
    total = sum(n for _, n in sizes)
    rows = communication_matrix(spark.createDataFrame(sizes, "part long, n long"), 8, total, 299).collect()
    m = np.array([r.counts for r in sorted(rows)])
    assert (m.sum(axis=1) == [n for _, n in sizes]).all() and (m >= 0).all()
    assert sorted(m.sum(axis=0)) == sorted([total // 8 + (j < total % 8) for j in range(8)])


def test_every_row_has_one_place(spark):
    out = shuffle(documents(spark)).collect()
    assert len(out) == len(TEXTS)
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(TEXTS) // 8, len(TEXTS) // 8 + 1)
    assert shuffle(empty(spark)).count() == 0


def test_order_is_shuffled_and_repeatable(spark):
    t = spark.range(0, 4000, 1, 5)
    a, b = ([tuple(r) for r in shuffle(t).orderBy("shard", "slot").collect()] for _ in range(2))
    assert a == b
    ids = np.array([r[0] for r in a])
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.06


def test_rows_of_the_query(spark, sf):
    """Size and checksum of every row, and gapless slots in shards whose counts are at most one apart."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op1_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None
    counts = [sorted(r.slot for r in rows if r.shard == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1


def test_query_and_files(spark, sf, tmp_path):
    out = op1_sharding(spark, sf)
    assert out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    write_shards(out, str(tmp_path / "shards"), 8)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == out.count()
