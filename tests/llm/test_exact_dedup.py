import hashlib
import re
from collections import defaultdict

from holloway.llm.common import unique_name
from holloway.llm.exact_dedup import DigestIndex, deduplicate, digest_rows, keep_first

from .cases import TEXTS, documents, empty


def digest(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()


def test_cases(spark):
    rows = deduplicate(documents(spark)).collect()
    by = defaultdict(list)
    for i, t in TEXTS:
        by[digest(t)].append(i)
    assert len(rows) == len(TEXTS)
    for r in rows:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in rows) == len(by) and all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert deduplicate(empty(spark)).count() == 0
    kept = keep_first(documents(spark))
    assert kept.columns == documents(spark).columns and kept.count() == len(by) and keep_first(empty(spark)).count() == 0
    clash = documents(spark).selectExpr("*", "'x' AS __key", "'y' AS batch", "'z' AS keep_id")
    assert {(r["__key"], r.batch, r.keep_id) for r in keep_first(clash).collect()} == {("x", "y", "z")}


def test_later_batches_and_retries(spark):
    index = DigestIndex(spark, unique_name("t"))
    first = digest_rows(spark.createDataFrame([(5, "a"), (6, "b"), (7, "a")], "doc_id long, text string"))
    second = digest_rows(spark.createDataFrame([(1, "a "), (2, "a"), (3, "c"), (4, "c")], "doc_id long, text string"))
    index.add(first, 0)
    for _ in range(2):  # a retried batch replaces itself
        index.add(second, 1)
        rows = {r.doc_id: r for r in index.result(second, 1).collect()}
        assert [(rows[k].keep_id, rows[k].group_size, rows[k].kept) for k in (1, 2, 3, 4)] == [(1, 1, True), (5, 3, False), (3, 2, True), (3, 2, False)]
    for _ in range(2):
        assert {r.first.keep_id: r.group_size for r in index.seen().collect()} == {5: 3, 6: 1, 1: 1, 3: 2}
        index.compact()
    assert DigestIndex(spark, index.table).buckets == index.buckets
    third = digest_rows(spark.createDataFrame([(9, "b"), (8, "d")], "doc_id long, text string"))
    index.add(third, 2)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in index.result(third, 2).collect()} == {9: (6, 2, False), 8: (8, 1, True)}
    index.drop()


def test_plan_reads_the_buckets(spark):
    index = DigestIndex(spark, unique_name("t"))
    index.add(digest_rows(spark.range(50).selectExpr("id AS doc_id", "string(id % 30) AS text")), 0)
    known = spark.table(index.table)
    plan = lambda t: t._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(index.seen())
    new = spark.range(9).selectExpr("string(id) AS digest").repartition(index.buckets, "digest")
    anti = plan(new.join(known.hint("merge"), "digest", "left_anti"))
    assert "SortMergeJoin" in anti and anti.count("Exchange hashpartitioning") <= 1 and f"Bucketed: true" in anti
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digests_")]
    index.drop()


def test_hot_group(spark):
    t = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    rows = deduplicate(t)
    assert rows.where("kept").count() == 4001 and rows.where("group_size = 2000 AND keep_id = 0").count() == 2000


def test_ids_of_other_types(spark):
    t = spark.createDataFrame([(f"id{k:02d}", "same" if k % 3 else f"t{k}") for k in range(30)] + [(None, "same"), (None, "x")], "name string, text string")
    rows = deduplicate(t, "name", batches=3).collect()
    assert {r.name: r.keep_id for r in rows if r.text_sha256 == digest("same")} == {**{f"id{k:02d}": "id01" for k in range(30) if k % 3}, None: "id01"}
    assert sum(r.kept for r in rows) == 12 and keep_first(t, "name").count() == 12
