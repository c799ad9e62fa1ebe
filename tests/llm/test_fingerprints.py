import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from holloway.llm import fingerprints
from holloway.llm.fingerprints import differences, digests, fingerprint, fingerprinted, op12_fingerprints, sketch, with_next

from .cases import TEXTS, documents, empty


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def paragraphs(text):
    out = Counter()
    for line in (text or "").split("\n"):
        out.update(x for x in (re.split(r"(?<=[.!?])[ \t]+", line) if len(line) > fingerprints.LONG_LINE else [line]) if x)
    return set(out.items())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """(n_chars, sha256, near_edited, near_next) of each (id, text) in the order of the operator."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, signed(xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest())))
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(paragraphs(t), paragraphs(edited)), jaccard(paragraphs(t), paragraphs(after))))
    return out


def rows_of(df):
    return Counter((r[0], r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12)) for r in df.collect())


def rounded(rows):
    return Counter((*r[:3], round(r[3], 12), round(r[4], 12)) for r in rows)


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = op12_fingerprints(spark, sf).cache()
    assert rows_of(out) == rounded(brute(docs))
    text, prints = dict(docs), defaultdict(set)
    for r in out.collect():
        prints[text[r.doc_id]].add(r.fingerprint)
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1)
    assert all(len(p) == 1 for p in prints.values()) and len(set.union(*prints.values())) == len({frozenset(paragraphs(t)) for t in prints})
    out.unpersist()


def test_cases(spark, monkeypatch):
    docs = documents(spark).withColumn("at", F.lit("x")).withColumn("n_chars", F.lit("y"))
    want = rounded(brute(TEXTS))
    for size in (fingerprints.RANGE_BYTES, 50):
        monkeypatch.setattr(fingerprints, "RANGE_BYTES", size)
        assert rows_of(fingerprinted(docs)) == want
    assert fingerprinted(empty(spark)).count() == 0
    one = fingerprinted(spark.createDataFrame([("a", "x\ny")], "name string, body string"), "name", "body").collect()
    assert [(r.name, r.near_edited, r.near_next) for r in one] == [("a", 0.0, 1.0)]  # x and y, and x twice


def test_repeated_paragraphs_count(spark):
    d = spark.createDataFrame([(1, "a\na\nb"), (2, "a\nb"), (3, "b\na\n\na"), (4, ""), (5, None), (6, "\n\n")], "k int, text string").select("k", digests(F.coalesce("text", F.lit(""))).alias("d"))
    got = {r.k: r.d for r in d.collect()}
    h = lambda t: signed(xxhash.xxh64(t.encode(), seed=42).intdigest())
    assert got[2] == sorted([h("a"), h("b")]) and got[1] == got[3] != got[2] and h("b") in got[1] and got[4] == got[5] == got[6] == []
    long = "One sentence. " * 80 + "Another one!  The end"
    assert len(spark.createDataFrame([(long,)], "t string").select(digests(F.col("t")).alias("d")).first().d) == 3


def test_peeling_recovers_what_differs(spark):
    rng = random.Random(5)
    key = lambda: rng.randrange(-(1 << 63), 1 << 63)
    pairs = []
    for k, (shared, a, b) in enumerate([(0, 0, 0), (5, 0, 0), (0, 1, 0), (2000, 3, 2), (10, 40, 0), (0, 0, 300), (100, 500, 700), (1, 9, 9)]):
        common = [key() for _ in range(shared)]
        pairs.append((k, common + [key() for _ in range(a)], [key() for _ in range(b)] + common))
    df = spark.createDataFrame(pairs, "k int, a array<bigint>, b array<bigint>")
    for start in (0, 3):
        got = {r.k: r for r in differences(df, ["k"], start).collect()}
        assert len(got) == len(pairs)
        for k, a, b in pairs:
            assert sorted(got[k].only_a) == sorted(set(a) - set(b)) and sorted(got[k].only_b) == sorted(set(b) - set(a))
    # A small difference of large sets needs no larger sketch; a large one does, and none comes to the comparison of arrays.
    assert got[3].level == 3 and 5 <= got[6].level <= 11


def test_last_level_compares_arrays(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "LAST_LEVEL", 1)
    df = spark.createDataFrame([(1, list(range(900)), list(range(500, 1000)))], "k int, a array<bigint>, b array<bigint>")
    r = differences(df, ["k"], 1).first()
    assert sorted(r.only_a) == list(range(500)) and sorted(r.only_b) == list(range(900, 1000)) and r.level == 3


def test_sketches_subtract(spark):
    rows = spark.createDataFrame([(k, d) for k, ds in ((1, range(50)), (2, range(45, 60))) for d in ds], "k int, digest bigint")
    cells = {(r.k, r.cell): (r.n, r.digests, r.checks) for r in sketch(rows, ["k"], 2).collect()}
    minus = sketch(rows.select(F.lit(0).alias("k"), "digest", F.when(F.col("k") == 1, 1).otherwise(-1).alias("n")), ["k"], 2, "n")
    none = (0, 0, 0)
    for r in minus.collect():
        a, b = cells.get((1, r.cell), none), cells.get((2, r.cell), none)
        assert (r.n, r.digests, r.checks) == (a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2])
    prints = {r.k: r.fingerprint for r in fingerprint(rows, ["k"], 2).collect()}
    assert len(prints[1].split("-")) == sum(k == 1 for k, _ in cells) and re.fullmatch(r"([0-9a-f]+(\.[0-9a-f]+){3}(-|$))+", prints[1])


def test_plan_is_native_and_shuffles_texts_once(spark, sf):
    pairs = spark.createDataFrame([(1, [1], [2])], "at int, a array<bigint>, b array<bigint>")
    plan = fingerprints._recovered(pairs, ["at"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert with_next(docs).count() == docs.count()
