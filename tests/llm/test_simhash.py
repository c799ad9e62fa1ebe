import re

import numpy as np
import pytest
import xxhash

from holloway.llm import simhash
from holloway.llm.simhash import fingerprint, keep_one, links, near_groups, op8_simhash, segment_plan

from .cases import TEXTS, documents, empty


def plain(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, bits=4):
    """Smallest id that each row reaches, by comparing all pairs."""
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= bits:
                root[find(i)] = find(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(ids.get(find(k), i), i)
    return [ids.get(find(k)) for k in range(len(rows))]


def test_fingerprints():
    for _, t in TEXTS:
        assert fingerprint(t) == plain(t)


def test_plan_covers_every_link():
    for n in (10, 1 << 23, 1 << 35):
        for d in (4, 6):
            plan = segment_plan(n, d)
            assert sum(b for _, b, _ in plan) == 64 and sum(r + 1 for *_, r in plan) > d


@pytest.mark.parametrize("parts, most, held", [(3, simhash.GROUP, simhash.PAIRS), (2, simhash.GROUP, simhash.PAIRS), (3, 8, simhash.PAIRS), (2, 3, 16), (3, 1, 1)])
def test_links_span_the_components(spark, monkeypatch, parts, most, held):
    """Also where nearly all values are split into pieces and blocks, and where few rows are held at once."""
    monkeypatch.setattr(simhash, "GROUP", most)
    monkeypatch.setattr(simhash, "PAIRS", held)
    rng = np.random.default_rng(parts)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for c in centres for _ in range(60 if c == centres[0] else 8)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in near})
    if parts == 2:
        monkeypatch.setattr(simhash, "segment_plan", lambda n, d=4: [(0, 32, 2), (32, 32, 1)])
    got = links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    unsigned = lambda v: v & (1 << 64) - 1
    assert all((unsigned(a) ^ unsigned(b)).bit_count() <= 4 for a, b in got)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in got:
        root[find(a)] = find(b)
    want = groups([(k, unsigned(v)) for k, v in enumerate(values)])
    same = {}
    for k, v in enumerate(values):
        assert same.setdefault(want[k], find(v)) == find(v)
    assert len({find(v) for v in values}) == len(set(want))


def test_crowded_values_are_split(spark):
    """Thousands of fingerprints share a segment: none of the finer keys holds more than the limit."""
    rng = np.random.default_rng(5)
    fps = [(int(v) << 21 | 77,) for v in rng.integers(0, 1 << 41, 3000)] + [((1 << 41 | int(v)) << 21 | 77,) for v in rng.integers(0, 1 << 30, 3000)]
    table, plan = spark.createDataFrame(sorted(set(fps)), "fp long"), segment_plan(6000)
    groups = lambda rows: rows.where("NOT probe").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert groups(simhash._filed(table, plan)) == len(set(fps))
    assert groups(simhash._split(table, plan, 4, 200)) <= 400  # blocks are dealt by a hash


def test_cases(spark):
    rows = near_groups(documents(spark)).collect()
    want = groups([(i, plain(t)) for i, t in TEXTS])
    key = lambda x: tuple(str(v) for v in x)
    assert sorted([tuple(r) for r in rows], key=key) == sorted([(i, f"{plain(t):016x}", c) for (i, t), c in zip(TEXTS, want, strict=True)], key=key)
    assert near_groups(empty(spark)).count() == 0 and keep_one(empty(spark)).count() == 0
    kept = keep_one(documents(spark))
    assert kept.columns == documents(spark).columns and kept.count() == len(set(groups([(i, plain(t)) for i, t in TEXTS])))


def test_query(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([t.doc_id for t in texts], groups([(t.doc_id, plain(t.text)) for t in texts]), strict=True))
    assert {r.doc_id: r.component_id for r in op8_simhash(spark, sf).collect()} == want
