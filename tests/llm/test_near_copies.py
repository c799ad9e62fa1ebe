import random

import corpus_pipeline
from holloway.llm import near_copies
from holloway.llm.near_copies import keep_one

from .cases import documents, empty


def shingles(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def left(rows):
    """Ids that stay, by comparing all pairs of 5-word sets."""
    rows = sorted(rows)
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [i for k, (i, _) in enumerate(rows) if find(k) == k]


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"x{rng.random()}"
    return " ".join(out)


def test_stage_links_by_similarity(spark, sf):
    """Close texts, chains and pairs on both sides of the threshold, most of them more than six SimHash bits apart."""
    rng = random.Random(1)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(6, 300))]
        texts += [" ".join(words), *(edited(rng, words, max(1, len(words) * e // 100)) for e in (1, 2, 3, 4))]
    base = [f"b{k}" for k in range(400)]
    texts += [edited(rng, base, rng.randrange(0, 9)) for _ in range(150)]
    texts += [" ".join(base[k : k + 100]) for k in range(0, 300, 8)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    t = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = left(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, t, sf).collect()) == want and len(want) < len(rows)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == left([(r.doc_id, r.text) for r in docs.collect()])


def test_cases(spark):
    kept = keep_one(documents(spark))
    assert kept.columns == documents(spark).columns and 0 < kept.count() <= documents(spark).count()
    assert keep_one(empty(spark)).count() == 0


def test_simhash_proposes_candidates(spark, monkeypatch):
    """What fingerprints within four bits join is proposed and confirmed even if no band does so."""
    base = " ".join(f"word{i}" for i in range(3000))
    texts = [base, base.replace("word1500 ", "other "), base.replace("word2999", "more"), " ".join(f"else{i}" for i in range(3000))]
    bits = lambda i, j: (near_copies.simhash.fingerprint(texts[i]) ^ near_copies.simhash.fingerprint(texts[j])).bit_count()
    assert bits(0, 1) <= 4 and bits(0, 2) <= 4 < bits(0, 3)
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    proposed = []
    own = near_copies._proposed
    monkeypatch.setattr(near_copies, "_proposed", lambda *a: proposed.append(own(*a)) or proposed[-1])
    monkeypatch.setattr(near_copies, "_pairs", lambda both, pairs=near_copies._pairs: pairs(proposed[-1]))  # no pair of the bands
    monkeypatch.setattr(near_copies, "_between", lambda members, sets: spark.createDataFrame([], "a long, b long"))
    assert sorted(r.doc_id for r in near_copies.keep_one(t).collect()) == [0, 3]
