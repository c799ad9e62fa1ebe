import random

import pytest

from holloway.llm import decontaminate as op
from holloway.llm.decontaminate import clean, contaminated, hashes, normalise, op10_decontaminate, shingles

from .cases import LONG, documents, empty


def brute(docs, items):
    out = []
    for d, t in docs:
        have = shingles(normalise(t))
        for i, q in sorted(set(items), key=str):
            own = shingles(normalise(q))
            if own and len(own & have) >= 0.8 * len(own):
                out.append((d, i, len(own & have), len(own)))
    return sorted(out)


def random_case(seed):
    rng = random.Random(seed)
    words = lambda n: [rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 30)) for _ in range(n)]
    items = [(k, words(rng.choice([1, 3, 5, 6, 9, 20, 60]))) for k in range(40)]
    docs = []
    for d in range(150):
        body = words(rng.choice([3, 50, 400, 3000]))
        for _, w in rng.sample(items, rng.randint(0, 2)):
            w = list(w)
            if rng.random() < 0.5:  # changed in places, near the threshold
                w[rng.randrange(len(w))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = w
        docs.append((d, " ".join(body)))
    return docs, [(k, " ".join(w)) for k, w in items]


@pytest.mark.parametrize("seed", [1, 2])
def test_finds_all_that_brute_force_finds(spark, seed, monkeypatch):
    docs, items = random_case(seed)
    if seed == 2:
        monkeypatch.setattr(op, "ITEM_BYTES", 500)  # many blocks of items
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()) == brute(docs, items)


def test_hashes_tell_shingles_apart():
    t = normalise(LONG + " Ünïcode wörds and more of them here")
    assert len(hashes(t)) == len(shingles(t))
    assert len(hashes("a b")) == 1 and len(hashes("")) == 0


def test_cases(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog", "x"), (2, None, "x"), (3, "", "x"), (4, "WORD!", "x"), (1, "the quick brown fox jumps over the lazy dog", "x")], "item_id long, text string, doc_id string")
    rows = contaminated(documents(spark), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(8, 1), (11, 4)]
    assert clean(documents(spark), items).count() == documents(spark).count() - 2
    assert contaminated(empty(spark), items).count() == 0 and contaminated(documents(spark), items.limit(0)).count() == 0


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(tuple(r)[:4] for r in op10_decontaminate(spark, sf).collect()) == brute(docs, items)


def test_item_ids_of_other_types(spark):
    text = "one two three four five six seven eight nine ten"
    docs, items = spark.createDataFrame([("d", f"x {text} y")], "doc string, text string"), spark.createDataFrame([("i", text), (None, "no such words are in there at all")], "item string, text string")
    assert [(r.doc, r.item_id, r.containment) for r in contaminated(docs, items, "doc", item_col="item").collect()] == [("d", "i", 1.0)]
