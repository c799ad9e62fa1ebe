import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from holloway.llm import spelling
from holloway.llm.spelling import Automaton, near_words, op13_spelling, variants, words

from .cases import TEXTS, documents, empty


def brute_words(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_near(known):
    """Pairs of words one error apart, by the words that remain when a character is deleted."""
    left, near = defaultdict(set), defaultdict(set)
    for w in known:
        for k in range(len(w)):
            left[k, w[:k] + w[k + 1 :], 0].add(w)
            left[-1, w[:k] + w[k + 1 :], 1].add(w)
    for (_, rest, shorter), group in left.items():
        for a in group:
            near[a] |= group - {a} if not shorter else {rest} & known.keys()
            if shorter and rest in known:
                near[rest].add(a)
    return near


def expected(known):
    near, out = brute_near(known), {}
    for w, n in known.items():
        best = min(((-known[x], x) for x in near[w]), default=None)
        form = best[1] if best and -best[0] >= 5 * n else None
        out[w] = (n, len(near[w]), form, form and known[form])
    rows = {}
    for w, r in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows[w] = (*r, root)
    return rows


def rows_of(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows_of(op13_spelling(spark, sf))
    assert got == expected(brute_words(docs)) and any(r[2] for r in got.values())


def dictionary(seed, n=3000):
    rng = random.Random(seed)
    known = {}
    for _ in range(n):
        w = "".join(rng.choice("abé") for _ in range(rng.randrange(6, 12)))
        known[w] = rng.randrange(1, 5) * 6 ** rng.randrange(5)
    known |= {"aaaaaa": 7, "aaaaaaa": 40, "aaaaaaaa": 250, "z" * 700: 5, "z" * 701: 30, "z" * 350 + "y" + "z" * 350: 6}
    return known


@pytest.mark.parametrize("crowd,cells", [(50_000, 1_000_000), (20, 500), (2, 40)])
def test_near_words_of_dense_dictionaries(spark, monkeypatch, crowd, cells):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    monkeypatch.setattr(spelling, "CELLS", cells)
    known = dictionary(1, 1500 if crowd > 2 else 300)
    counted = spark.createDataFrame(list(known.items()), "word string, n long")
    pairs = near_words(counted).collect()
    want = brute_near(known)
    assert len(pairs) == len({(r.word, r.near) for r in pairs}) and all(one_apart(r.word, r.near) and r.near_n == known[r.near] for r in pairs)
    assert {(r.word, r.near) for r in pairs} == {(a, b) for a in want for b in want[a]}
    assert rows_of(variants(counted)) == expected(known)


def test_automaton_is_minimal_and_numbers_words():
    known = sorted({"".join(random.Random(k).choice("abc") for _ in range(4 + k % 4)) for k in range(200)} | {"abcd", "abcde"})
    size = np.array([len(w) for w in known])
    codes = np.zeros((len(known), size.max()), np.int32)
    for k, w in enumerate(known):
        codes[k, : len(w)] = [ord(c) - 96 for c in w]
    a = Automaton(codes, size)
    for k, w in enumerate(known):
        state, number = np.array([a.start]), np.array([0])
        for c in w:
            edge, there = a.step(state, np.array([ord(c) - 96]))
            assert there[0]
            state, number = a.target[edge], number + a.skip[edge]
        assert a.final[state[0]] and number[0] == k
    # As many states as there are different sets of endings.
    endings = {frozenset(w[len(p) :] for w in known if w.startswith(p)) for w in known for p in (w[:k] for k in range(len(w) + 1))}
    assert a.states == len(endings)


def test_words_and_cases(spark):
    docs = documents(spark)
    assert {r.word: r.n for r in words(docs).collect()} == brute_words(TEXTS)
    assert words(empty(spark)).count() == 0 and variants(words(empty(spark))).count() == 0
    texts = [(k, "Straße ÉCOLE école Œuvre naïveté×÷ " + "Banana bananas banana " * 3 + "x" * 3000) for k in range(400)]
    got = {r.word: r.n for r in words(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute_words(texts) and "x" * 3000 in got
    assert variants(words(spark.createDataFrame(texts, "a long, b string"), "a", "b")).where("word = 'bananas'").first().n_near == 1


def test_crowded_files_are_narrowed(spark, monkeypatch):
    """A third of all words share a half; no file that is searched holds more than its stretch allows."""
    monkeypatch.setattr(spelling, "CROWD", 30)
    seen = []
    searched = spelling._searched
    monkeypatch.setattr(spelling, "_searched", lambda rows: seen.append(rows.groupBy("file").count().agg(F.max("count")).first()[0]) or searched(rows))
    rng = random.Random(2)
    known = {"aaaaaa" + "".join(rng.choice("abcdef") for _ in range(6)): k for k in range(400)} | {"".join(rng.choice("abcdef") for _ in range(12)): 9 for _ in range(800)}
    got = near_words(spark.createDataFrame(list(known.items()), "word string, n long")).collect()
    want = brute_near(known)
    assert {(r.word, r.near) for r in got} == {(a, b) for a in want for b in want[a]} and len(seen) > 1 and max(seen) <= 36
