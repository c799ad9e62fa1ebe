import hashlib
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from holloway.llm import alignment
from holloway.llm.alignment import Aligner, aligned, op11_alignment

from .cases import TEXTS, documents, empty

STRANGE = ["", " ", "  a", "a ", "a  b   c", "a▁b", "▁", "<|endoftext|> <s> <0x41> <unk>", "\n\n", "x\n y", "don't 'tis it's''s 5's", "日本語テキスト、 と English", "é́ ﬁx \xa0 x", "\x00 \x1c a\x1c b", "🙂 🙂🙂a", "a b   c",
           "word12345word " * 40, "字" * 300 + "。" + "語" * 300, "a" * 500, "x'" * 100 + "s" * 50, "1a" * 200, "=+/" * 90 + "zz", ("Thereisnospace" * 9 + "!") * 9, "\t" * 70, "_ " * 70 + "é" * 99]


@pytest.fixture(scope="module")
def aligner():
    return Aligner(public_tokenizers.path(alignment.A), public_tokenizers.path(alignment.B))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(alignment.A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B))


def brute(text, aligner, libraries):
    """(n_a, n_b, n_groups, hash, links) of one text, token by token over the whole text."""
    if not text:
        return 0, 0, 0, "", []
    a, b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    sides = [[aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]]
    if any(b"".join(s) != (" " + text).encode() for s in sides):
        return 0, 0, 0, "", []
    ends = [list(accumulate(map(len, s))) for s in sides]
    links, groups, i, j, begin = [], [], 0, 0, (0, 0)
    while i < len(a):
        links.append((a[i], b[j]))
        x, y = ends[0][i], ends[1][j]
        i, j = i + (x <= y), j + (y <= x)
        if x == y:
            groups.append(",".join(map(str, a[begin[0] : i])) + "|" + ",".join(map(str, b[begin[1] : j])))
            begin = i, j
    return len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def check(texts, aligner, libraries):
    for t, (sums, digest, pairs, times) in zip(texts, aligner.align(texts), strict=True):
        n_a, n_b, n_groups, want, links = brute(t, aligner, libraries)
        assert (sums, digest) == ([n_a, n_b, n_groups, len(links)], want), repr(t[:80])
        assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == Counter((p << 32) + q for p, q in links)


def test_strange_texts(aligner, libraries):
    check(STRANGE, aligner, libraries)


def test_cuts_of_long_parts_and_texts(aligner, libraries, monkeypatch):
    for long, chunk in ((1, 10), (3, 50), (40, 100), (4000, 1)):
        monkeypatch.setattr(alignment, "LONG", long)
        monkeypatch.setattr(alignment, "CHUNK", chunk)
        aligner.forget()
        check(STRANGE, aligner, libraries)
    monkeypatch.setattr(alignment, "KNOWN", 20)
    check(STRANGE * 3, aligner, libraries)


def test_random_texts(aligner, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "LONG", 5)
    aligner.forget()
    rng = random.Random(3)
    alphabet = [" ", "  ", "\n", "the", "ing", "é", "日", "本", "1", "22", "'", "s", "'s", "▁", "!", "<", "\t", "A", "🙂", "ß", "́", "\xa0", "\r\n"]
    check(["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(600)], aligner, libraries)


def expected(texts, aligner, libraries):
    rows = [brute(t or "", aligner, libraries) for t in texts]
    count = Counter(x for r in rows for x in r[4])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(*r[:3], len(r[4]), sum(count[x] == most[x[1]] for x in r[4]), sum(count[x] for x in r[4]), r[3]) for r in rows]


def test_query_equals_brute_force(spark, sf, aligner, libraries):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in op11_alignment(spark, sf).collect()}
    assert got == dict(zip(docs, expected(docs.values(), aligner, libraries), strict=True))


def test_cases(spark, aligner, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "PAIR_SHARE", 1 / 3)
    docs = documents(spark).withColumn("n_a", F.lit("x")).withColumn("Pair", F.lit("y"))
    rows = aligned(docs).collect()
    want = Counter(zip((i for i, _ in TEXTS), expected([t for _, t in TEXTS], aligner, libraries), strict=True))
    assert Counter((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in rows) == want
    assert {r.Pair for r in rows} == {"y"} and {r.fp for r in rows} == {"x"}
    assert aligned(empty(spark)).count() == 0


def test_hot_pairs(spark):
    """Nearly all documents hold the same pairs, more than one share's worth."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 > 0 THEN 'the cat' ELSE concat('the number ', id) END AS text")
    rows = aligned(docs).where("doc_id = 1 OR doc_id = 2").collect()
    assert rows[0][1:] == rows[1][1:] and rows[0].n_links == 2 and rows[0].count_sum == 4000 + 2666
