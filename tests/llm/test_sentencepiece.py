import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from holloway.llm import sentencepiece as op
from holloway.llm.sentencepiece import MODEL, PieceModel, decoder, encoder, op4_sentencepiece, tokenize

from .cases import TEXTS, documents, empty

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


@pytest.fixture(scope="module")
def model():
    return PieceModel(public_tokenizers.path(MODEL))


def ids(model, texts):
    flat, n = model.encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]


def some_texts(model, n):
    rng = random.Random(2)
    chars, pieces = list(model.code), list(model.pieces)
    out = ["".join(rng.choice("abcdeinrst ▁.,") for _ in range(rng.randint(1, 60))) for _ in range(n)]
    out += ["".join(rng.choice(chars) for _ in range(rng.randint(1, 30))) for _ in range(n)]
    out += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(n)]
    return out + ["", " ", "a" * 3000, "ab" * 900 + "th" * 700, "   " * 500, "①ﬁ ½ x́ 　 \xa0 \r\n\x00b", "😀 emoji 👨‍👩‍👧", "\U0010ffff"]


def test_ids_are_the_librarys(model):
    texts = some_texts(model, 1500)
    got = ids(model, texts)
    assert got == LIBRARY.encode(texts, num_threads=1)
    assert [model.decode(x) for x in got] == [LIBRARY.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]


def test_blocks_and_lone_parts_change_nothing(model, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 50)
    monkeypatch.setattr(op, "LONG", 3)
    texts = [*some_texts(model, 40), "ab cd " * 200]
    assert ids(model, texts) == LIBRARY.encode(texts, num_threads=1)


def test_cases(spark):
    rows = tokenize(documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert list(r.token_ids) == LIBRARY.encode(r.text or "") and r.decoded == (r.text or "").replace("▁", " ")
    assert tokenize(empty(spark)).count() == 0
    t = spark.createDataFrame([("a b",), (None,)], "text string")
    assert [r[0] for r in t.select(decoder(spark)(encoder(spark)("text"))).collect()] == ["a b", ""]


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = spark.createDataFrame([(i, LIBRARY.encode(t or "")) for i, t in texts.items()], "doc_id long, ids array<int>").selectExpr("doc_id", "size(ids) AS n", "xxhash64(ids) AS h")
    rows = op4_sentencepiece(spark, sf).join(want, "doc_id").collect()
    assert len(rows) == len(texts) and all(r.round_trip and (r.n_tokens, r.ids_xxh64) == (r.n, r.h) and r.decoded_crc32 == zlib.crc32((texts[r.doc_id] or "").replace("▁", " ").encode()) for r in rows)
