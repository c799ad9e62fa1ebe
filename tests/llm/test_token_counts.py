import random
import subprocess
import sys

import public_tokenizers
from tokenizers import Tokenizer

from holloway.llm import token_counts
from holloway.llm.token_counts import Counter, op3_token_counts, with_counts

from .cases import TEXTS, documents, empty

PATH = public_tokenizers.path(token_counts.TOKENIZER)


def lengths(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_parts_give_the_whole():
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "a", "the", "'s", "123", ".", "<|endoftext|>", "é", "\t", "\x1c", "\xa0", "　", "日", "😀", " x", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert Counter(PATH).count(texts) == lengths(texts)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN", 2)
    monkeypatch.setattr(token_counts, "PART", 10)
    texts = [t for _, t in TEXTS[:8]]
    assert Counter(PATH).count(texts) == lengths(texts)


def test_long_texts_without_spaces(monkeypatch):
    rng = random.Random(6)
    texts = ["日本語の文章、" * 700, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(9000)), "aGVsbG8gd29ybGQ" * 900, "x<|endoftext|>y" * 900, "a" * 9000, "don't" * 3000, "'s'll!!''" * 1500, "é́ß" * 3000, "🙂👨‍👩‍👧" * 2000, "1234567890" * 999 + " x", "\t\n" * 5000 + "x"]
    counter = Counter(PATH)
    assert counter.count(texts) == lengths(texts)
    assert max(map(len, counter._pieces(texts[1]))) < 2 * token_counts.LONG
    alphabet = ["日", "本", "a", "the", "'", "s", "'ll", "1", "22", "!", "<|endoftext|>", "<|", "é", "\n", "  ", " ", "🙂", "ß", "\xa0", "́"]
    for long, part in ((1, 30), (3, 10), (7, 1)):
        monkeypatch.setattr(token_counts, "LONG", long)
        monkeypatch.setattr(token_counts, "PART", part)
        mixed = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(500)]
        assert Counter(PATH).count(mixed) == lengths(mixed)


def test_a_very_long_text_takes_bounded_memory():
    """Twenty million characters without a space: a process of 2 GB of data counts them."""
    code = f"""
import resource
resource.setrlimit(resource.RLIMIT_DATA, (2 << 30, 2 << 30))
from holloway.llm.token_counts import Counter
c = Counter({PATH!r})
part = "河水上涨，到我们离开山上的房子的时候，水已经漫过了公路。"
n = c.count([part * 40])[0]
assert abs(c.count([part * 700_000])[0] - n * 17_500) < 700_000
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)


def test_cases_and_query(spark, sf):
    got = {(r.doc_id, r.text): r for r in with_counts(documents(spark)).collect()}
    for (i, t), n in zip(TEXTS, lengths([t for _, t in TEXTS]), strict=True):
        r = got[i, t]
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((t or "").encode()), n > 1024)
    assert with_counts(empty(spark)).count() == 0
    rows = op3_token_counts(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert [r.n_tokens for r in rows] == lengths([r.text for r in rows])
