"""Token counts of whole texts with a public byte-level BPE tokenizer.

Texts are split where the tokenizer itself always splits: at a single space between two characters that are no
white space, which goes to the part on its right. What a part gives does not depend on its neighbours, so a text of any length is
counted in parts, and a part that repeats is encoded once: each batch encodes its new distinct parts, and a
bounded table keeps their lengths for the next batches. Parts of over LONG characters, as of scripts without spaces, are cut further:
between letters, digits and other characters, and inside words where no token of the vocabulary has the two bytes side by side. Only lengths leave the task.

Defined cases: null and empty texts have no tokens; special strings inside texts are special tokens, as is the library's
default; nothing is added, cut or padded; repeated rows are counted alike; an empty table gives an empty result; columns named n_bytes, n_tokens or
over_limit are replaced, all others stay.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import WORDS, byte_letters
from .common import read

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
#: Bytes of text that are counted at once and of parts encoded at once, parts that are remembered, and characters above which a part is cut further.
PART, ENCODED, KNOWN, LONG = 1 << 22, 1 << 18, 400_000, 4_000

_CUT = re.compile(r" (?<=\S )(?=\S)")


def _bytes(text: str) -> int:
    """The bytes of a text at most."""
    return len(text) * (1 if text.isascii() else 4)


class Counter:
    """Counts tokens with one tokenizer; one for each worker process."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        letters = byte_letters()
        self.beside = {(letters[t[k]], letters[t[k + 1]]) for t in vocabulary["model"]["vocab"] for k in range(len(t) - 1)}
        self.special = [t["content"] for t in vocabulary["added_tokens"]]

    def _lengths(self, texts: list[str]) -> list[int]:
        """Of texts as they are, in batches of about ENCODED bytes."""
        out, lo, size = [], 0, 0
        for hi, t in enumerate(texts, 1):
            size += _bytes(t)
            if size >= ENCODED or hi == len(texts):
                out += map(len, self.tokenizer.encode_batch_fast(texts[lo:hi], add_special_tokens=False))
                lo, size = hi, 0
        return out

    def _splits(self, text: str, at: int) -> bool:
        """Whether the tokenizer always splits before ``at``, but for what WORDS finds."""
        a, b = text[at - 1], text[at]
        return not (a.isspace() or b.isspace() or b == "'") and (a.encode()[-1], b.encode()[0]) not in self.beside

    def _pieces(self, text: str) -> Iterator[str]:
        """A long part in pieces of LONG characters or so; a run that has no place to cut stays whole."""
        last, wanted, word = 0, LONG, WORDS.search(text, LONG)
        while wanted < len(text):
            if word and word.start() < wanted:
                word = WORDS.search(text, wanted)
            stop = word.start() if word else len(text)
            at = next((k for k in range(wanted, stop) if self._splits(text, k)), stop)
            if at < len(text) and not any(text.find(s, max(0, at - len(s) + 1), at + len(s) - 1) >= 0 for s in self.special):
                yield text[last:at]
                last, wanted = at, at + LONG
            else:
                wanted = at + 1
        yield text[last:]

    def _chunks(self, text: str) -> Iterator[tuple[bool, str]]:
        """A text in chunks of about PART characters, and whether each is the first; a space before the others is left out."""
        at = 0
        while len(text) - at > PART:
            cut = _CUT.search(text, at + PART)
            if not cut:
                break
            yield at == 0, text[at : cut.start()]
            at = cut.end()
        yield at == 0, text[at:]

    def _count(self, chunks: list[tuple[int, bool, str]], total: list[int]) -> None:
        """Adds the tokens of chunks (place of the text, first, chunk) to those of their texts."""
        if len(self.known) > KNOWN:
            self.known.clear()
        apart, owners, words = [], [], []
        for k, first, text in chunks:
            parts = _CUT.split(text)
            strings = [parts.pop(0)] if first else []
            if len(text) > LONG and max(map(len, parts), default=0) > LONG:
                strings += [" " + p for p in parts if len(p) > LONG]
                parts = [p for p in parts if len(p) <= LONG]
            for s in strings:
                pieces = [s] if len(s) <= LONG else list(self._pieces(s))
                apart += pieces
                owners += [k] * len(pieces)
            words.append((k, parts))
        for k, n in zip(owners, self._lengths(apart), strict=True):
            total[k] += n
        new = list(set(chain.from_iterable(p for _, p in words)) - self.known.keys())
        self.known.update(zip(new, self._lengths([" " + p for p in new]), strict=True))
        length = self.known.__getitem__
        for k, parts in words:
            total[k] += sum(map(length, parts))

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each whole text."""
        total, batch, size = [0] * len(texts), [], 0
        for k, t in enumerate(texts):
            for first, chunk in self._chunks(t or ""):
                batch.append((k, first, chunk))
                size += _bytes(chunk)
                if size >= PART:
                    self._count(batch, total)
                    batch, size = [], 0
        self._count(batch, total)
        return total


_COUNTERS: dict[str, Counter] = {}


def token_count(path: str | None = None):
    """A function from a text column to its number of tokens."""
    path = path or public_tokenizers.path(TOKENIZER)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        return pd.Series(_COUNTERS[path].count(list(texts)), dtype="int64")

    return count


def with_counts(docs: DataFrame, text_col: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit."""
    counted = docs.withColumn("n_tokens", token_count(path)(F.col(text_col)))
    return counted.withColumn("n_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents: doc_id, n_bytes, n_tokens, over_limit."""
    return with_counts(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
