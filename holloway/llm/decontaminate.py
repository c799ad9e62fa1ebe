"""Benchmark decontamination by size-partitioned MinHash containment search.

A document contains a benchmark item when it has at least ``threshold`` of the item's distinct five-word shingles.
Jaccard similarity of a short item and a long document is tiny, so documents are put into classes by their number of
distinct shingles and a class has as many hash bins as fit its size: a sketch is the smallest hash in each bin. An
item has a sketch for every class. A shared smallest hash in any bin makes a candidate, which exact shingle containment
then confirms or drops. With two bins for each shingle a contained shingle is its bin's smallest with probability
0.79 at least, so an item of m shingles is missed with probability under 0.22 ** (0.8 m); items under TINY shingles
are therefore looked up with all shingles of the document instead of a sketch.

Items are sent to the tasks in blocks of about ITEM_BYTES of text, one block at a time, so neither the driver nor a task ever
holds more than one; each block scans all documents, with no shuffle of texts and no state that grows with the documents.

Defined cases: words are runs of letters and digits of the lower-cased text; a text of one to four words has its whole
sequence as only shingle; null, empty and wordless texts and items match nothing; repeated documents each get
their rows, repeated (item_id, text) rows count once, and items that share an id are searched apart; empty tables give empty results; further columns, whatever their names,
are not looked at, and clean() returns them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StructField, StructType

from .common import cut, read, stored

WORDS, THRESHOLD = 5, 0.8
#: Bytes of item text that are sent to the tasks at once.
ITEM_BYTES = 16 << 20
#: Items with fewer shingles are looked up exactly.
TINY = 12
#: Shingles hashed at once.
PART = 1 << 15
#: Size classes: up to 2 ** 40 shingles.
CLASSES = 40

_WORD = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15


def matches(id_type: DataType) -> ArrayType:
    return ArrayType(StructType([StructField("item_id", id_type), StructField("n_shared", LongType()), StructField("n_item", LongType())]))


def normalise(text: str | None) -> str:
    """The words of a text, joined by single spaces."""
    return " ".join(_WORD.findall((text or "").lower()))


def shingles(words: str, k: int = WORDS) -> set[str]:
    """The distinct shingles of a normalised text."""
    w = words.split(" ") if words else []
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)], dtype=np.uint64)
        return up, np.cumprod(np.r_[np.uint64(1), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)


def hashes(words: str, k: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a normalised text, each a polynomial over its bytes."""
    if not words:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(words.encode("utf-8", "surrogatepass"), np.uint8)
    spaces = np.flatnonzero(raw == 32)
    starts, ends = np.r_[0, spaces + 1], np.r_[spaces, len(raw)]
    n, out = max(1, len(starts) - k + 1), []
    for lo in range(0, n, PART):
        hi = min(n, lo + PART)
        first, last = starts[lo:hi], ends[np.minimum(np.arange(lo, hi) + k - 1, len(ends) - 1)]
        part = raw[first[0] : last[-1]].astype(np.uint64) + np.uint64(1)
        size = 1 << max(16, int(len(part)).bit_length())
        up, down = _powers(size)
        sums = np.r_[np.uint64(0), np.cumsum(part * up[: len(part)], dtype=np.uint64)]
        at = first - first[0]
        h = (sums[last - first[0]] - sums[at]) * down[at]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        out.append(h)
    return np.unique(np.concatenate(out))


def size_class(n: int) -> int:
    return max(1, int(n - 1).bit_length())


def sketch(sorted_hashes: np.ndarray, size: int) -> np.ndarray:
    """The smallest hash in each of the bins of a size class; bins are the leading bits of a hash."""
    bins = sorted_hashes >> np.uint64(63 - size)
    return sorted_hashes[np.r_[True, bins[1:] != bins[:-1]]] if len(bins) else sorted_hashes


class ItemIndex:
    """Sketches of a block of items for each size class, and their shingles."""

    def __init__(self, items: list[tuple[int, str]], k: int = WORDS, threshold: float = THRESHOLD):
        self.k, self.threshold = k, threshold
        self.items = [(i, s) for i, s in ((i, shingles(normalise(t), k)) for i, t in items) if s]
        self.hashes = [hashes(normalise(t), k) for i, t in items if normalise(t)]
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.tiny = self._table([h if len(h) < TINY else h[:0] for h in self.hashes])

    @staticmethod
    def _table(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([np.empty(0, np.uint64), *parts])
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        return keys[order], owner[order]

    def table(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in self.tables:
            self.tables[size] = self._table([sketch(h, size) if len(h) >= TINY else h[:0] for h in self.hashes])
        return self.tables[size]

    @staticmethod
    def _hits(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> set[int]:
        known, owner = table
        if not len(known):
            return set()
        lo, hi = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
        return {int(o) for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True) for o in owner[a:b]}

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, n_shared, n_item) of every item that the text contains."""
        words = normalise(text)
        own = hashes(words, self.k)
        if not len(own):
            return []
        size = size_class(len(own))
        found = self._hits(self.table(size), sketch(own, size)) | self._hits(self.tiny, own)
        if not found:
            return []
        have = shingles(words, self.k)
        out = [(self.items[i][0], len(self.items[i][1] & have), len(self.items[i][1])) for i in sorted(found)]
        return [x for x in out if x[1] >= self.threshold * x[2]]


def _finder(index, id_type):
    @F.pandas_udf(matches(id_type))
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"item_id": i, "n_shared": a, "n_item": b} for i, a, b in index.value.search(t)] for t in texts], dtype=object)

    return find


def finders(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", k: int = WORDS, threshold: float = THRESHOLD) -> Iterator[tuple[Callable[[Column], Column], bool]]:
    """For each block of items a function from a text column to its matches (array of item_id, n_shared, n_item), and whether it is the only one.

    A block is read and sent when its turn comes and dropped after it: the caller must have cut what it made of a block that is not the only one.
    """
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // ITEM_BYTES))
    filed = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    filed = filed if n == 1 else cut(filed)
    for b in range(n):
        sent = sc.broadcast(ItemIndex([(r.id, r.text) for r in filed.where(F.col("block") == b).orderBy("id", "text").collect()], k, threshold))
        yield _finder(sent, items.schema["id"].dataType), n == 1
        if n > 1:
            sent.destroy()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row (id, item_id, n_shared, n_item, containment) for each document and each item that it contains."""
    out = None
    for find, only in finders(benchmark, **options):
        found = docs.select(F.col(id_col), F.explode(find(F.col(text_col))).alias("m")).select(
            id_col, "m.item_id", "m.n_shared", "m.n_item", (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"))
        found = found if only else cut(found)
        out = found if out is None else out.unionAll(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that contain no item."""
    for find, only in finders(benchmark, **options):
        left = docs.where(F.size(find(F.col(text_col))) == 0)
        docs = left if only else stored(left)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM d WHERE len(w) > 0)),
iq AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM iq GROUP BY 1),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN iq USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item
"""
