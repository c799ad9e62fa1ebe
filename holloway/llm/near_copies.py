"""Near copies: texts whose sets of word shingles have a Jaccard similarity of ``NUM / DEN`` (0.8) or more.

Candidates come from SimHash and MinHash. SimHash proposes what ``simhash.links`` joins: fingerprints of 64 bits within DISTANCE bits of each other, found by multi-index
hashing; equal fingerprints meet one of their sets. MinHash adds what is similar but farther apart in bits: BANDS bands of ROWS smallest hashes each, so a pair at exactly 0.8 is missed with a chance of
(1 - 0.8 ** ROWS) ** BANDS = 3e-6, a closer one with less. A candidate is linked only when the similarity of both whole
sets, compared as 64-bit hashes, reaches the threshold. Texts of one set are merged first.

Sets that share a band meet in two steps. First each is compared with the band's hub, the one that shares bands with the most others, and
what is confirmed is joined into components. Then an exact prefix join looks for links between the components that are left in a band:
shingles are ordered by how many of these sets have them, rare ones first, so two similar sets share one of their first shingles,
at places that leave enough shingles behind. Members of a token's main component are compared with outsiders only, so
a large group of near copies costs about one comparison a member and band; no pair that could join two components is left out.

Defined cases: those of ``simhash``: texts without words are one set; with fewer words than the shingle has, the whole
sequence is the only shingle; null ids come last; an empty table gives an empty result; further columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from . import simhash
from .common import cut, join_keyed, join_salted, keep_rows, row_key, stored
from .decontaminate import hashes

WORDS = 5
#: The least similarity of near copies, as a fraction of integers.
NUM, DEN = 4, 5
BANDS, ROWS = 32, 5
#: Shingles that are permuted at once.
PART = 1 << 12
#: Candidate pairs that are looked at once.
PAIRS = 1 << 20

_DRAWN = np.random.default_rng(5)
_TIMES = _DRAWN.integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _DRAWN.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _DRAWN.integers(1 << 62, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a whole text."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return hashes(b" ".join(parts).decode("utf-8", "surrogatepass"), words)


def bands(of: np.ndarray) -> np.ndarray:
    """The band keys of a set."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(of), PART):
        h = (of[i : i + PART][:, None] ^ _FLIPS) * _TIMES
        np.minimum(least, h.min(axis=0), out=least)
    mixed = least.reshape(BANDS, ROWS)
    mixed = ((mixed ^ (mixed >> np.uint64(32))) * _MIX).sum(axis=1, dtype=np.uint64)
    return mixed ^ (mixed >> np.uint64(29))


def _sketches(words: int):
    @F.pandas_udf("struct<sid: long, size: long, bands: array<long>, fp: long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, words) for t in texts]
        return pd.DataFrame({"sid": [np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64) for s in sets], "size": [len(s) for s in sets],
                             "bands": [bands(s).view(np.int64) for s in sets], "fp": np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)})

    return run


def _sets(words: int):
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words).view(np.int64) for t in texts], dtype=object)

    return run


def _pairs(both: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows (s, s_size, t, t_size), without those whose sizes alone rule them out."""
    fits = DEN * F.least("s_size", "t_size") >= NUM * F.greatest("s_size", "t_size")
    return both.where((F.col("s") != F.col("t")) & fits).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()


def _proposed(prints: DataFrame, distance: int = simhash.DISTANCE) -> DataFrame:
    """Candidate pairs (s, s_size, t, t_size) of sets (sid, size, fp) by their SimHash fingerprints: they span all that fingerprints within ``distance`` bits join."""
    middle = cut(prints.groupBy("fp").agg(F.min(F.struct("sid", "size")).alias("m"), F.count(F.lit(1)).alias("n")))
    pairs = [join_keyed(prints, middle, "fp", "n").select(F.col("sid").alias("s"), F.col("size").alias("s_size"), F.col("m.sid").alias("t"), F.col("m.size").alias("t_size"))]
    linked = cut(simhash.links(middle.select("fp"), distance))
    for side, k in (("a", "s"), ("b", "t")):
        own = cut(linked.groupBy(side).agg(F.count(F.lit(1)).alias("n")).join(middle.drop("n").withColumnRenamed("fp", side), side).select(side, "n", F.col("m").alias(k)))
        linked = join_keyed(linked, own, side, "n").drop("n")
    pairs.append(linked.select(F.col("s.sid").alias("s"), F.col("s.size").alias("s_size"), F.col("t.sid").alias("t"), F.col("t.size").alias("t_size")))
    return cut(pairs[0].unionAll(pairs[1]).where("s <> t"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets (sid, size, hashes) are similar enough."""
    pairs = cut(pairs)
    for side in "ab":
        counts = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
        own = stored(counts.join(sets, F.col(side) == F.col("sid")).select(side, "n", F.col("size").alias(f"{side}_size"), F.col("hashes").alias(f"{side}_set")))
        pairs = join_salted(pairs, own, side, "n", "b" if side == "a" else "a").drop("n")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return cut(pairs.where((NUM + DEN) * shared >= NUM * (F.col("a_size") + F.col("b_size"))).select("a", "b"))


def _reach(t: np.ndarray, sid: np.ndarray, left: np.ndarray, size: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that may be similar, of different roots, that share a token t; rows are sorted by t and size. ``left`` counts the tokens from t on."""
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    for lo, hi in zip(first, np.r_[first[1:], len(t)], strict=True):
        roots, count = np.unique(root[lo:hi], return_counts=True)
        if len(roots) < 2:
            continue
        out = lo + np.flatnonzero(root[lo:hi] != roots[count.argmax()])
        # A partner's size is within the ratio, and small enough for what is left of both to overlap.
        least = -(-NUM * size[out] // DEN)
        most = np.minimum(DEN * size[out] // NUM, (NUM + DEN) * left[out] // NUM - size[out])
        a, b = lo + np.searchsorted(size[lo:hi], least, "left"), lo + np.searchsorted(size[lo:hi], most, "right")
        n = np.maximum(b - a, 0)
        ends, k = np.cumsum(n), 0
        while k < len(out):
            m = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
            x = np.repeat(out[k:m], n[k:m])
            y = np.arange(len(x)) - np.repeat(np.cumsum(n[k:m]) - n[k:m], n[k:m]) + np.repeat(a[k:m], n[k:m])
            ok = (root[x] != root[y]) & ((NUM + DEN) * np.minimum(left[x], left[y]) >= NUM * (size[x] + size[y]))
            yield sid[x[ok]], sid[y[ok]]
            k = m


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of rows (t, sid, left, size, root) sorted by t and size; the rows of one token are held at once."""
    rest: list[list[np.ndarray]] = []

    def done(parts):
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        for x, y in _reach(*columns):
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0) if len(x) else np.empty((0, 2), np.int64)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if not len(part[0]):
            continue
        start = int(np.searchsorted(part[0], part[0][-1], "left"))  # the last token may go on in the next batch
        if start or rest and rest[-1][0][-1] != part[0][0]:
            yield from done([*rest, [c[:start] for c in part]])
            rest = []
        rest.append([c[start:] for c in part])
    if rest:
        yield from done(rest)


def _between(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of ``members`` (sid, size, root) with different roots: the exact prefix join."""
    long = cut(members.join(texts.select("sid", "hashes"), "sid").select("sid", "size", "root", F.explode("hashes").alias("t")))
    shared = cut(long.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    held = join_keyed(long, shared, "t", "n").groupBy("sid").agg(F.first("size").alias("size"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("n", "t"))).alias("ts"))
    # Tokens that no other set has come first; then those of ``ts``, up to the last place that can start an overlap.
    alone = F.col("size") - F.size("ts")
    keep = F.floor(F.col("size") * (DEN - NUM) / DEN).cast("int") + 1 - alone
    first = held.where(keep > 0).select("sid", "size", "root", alone.alias("alone"), F.posexplode(F.slice("ts", 1, keep.cast("int"))).alias("at", "x"))
    filed = first.select("x.t", "sid", (F.col("size") - F.col("alone") - F.col("at")).cast("long").alias("left"), F.col("size").cast("long"), "root")
    return filed.repartition("t").sortWithinPartitions("t", "size").mapInArrow(_partners, "a long, b long").distinct()


def _links(filed: DataFrame, hub_size: DataFrame, texts, proposed: DataFrame) -> DataFrame:
    """Confirmed links that span every component; ``filed`` has rows (key, sid, size, hub) of bands with several sets, ``proposed`` those of _proposed()."""
    sizes = cut(filed.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).join(hub_size, "hub"))  # a large group has one hub in all its bands
    stars = join_keyed(filed, sizes, "hub", "n").select(F.col("sid").alias("s"), F.col("size").alias("s_size"), F.col("hub").alias("t"), F.col("hub_size").alias("t_size"))
    first = _confirmed(_pairs(proposed.unionAll(stars)), texts)
    rooted = cut(filed.join(components(first), F.col("sid") == F.col("node"), "left").select("key", "sid", "size", F.coalesce("root", "sid").alias("root")))
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    members = cut(rooted.join(several, "key", "left_semi").select("sid", "size", "root").distinct())
    second = _confirmed(_between(members, texts), texts)
    return first.unionAll(second)


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame]:
    """(sid, one) for each set, one being its first row, and (node, root) of the linked sets."""
    order = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), _sketches(words)(F.col(text_col)).alias("s")).select("id", "key", "s.*")
    rows = stored(rows)
    sets = stored(rows.groupBy("sid").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.min(order).alias("one")))
    proposed = _proposed(cut(rows.select("sid", "size", "fp").distinct()))
    filed = sets.select(F.explode("bands").alias("key"), "sid", "size")
    crowds = cut(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = cut(join_keyed(filed, crowds, "key", "n"))
    # The set that meets the most others over all its bands is the likely middle of a group of copies.
    known = cut(met.groupBy("sid").agg(F.sum("n").alias("met"), F.count(F.lit(1)).alias("bands")))
    weighed = join_keyed(met, known, "sid", "bands")
    hubs = cut(weighed.groupBy("key").agg(F.max(F.struct("met", "sid")).alias("hub"), F.first("n").alias("n")).select("key", F.col("hub.sid").alias("hub"), "n"))
    met = cut(join_keyed(met.drop("n"), hubs, "key", "n").drop("n"))
    needed = met.select("sid").unionAll(proposed.select(F.explode(F.array("s", "t")).alias("sid"))).distinct().join(sets, "sid").select("sid", "size", F.col("one.key").alias("__key"))
    whole = docs.select(row_key(id_col, text_col).alias("__key"), F.col(text_col).alias("text")).join(needed, "__key").dropDuplicates(["sid"])
    texts = stored(whole.select("sid", "size", _sets(words)(F.col("text")).alias("hashes")))
    links = _links(met, texts.select(F.col("sid").alias("hub"), F.col("size").alias("hub_size")), texts, proposed)
    return sets.select("sid", "one"), components(links)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each component the one with the smallest id."""
    sets, found = _grouped(docs, id_col, text_col, words)
    rooted = sets.join(found, F.col("sid") == F.col("node"), "left").select(F.coalesce("root", "sid").alias("root"), "one")
    stays = rooted.groupBy("root").agg(F.min("one").alias("one")).select("one.key")
    return keep_rows(docs, stays, id_col, text_col)
