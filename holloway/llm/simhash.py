"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits: the majority of the XXH64 values of a text's word shingles. Two fingerprints within
``distance`` bits are linked. To find them, the bits are cut into segments with radii r1, r2, ... where the sum of
(r + 1) is over the distance, so that two linked fingerprints are within the radius in one segment at least. Each
fingerprint is filed under its segments' values and looks up the values of the Hamming ball round them; what
meets there is verified on all 64 bits. Of two segment values the larger looks up the smaller, which halves the ball.

Equal fingerprints are merged first. Fingerprints that meet under one value give a spanning forest of their links,
not all pairs, so a large group of near copies costs as many rows as it has members; components are unchanged.

A value under which many fingerprints are filed is split: within it, two linked fingerprints agree in at least one of distance + 1
pieces of their other bits, so its rows meet under these pieces in its place. A piece that still has too many is dealt into
blocks; its fingerprints are filed in their own block and look up the earlier ones. No link is lost in either step.

Defined cases: null, empty and blank texts have no words and fingerprint zero, linked like any other; with fewer
words than the shingle has, the whole sequence is the only shingle; rows that repeat an id are separate rows with
one id; rows with a null id take the component of their fingerprint, whose id is null if all its ids are null;
an empty table gives an empty result; further columns are not looked at, and keep_one() returns them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import cut, join_keyed, keep_rows, read, row_key

WORDS, SEED, DISTANCE = 4, 42, 4
#: Shingles whose bits are counted at once; a longer text is counted in parts.
PART = 1 << 16
#: Pairs that are compared at once, and look-ups that a task holds at once.
PAIRS = 1 << 20
#: A segment value with more fingerprints is split; so many are split at most (the limit rises with the input), which bounds what is broadcast.
GROUP, SPLIT = 1 << 12, 100_000
#: The bits of a key from here on are its segment's number.
TAG = 58


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a whole text."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    shingles = zip(*(parts[i:] for i in range(words)), strict=False) if len(parts) >= words else [parts]
    n = max(1, len(parts) - words + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, PART):
        bits = np.unpackbits(hashes[i : i + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return run


def segment_plan(n: int, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each segment. As in multi-index hashing, segments grow with log2(n): the more fingerprints
    there are, the fewer and longer the segments and the wider the balls; any plan finds every link."""
    parts = max(2, (distance + 2) // 2)
    while parts > 2 and 64 // parts < n.bit_length() - 7:
        parts -= 1
    radii = [(distance + 1) // parts + (i < (distance + 1) % parts) - 1 for i in range(parts)]
    plan, at = [], 0
    for i, r in enumerate(radii):
        bits = (64 - at) // (parts - i)
        plan.append((at, bits, r))
        at += bits
    return plan


def _value(shift: int, bits: int):
    return F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND((1 << bits) - 1)


def _segment_keys(i: int, shift: int, bits: int, radius: int):
    """Structs (key, probe) of a fingerprint in segment i: its value, then the smaller values of the ball round it."""
    value, tag = _value(shift, bits), i << TAG
    own = F.array(F.struct(value.bitwiseOR(tag).alias("key"), F.lit(False).alias("probe")))
    masks = [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(bits), r)]
    if not masks:
        return own
    ball = F.filter(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m)), lambda k: k < value)
    return F.concat(own, F.transform(ball, lambda k: F.struct(k.bitwiseOR(tag).alias("key"), F.lit(True).alias("probe"))))


def _filed(fps: DataFrame, plan: list[tuple[int, int, int]], lookups: bool = True) -> DataFrame:
    """Rows (key, probe, fp): a fingerprint filed under its own segment values, and its look-ups of smaller ones."""
    keys = [_segment_keys(i, shift, bits, radius if lookups else 0) for i, (shift, bits, radius) in enumerate(plan)]
    return fps.select("fp", F.explode(F.concat(*keys)).alias("k")).select("k.key", "k.probe", "fp")


def _pieces(plan: list[tuple[int, int, int]], distance: int):
    """Finer keys of a row (key, fp): the bits outside its segment, cut into distance + 1 pieces. Equal hashes of
    different pieces only cost comparisons, for links are verified on all bits."""
    keys = None
    for i, (shift, bits, _) in enumerate(plan):
        low = F.col("fp").bitwiseAND((1 << shift) - 1)
        rest = low if shift + bits == 64 else F.shiftleft(F.shiftrightunsigned(F.col("fp"), shift + bits), shift).bitwiseOR(low)
        cuts = [(64 - bits) * j // (distance + 1) for j in range(distance + 2)]
        here = F.array(*[F.xxhash64("key", F.lit(j), F.shiftrightunsigned(rest, lo).bitwiseAND((1 << hi - lo) - 1)) for j, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))])
        mine = F.shiftrightunsigned(F.col("key"), TAG) == i
        keys = F.when(mine, here) if keys is None else keys.when(mine, here)
    return keys


def _blocks():
    """Keys of a row in a group of ``parts`` blocks: filed in its own block, it looks up the earlier ones; a look-up goes to all."""
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    last = F.when(F.col("probe"), F.col("parts") - 1).otherwise(own)
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda b: F.struct(F.xxhash64("key", b).alias("key"), (F.col("probe") | (b < own)).alias("probe")))


def _split(fps: DataFrame, plan: list[tuple[int, int, int]], distance: int, most: int) -> DataFrame:
    """The rows of _filed(), where keys with over ``most`` filed fingerprints have given way to finer keys."""
    crowded = lambda rows: rows.groupBy("key").agg(F.count(F.lit(1)).alias("filed")).where(F.col("filed") > most)
    pieces, filed = _pieces(plan, distance), _filed(fps, plan, lookups=False)
    hot = F.broadcast(cut(crowded(filed).select("key", F.lit(True).alias("hot"))))
    finer = crowded(filed.join(hot, "key").select(F.explode(pieces).alias("key")))
    blocks = F.broadcast(cut(finer.select("key", F.ceil(F.col("filed") / most).alias("parts"))))
    rows = _filed(fps, plan).join(hot, "key", "left").select("fp", "probe", F.explode(F.when(F.col("hot"), pieces).otherwise(F.array("key"))).alias("key"))
    dealt = F.when(F.col("parts").isNull(), F.array(F.struct("key", "probe"))).otherwise(_blocks())
    return rows.join(blocks, "key", "left").select("fp", F.explode(dealt).alias("k")).select("k.key", "k.probe", "fp")


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def _forest(fps: np.ndarray, filed: int, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of one key that span what its rows reach; the first ``filed`` are filed, the rest look them up."""
    label, out = np.arange(len(fps)), []
    for a in range(filed):
        near = np.flatnonzero(_near(fps, fps[a], distance))
        groups, at = np.unique(label[near], return_index=True)
        if len(groups) > 1:
            others = near[at[groups != label[a]]]
            out.append((np.full(len(others), fps[a]), fps[others]))
            label[np.isin(label, groups)] = label[a]
    return out


def _links(key: np.ndarray, probe: np.ndarray, fp: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Verified links among the rows of each key; rows are sorted by key, filed ones before look-ups."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    filed = np.add.reduceat(~probe, first).astype(np.int64)
    large, out = np.flatnonzero(filed * size > 1024), []
    for g in large:
        out += _forest(fp[first[g] : first[g] + size[g]], int(filed[g]), distance)
    group = np.repeat(np.arange(len(first)), size)
    at = np.arange(len(key))
    partners = np.where(probe, filed[group], at - first[group])
    partners[np.isin(group, large)] = 0
    ends = np.cumsum(partners)
    lo = 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        n = partners[lo:hi]
        left = np.repeat(at[lo:hi], n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[group[lo:hi]], n)
        a, b = fp[left], fp[right]
        ok = _near(a, b, distance)
        out.append((a[ok], b[ok]))
        lo = hi
    return out


def _matcher(distance: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def done(parts):
            for a, b in _links(*(np.concatenate(x) for x in zip(*parts, strict=True)), distance):
                if len(a):
                    a, b = a.view(np.int64), b.view(np.int64)
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

        for batch in batches:
            key, probe, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(key):
                continue
            part = (key, probe, fp.view(np.uint64))
            start = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on in the next batch
            if start:
                yield from done([*rest, tuple(x[:start] for x in part)])
                rest = [tuple(x[start:] for x in part)]
            elif rest and rest[-1][0][-1] == key[0]:
                rest.append(part)
                if probe[-1] and sum(len(x[0]) for x in rest) > PAIRS:  # all filed ones are here: the look-ups so far can go
                    yield from done(rest)
                    held = tuple(np.concatenate(x) for x in zip(*rest, strict=True))
                    stay = ~held[1]
                    stay[-1] = True
                    rest = [tuple(x[stay] for x in held)]
            else:
                if rest:
                    yield from done(rest)
                rest = [part]
        if rest:
            yield from done(rest)

    return run


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fps`` (fp long) that span every component of the links
    within ``distance`` bits."""
    n = fps.count()
    plan = segment_plan(n, distance)
    filed = _split(fps, plan, distance, max(GROUP, len(plan) * n // SPLIT)).repartition("key").sortWithinPartitions("key", "probe")
    return filed.mapInArrow(_matcher(distance), "a long, b long").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, distance: int) -> DataFrame:
    """Rows (id, key, fp, root, component_id); rows of one component have one root."""
    prints = _fingerprints(words)
    rows = cut(docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), prints(F.col(text_col)).alias("fp")))
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = components(links(fps.select("fp"), distance))
    members = cut(fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", "root"))
    roots = cut(members.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m")))
    linked = join_keyed(members.where("root IS NOT NULL"), roots, "root", "m").select("fp", "n", "root", "component_id")
    alone = members.where("root IS NULL").select("fp", "n", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return join_keyed(rows, cut(linked.unionByName(alone)), "fp", "n").drop("n")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """For each row: id, fingerprint (16 hex digits), component_id (the smallest id that its links reach)."""
    return _grouped(docs, id_col, text_col, words, distance).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each component the one with the smallest id."""
    order = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    stays = _grouped(docs, id_col, text_col, words, distance).groupBy("root").agg(F.min(order).alias("one")).select("one.key")
    return keep_rows(docs, stays, id_col, text_col)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents: doc_id, fingerprint, component_id."""
    return near_groups(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
