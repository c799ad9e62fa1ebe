"""Connected components over a table of links: contraction inside tasks, in one task while it can hold what is left, else iterated star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, join_keyed

#: Links that one of several tasks contracts, and that the last one does.
LINKS_A_TASK, HELD = 1_000_000, 4_000_000


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of nodes 0 to n - 1 the least one that each reaches by the links a to b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(root, up := root[root]):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from each node to the smallest node that it reaches by this task's links."""
    some = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if some:
        nodes, at = np.unique(np.concatenate([v for k in (0, 1) for v in (batch[k] for batch in some)]), return_inverse=True)
        root = joined(len(nodes), at[: len(at) // 2], at[len(at) // 2 :])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield from pa.table({"a": nodes[moved], "b": nodes[root[moved]]}).to_batches(1 << 16)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b long): root is the smallest node that is reachable.

    Tasks first contract some LINKS_A_TASK links each; up to HELD links that these leave are contracted by one more. One task's result is final. Otherwise each round sends a node's larger
    neighbours to its smallest one, then its smaller neighbours, until nothing changes; the number of rounds
    grows with the logarithm of the longest path. A node with very many neighbours is reduced to one row a task before the
    shuffle, and its links are joined with that by join_keyed.
    """
    clean = cut(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    tasks = max(1, -(-clean.count() // LINKS_A_TASK))
    now = cut(clean.repartition(tasks).mapInArrow(_contract, "a long, b long"))
    if tasks > 1 and now.count() <= HELD:
        now, tasks = cut(now.repartition(1).mapInArrow(_contract, "a long, b long")), 1
    before = _state(now) if tasks > 1 else (0,)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = cut(now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = cut(join_keyed(both, least, "a", "n").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = join_keyed(large, least, "a", "n").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
