"""Groups of spelling variants: words one inserted, deleted or replaced character apart, and the form that each most likely stands for.

Two words that are one error apart agree before the middle of the shorter one or from it on. So every word is filed by its first and by its
last half, and a file's words become a minimal acyclic automaton, forward for first halves and backward for last halves, whose
edges count the words they pass over: a path through it adds up to the word's number. Each word walks its half exactly, goes on with one
error in what is left, and reads off the numbers of the words it meets; what both directions find is deduplicated.

Halves with over CROWD words are filed anew by more of the word: the stretch that may hold the error is cut in two, down to one character if
need be, so no file is unbounded and none is cut short. Files are read in batches of CELLS characters. Words are counted in Spark before
they are filed, and everything that a task holds is a batch.

Defined cases: null and empty texts have no words; a null id counts as the empty string; equal (id, text) rows count as often as they occur; runs of any length are read whole; an
empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_keyed, read, stored

LETTERS, UPPER = "A-Za-zÀ-ÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters and occurrences of a word at least, the rate of deleted characters, and how many times as frequent a form must be.
SHORTEST, RAREST, SLIP, FACTOR = 6, 5, 199, 5
#: Words of one file, and characters (words times the longest one's) of a batch.
CROWD, CELLS = 50_000, 1_000_000


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of all texts: runs of letters, of which one in SLIP, chosen by a hash of id and run, has lost a character."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{SHORTEST},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % SLIP == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RAREST)


def _file(word: Column, m: Column, lo: Column, hi: Column) -> Column:
    """Where a word of m or m + 1 characters is filed for an error between lo and hi of its m: all of it but that stretch."""
    return F.struct(m.alias("m"), lo.alias("lo"), hi.alias("hi"), F.substring(word, F.lit(1), lo).alias("head"), F.substring(word, F.length(word) - (m - hi) + 1, m - hi).alias("tail"))


def filed(counted: DataFrame) -> DataFrame:
    """(word, n, file) of (word, n): each word by its halves, as the shorter of two and as the longer one."""
    length = F.length("word")
    sizes = F.filter(F.array(length, length - 1), lambda m: m >= SHORTEST)
    both = F.flatten(F.transform(sizes, lambda m: F.array(_file(F.col("word"), m, F.lit(0), F.floor(m / 2).cast("int")), _file(F.col("word"), m, F.floor(m / 2).cast("int"), m))))
    return counted.select("word", "n", F.explode(both).alias("file"))


def _narrowed(rows: DataFrame) -> DataFrame:
    """Rows of crowded files, each in two files of half the stretch."""
    m, lo, hi = F.col("file.m"), F.col("file.lo"), F.col("file.hi")
    middle = F.floor((lo + hi) / 2).cast("int")
    return rows.select("word", "n", F.explode(F.array(_file(F.col("word"), m, lo, middle), _file(F.col("word"), m, middle, hi))).alias("file"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words (rows of codes from 1 on, 0 behind their ends), whose paths give the words' numbers."""

    def __init__(self, codes: np.ndarray, size: np.ndarray):
        n, width = codes.shape
        self.letters = int(codes.max(initial=0)) + 1
        # The trie: rows are sorted, so the words of a node are neighbours.
        node, new = np.zeros((width + 1, n), np.int64), np.r_[True, np.zeros(n - 1, bool)]
        parent, letter, total, levels = [], [], 1, [(0, 1)]
        for d in range(1, width + 1):
            new = (size >= d) & (new | np.r_[True, codes[1:, d - 1] != codes[:-1, d - 1]])
            node[d] = total + np.cumsum(new) - 1
            parent.append(node[d - 1][new])
            letter.append(codes[new, d - 1].astype(np.int64))
            levels.append((total, total + int(new.sum())))
            total = levels[-1][1]
        parent, letter = np.concatenate([[-1], *parent]), np.concatenate([[0], *letter])
        ends = np.zeros(total, bool)
        ends[node[size, np.arange(n)]] = True
        below = ends.astype(np.int64)
        for salt in range(8):
            # Nodes with the same words below them get the same value, from the leaves up.
            value = np.where(ends, np.uint64(0x9E3779B97F4A7C15), np.uint64(1)) + np.uint64(salt)
            for lo, hi in levels[:0:-1]:
                np.add.at(value, parent[lo:hi], _mixed(_mixed(value[lo:hi]) + letter[lo:hi].astype(np.uint64)))
            _, first, state = np.unique(value, return_index=True, return_inverse=True)
            edges = state[parent[1:]] * self.letters + letter[1:]
            self.edges, one = np.unique(edges, return_index=True)
            self.target = state[1:][one]
            degree, place = np.bincount(parent[1:], minlength=total), np.searchsorted(self.edges, edges)
            if (self.target[place] == state[1:]).all() and (degree == degree[first][state]).all() and (ends == ends[first][state]).all():
                break  # no two different nodes share a value
        else:
            raise ValueError("states could not be told apart")
        for lo, hi in levels[:0:-1]:
            np.add.at(below, parent[lo:hi], below[lo:hi])
        self.states, self.start, self.final = len(first), int(state[0]), ends[first]
        self.first = np.searchsorted(self.edges, np.arange(self.states + 1) * self.letters)
        passed = np.r_[0, np.cumsum(below[first][self.target])]
        of = self.edges // self.letters
        self.skip = passed[:-1] - passed[self.first[of]] + self.final[of]

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edges of states with letters, and which there are."""
        key = state * self.letters + letter
        edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return edge, self.edges[edge] == key

    def one_error(self, codes: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(query, number, longer) of the words that differ from a query by one character replaced at lo to hi - 1, or by one more inserted at lo to hi."""
        state, number = np.full(len(codes), self.start), np.zeros(len(codes), np.int64)
        for p in range(codes.shape[1] + 1):
            if p:  # the words are in the automaton, so there is an edge as far as they go
                edge, there = self.step(state, codes[:, p - 1])
                state, number = np.where(there, self.target[edge], state), np.where(there, number + self.skip[edge], number)
            query = np.flatnonzero((lo <= p) & (p <= hi) & (p <= size))
            degree = self.first[state[query] + 1] - self.first[state[query]]
            edge, query = _ragged(self.first[state[query]], degree), np.repeat(query, degree)
            own = codes[query, p] if p < codes.shape[1] else np.zeros(len(query), codes.dtype)
            other = self.edges[edge] % self.letters != own
            edge, query = edge[other], query[other]
            yield *self._rest(codes, size, query, np.full(len(query), p), edge, number), True
            swap = p < np.minimum(hi, size)[query]
            yield *self._rest(codes, size, query[swap], np.full(int(swap.sum()), p + 1), edge[swap], number), False

    def _rest(self, codes: np.ndarray, size: np.ndarray, query: np.ndarray, at: np.ndarray, edge: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Goes over an edge and matches the queries exactly from ``at`` on."""
        state, number, out = self.target[edge], number[query] + self.skip[edge], []
        while len(query):
            over = at == size[query]
            good = over & self.final[state]
            out.append((query[good], number[good]))
            query, at, state, number = query[~over], at[~over], state[~over], number[~over]
            edge, there = self.step(state, codes[query, at])
            query, at, state, number = query[there], at[there] + 1, self.target[edge[there]], number[there] + self.skip[edge[there]]
        return tuple(np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in (0, 1))


def _near(batch: list[tuple], backward: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in ``batch``, rows (word, n, m, lo, hi) of whole files: both ways round, some more than once."""
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    place = {turn(w): k for k, (w, *_) in enumerate(batch)}
    known = sorted(place)
    at, rank = np.array([place[w] for w in known]), {w: k for k, w in enumerate(known)}
    size = np.array([len(w) for w in known])
    letters, flat = np.unique(np.frombuffer("".join(known).encode("utf-32-le"), np.uint32), return_inverse=True)
    codes = np.zeros((len(known), int(size.max())), np.int32)
    codes[np.arange(codes.shape[1]) < size[:, None]] = flat + 1
    automaton = Automaton(codes, size)
    asked = np.array([(rank[turn(w)], *((m - hi, m - lo) if backward else (lo, hi))) for w, _, m, lo, hi in batch if len(w) == m], np.int64).reshape(-1, 3)
    for query, number, longer in automaton.one_error(codes[asked[:, 0]], size[asked[:, 0]], asked[:, 1], asked[:, 2]):
        a, b = at[asked[query, 0]], at[number]
        yield a, b
        if longer:
            yield b, a


def _batches(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (file, word, n, m, lo, hi), sorted by file, in batches of whole files of about CELLS characters."""
    batch, longest = [], 0
    for _, group in groupby(rows, key=lambda r: r[0]):
        group = [r[1:] for r in group]
        wide = max(len(r[0]) for r in group)
        if batch and max(longest, wide) * (len(batch) + len(group)) > CELLS:
            yield batch
            batch, longest = [], 0
        batch += group
        longest = max(longest, wide)
    if batch:
        yield batch


def _searched(rows: DataFrame) -> DataFrame:
    """(word, near, near_n) of rows (word, n, file), some more than once."""
    backward = F.col("file.lo") < F.col("file.m") - F.col("file.hi")  # the longer exact part comes first
    flat = rows.select(backward.alias("backward"), "file.m", "file.lo", "file.hi", "file.head", "file.tail", "word", "n")
    keys = ["backward", "m", "lo", "hi", "head", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read_rows():
            for b in batches:
                back, m, lo, hi, head, tail, word, n = (c.to_pylist() for c in b.columns)
                for k in range(len(m)):
                    yield back[k], ((m[k], lo[k], hi[k], head[k], tail[k]), word[k], n[k], m[k], lo[k], hi[k])

        for back, group in groupby(read_rows(), key=lambda r: r[0]):
            for batch in _batches(r[1] for r in group):
                word, n = pa.array([r[0] for r in batch]), pa.array([r[1] for r in batch], pa.int64())
                for a, b in _near(batch, back):
                    for lo in range(0, len(a), 100_000):
                        x, y = a[lo : lo + 100_000], b[lo : lo + 100_000]
                        yield pa.RecordBatch.from_arrays([word.take(pa.array(x)), word.take(pa.array(y)), n.take(pa.array(y))], names=["word", "near", "near_n"])

    return flat.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "word string, near string, near_n bigint")


def near_words(counted: DataFrame) -> DataFrame:
    """(word, near, near_n) of (word, n): all words one error apart, each pair both ways round and once each."""
    found, rows = None, filed(counted)
    while True:
        crowded = cut(rows.groupBy("file").agg(F.count(F.lit(1)).alias("size")).where((F.col("size") > CROWD) & (F.col("file.hi") - F.col("file.lo") > 1)))
        if crowded.isEmpty():
            more, rows = _searched(rows), None
        else:
            marked = stored(join_keyed(rows, crowded, "file", "size", "left").select("word", "n", "file", F.col("size").isNotNull().alias("crowded")))
            more, rows = _searched(marked.where("NOT crowded")), _narrowed(marked.where("crowded"))
        found = more if found is None else found.unionByName(more)
        if rows is None:
            return found.repartition("word").dropDuplicates(["word", "near"])


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Each step makes a word at least FACTOR times as frequent, so chains are short; every round doubles what is followed."""
    ahead = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if ahead.join(further, "root", "left_semi").isEmpty():
            return ahead
        ahead = cut(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(counted: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words (word, n)."""
    counted = stored(counted)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(counted).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    form_n = -F.col("best.less")
    likely = form_n >= FACTOR * F.col("n")
    rows = stored(counted.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likely, F.col("best.form")).alias("form"), F.when(likely, form_n).alias("form_n")))
    roots = _rooted(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents: word, n, n_near, form, form_n, root."""
    return variants(words(read(spark, sf_dir, "documents"))).select("word", "n", "n_near", "form", "form_n", "root")
