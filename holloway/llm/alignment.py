"""Alignment of the tokens of two tokenizers over the same bytes.

Every byte of a text gets a label: 0 none, 1 a token of A ends here, 2 one of B, 3 both. A regular expression scans the label string for
spans up to each 3; how many 1, 2 and 3 a span holds says how many tokens of A and B form its group. Each labelled byte ends the
overlap of one token of A with one of B, so the labels that are not 0 are the links.

Neither tokenizer has a token over a single space between characters that are no white space, other than at its start, so a text is
labelled in parts from one such space to the next, and a part that repeats is labelled once: a bounded table keeps what parts gave.
Parts of over LONG characters are cut further where neither tokenizer has a token over the cut. Link counts of all texts are summed in
Spark; pairs that many documents hold are joined by broadcast (at most 1 / PAIR_SHARE, by construction), the others by shuffle.

Defined cases: null and empty texts, and texts that one tokenizer does not give back byte for byte (U+2581 becomes a space in B), have zeros
and the hash ''; special strings are plain text; repeated rows are counted as often as they occur; texts of any length are read whole, in chunks of CHUNK
characters; an empty table gives an empty result; columns of the names made here are replaced, all others stay.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import free_name, join_keyed, read, stored

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters that are labelled at once, parts that are remembered, and characters above which a part is cut further.
CHUNK, KNOWN, LONG = 1 << 20, 200_000, 4_000
#: Words that A encodes as one string.
RUN = 500
#: A pair of ids is joined by broadcast when it holds more than this share of all (document, pair) rows.
PAIR_SHARE = 1 / 50_000
SUMS = ["n_a", "n_b", "n_groups", "n_links"]
PAIR = StructType([StructField("pair", LongType()), StructField("links", LongType())])
MADE = [*SUMS, "n_best", "count_sum", "groups_sha256"]

_CUT = re.compile(r" (?<=\S )(?=\S)")
_SPAN = re.compile(rb"[^3]*3")
#: Where A always begins a new word: between letters, digits and other characters, and before white space; an apostrophe may go with the letters behind it.
WORDS = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])")


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


class Aligner:
    """Labels texts with two tokenizers; one for each worker process."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        letters = byte_letters()
        ids = {i: bytes(letters[c] for c in t) for t, i in vocabulary["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in vocabulary["added_tokens"]}
        self.a_bytes = [ids.get(i, b"") for i in range(max(ids) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        #: B puts a space in front; behind a line end, which no piece goes over, a string is encoded without one.
        self.lead = len(self.b.encode("\n"))
        if any("\n" in p and len(p) > 1 for _, p in pieces):
            raise ValueError("models with pieces over line ends are not supported")
        self.beside_a = {(t[k], t[k + 1]) for t in self.a_bytes for k in range(len(t) - 1)}
        self.beside_b = {(p[k], p[k + 1]) for _, p in pieces for k in range(len(p) - 1)}
        self.a_names, self.b_names = ([str(i) for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.known: dict = {}
        self.groups: list[str] = []
        self.sums = np.zeros((4, 0), np.int64)
        self.bad = np.zeros(0, bool)
        self.start, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(self, text: str) -> list:
        """Keys of the parts of " " + text: a string for itself with a space before it, a tuple for its string alone."""
        parts = _CUT.split(text)
        if max(map(len, parts)) <= LONG:
            return parts
        return list(chain.from_iterable([p] if len(p) <= LONG else self._cut_long(p) for p in parts))

    def _cut_long(self, part: str) -> Iterator:
        """A long part in pieces of LONG characters or so; where no cut is safe for both tokenizers it stays whole."""
        last, at, wanted = 0, 0, LONG
        word = WORDS.search(part, wanted)
        while wanted < len(part):
            while word and word.start() < wanted:
                word = WORDS.search(part, wanted)
            at, stop = wanted, word.start() if word else len(part)
            while at < stop and (part[at].isspace() or part[at] == "'" or part[at - 1].isspace() or (part[at - 1].encode()[-1], part[at].encode()[0]) in self.beside_a):
                at += 1
            if at < len(part) and (part[at - 1], part[at].replace(" ", "▁")) not in self.beside_b and not part[at - 1].isspace() and part[at - 1] != "▁":
                yield (part[last:at],) if last else part[:at]
                last, wanted = at, at + LONG
            else:
                wanted = at + 1
        yield (part[last:],) if last else part

    def _encoded(self, keys: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of A and of B: flat ids of the keys' strings and how many each has. Words go to A in runs of RUN, which it cuts between them itself."""
        texts = [" " + k if isinstance(k, str) else k[0] for k in keys]
        word = np.array([isinstance(k, str) and bool(k) and not (k[0].isspace() or k[-1].isspace()) for k in keys])
        words, others = (np.flatnonzero(x).tolist() for x in (word, ~word))
        runs = [words[k : k + RUN] for k in range(0, len(words), RUN)] + [[k] for k in others]
        ids = [e.ids for e in self.a.encode_batch_fast(["".join([texts[k] for k in run]) for run in runs], add_special_tokens=False)]
        flat, order = np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids))), np.array(words + others)
        size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))[order]
        n = np.diff(np.r_[0, np.searchsorted(np.cumsum(self.a_size[flat]), np.cumsum(size), "right")])
        first, count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        first[order], count[order] = np.cumsum(n) - n, n
        yield flat[_ragged(first, count)], count
        ids = self.b.encode([k if isinstance(k, str) else "\n" + k[0] for k in keys], num_threads=1)
        ids = [x if isinstance(k, str) else x[self.lead :] for x, k in zip(ids, keys, strict=True)] if others else ids
        count = np.fromiter(map(len, ids), np.int64, len(keys))
        yield np.fromiter(chain.from_iterable(ids), np.int64, count.sum()), count

    def learn(self, keys: list) -> None:
        """Labels new parts and remembers what they gave."""
        (flat_a, n_a), (flat_b, n_b) = self._encoded(keys)
        raw = [(" " + k if isinstance(k, str) else k[0]).encode() for k in keys]
        joined, bad = b"".join(raw), np.zeros(len(keys), bool)
        bytes_of = lambda names, flat: b"".join(map(names.__getitem__, flat.tolist()))
        if bytes_of(self.a_bytes, flat_a) != joined or bytes_of(self.b_bytes, flat_b) != joined:
            sides = [(names, np.split(flat, np.cumsum(n)[:-1])) for names, flat, n in ((self.a_bytes, flat_a, n_a), (self.b_bytes, flat_b, n_b))]
            bad[:] = [any(bytes_of(names, ids[k]) != r for names, ids in sides) for k, r in enumerate(raw)]
            raw = [b"" if no else r for no, r in zip(bad, raw, strict=True)]
            flat_a, flat_b = flat_a[~np.repeat(bad, n_a)], flat_b[~np.repeat(bad, n_b)]
            n_a, n_b = np.where(bad, 0, n_a), np.where(bad, 0, n_b)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        label = np.zeros(int(ends[-1]), np.uint8)
        label[np.cumsum(self.a_size[flat_a]) - 1] += 1
        label[np.cumsum(self.b_size[flat_b]) - 1] += 2
        spans = _SPAN.findall((label + ord("0")).tobytes())
        start = np.r_[0, np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))][:-1]
        take_a, take_b = (np.add.reduceat(label >> k & 1, start, dtype=np.int64) if len(start) else start for k in (0, 1))
        first_a, first_b = np.cumsum(take_a) - take_a, np.cumsum(take_b) - take_b
        name_a, name_b = ([*map(names.__getitem__, flat.tolist())] for names, flat in ((self.a_names, flat_a), (self.b_names, flat_b)))
        written = [f"{name_a[i]}|{name_b[j]}" for i, j in zip(first_a.tolist(), first_b.tolist(), strict=True)]
        for g in np.flatnonzero((take_a > 1) | (take_b > 1)).tolist():
            i, j = first_a[g], first_b[g]
            written[g] = f"{','.join(name_a[i : i + take_a[g]])}|{','.join(name_b[j : j + take_b[g]])}"
        per_part = lambda places: np.diff(np.r_[0, np.searchsorted(places, ends)])
        at = np.flatnonzero(label)
        n_links, n_groups = per_part(at), per_part(np.flatnonzero(label == 3))
        before = [np.cumsum(bit) - bit for bit in ((label & 1).astype(np.int64), (label >> 1).astype(np.int64))]
        links = flat_a[before[0][at]] << 32 | flat_b[before[1][at]]
        self.known.update(zip(keys, range(len(self.groups), len(self.groups) + len(keys)), strict=True))
        top = np.cumsum(n_groups)
        self.groups += [";".join(written[x:y]) for x, y in zip((top - n_groups).tolist(), top.tolist(), strict=True)]
        self.start = np.r_[self.start, len(self.links) + np.cumsum(n_links) - n_links]
        self.links = np.r_[self.links, links]
        self.sums = np.concatenate([self.sums, [n_a, n_b, n_groups, n_links]], 1)
        self.bad = np.r_[self.bad, bad]

    def _chunks(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > CHUNK:
            cut = _CUT.search(text, at + CHUNK)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:]

    def align(self, texts: list[str | None]) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray]]:
        """Of each text: its four sums, the hash of its groups, its id pairs (a * 2**32 + b) and how many links each has."""
        lo, size = 0, 0
        for hi, t in enumerate(texts, 1):
            size += len(t or "")
            if size >= CHUNK or hi == len(texts):
                yield from self._align(texts[lo:hi])
                lo, size = hi, 0

    def _align(self, texts: list[str | None]) -> Iterator[tuple]:
        if len(self.known) > KNOWN:
            self.forget()
        short = [self.split(t) if t and len(t) <= CHUNK else None for t in texts]
        if new := list(set(chain.from_iterable(filter(None, short))) - self.known.keys()):
            self.learn(new)
        for t, parts in zip(texts, short, strict=True):
            yield self._one([parts] if parts else self._later(t or ""))

    def _later(self, text: str) -> Iterator[list]:
        """The parts of a long text, chunk by chunk, each learnt when it is reached."""
        for chunk in self._chunks(text) if text else ():
            parts = self.split(chunk)
            if len(self.known) > KNOWN:
                self.forget()
            if new := list(set(parts) - self.known.keys()):
                self.learn(new)
            yield parts

    def _one(self, chunks) -> tuple:
        sums, hashed, pairs, times, first = np.zeros(4, np.int64), hashlib.sha256(), [], [], True
        for parts in chunks:
            index = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
            which, n = np.unique(index, return_counts=True)
            if self.bad[which].any():
                return [0] * 4, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
            hashed.update((";" * (not first) + ";".join(map(self.groups.__getitem__, index.tolist()))).encode())
            first = False
            mine = self.sums[:, which]
            sums += mine @ n
            keys, back = np.unique(self.links[_ragged(self.start[which], mine[3])], return_inverse=True)
            pairs.append(keys)
            times.append(np.bincount(back, np.repeat(n, mine[3]), len(keys)).astype(np.int64))
        if first:
            return [0] * 4, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(pairs) > 1:
            keys, back = np.unique(np.concatenate(pairs), return_inverse=True)
            pairs, times = [keys], [np.bincount(back, np.concatenate(times)).astype(np.int64)]
        return sums.tolist(), hashed.hexdigest(), pairs[0], times[0]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def labelled(docs: DataFrame, text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, groups_sha256 and pairs in place of the text: an array of (pair, links), a pair being a * 2**32 + b."""
    paths = (a_path or public_tokenizers.path(A), b_path or public_tokenizers.path(B))
    keep = [c for c in docs.columns if c.lower() not in {*MADE, "pairs", text_col.lower()}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _ALIGNERS:
            _ALIGNERS[paths] = Aligner(*paths)
        for batch in batches:
            at, rows, size = 0, [], 0
            for row in _ALIGNERS[paths].align(batch.column(batch.schema.get_field_index(text_col)).to_pylist()):
                rows.append(row)
                size += len(row[2])
                if size > 1_000_000 or at + len(rows) == batch.num_rows:
                    part = batch.slice(at, len(rows))
                    sums = np.array([r[0] for r in rows], np.int64).reshape(-1, 4)
                    offsets = np.cumsum([0, *(len(r[2]) for r in rows)])
                    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([r[k] for r in rows])) for k in (2, 3)], ["pair", "links"])
                    made = [*map(pa.array, sums.T.copy()), pa.array([r[1] for r in rows], pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)]
                    yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in keep], *made], names=[*keep, *SUMS, "groups_sha256", "pairs"])
                    at, rows, size = at + len(rows), [], 0

    schema = StructType([*[docs.schema[c] for c in keep], *[StructField(c, LongType()) for c in SUMS], StructField("groups_sha256", StringType()), StructField("pairs", ArrayType(PAIR))])
    return docs.mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, docs, count, best) of rows (pair, links): count is the number of links of all rows, best whether no other pair of its B id has more."""
    counts = stored(links.groupBy("pair").agg(F.count(F.lit(1)).alias("docs"), F.sum("links").alias("count")))
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # one row for each piece of the vocabulary at most
    return counts.join(most, b == F.col("b")).select("pair", "docs", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; their text column is left out."""
    row = free_name(docs)
    rows = stored(labelled(docs.withColumn(row, F.monotonically_increasing_id()), text_col, a_path, b_path))
    links = rows.select(row, F.inline("pairs"))
    counts = stored(pair_counts(links))
    found = join_keyed(links, counts, "pair", "docs", share=PAIR_SHARE).groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    out = rows.drop("pairs").join(found, row, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
    return out.select(*[c for c in rows.columns if c not in (row, "pairs", "groups_sha256")], "n_best", "count_sum", "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return aligned(read(spark, sf_dir, "documents").select("doc_id", "text"))
