"""SentencePiece encoding and decoding (BPE models with byte fallback) by suffix-array matching.

A batch's texts are cut where no piece of the model spans the cut; the distinct parts are concatenated and a suffix
array orders all positions by as many characters as the longest piece has. Each piece is searched in it by bisection,
which gives its occurrences as a range; every occurrence is an edge between two positions. Edges are sorted by end and
relaxed in that order, all parts at once: the last piece of a prefix's encoding is the one edge whose piece is
compatible with the last piece of the prefix before it, that is, merging the two pieces' characters by rank gives
back these two. So the ids are those of merging by rank itself, as the public library gives them.

Defined cases: null and empty texts have no ids; a space and U+2581 are the same symbol, so decoding gives a space for either;
characters outside the vocabulary become their UTF-8 bytes' pieces; a null or empty id list decodes to the empty text; bytes that are
not valid UTF-8 decode to U+FFFD. Texts of any length are encoded whole: parts of over LONG characters are relaxed one at a time. Repeated rows
are encoded alike, an empty table gives an empty result, and columns named token_ids or decoded are replaced; all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import read

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Characters that are encoded at once, and those of a part above which it is relaxed alone.
BLOCK, LONG = 2_000_000, 400
_END, _UNKNOWN = 0, 1
_START = -1


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if n < 1 << 31 and (not len(starts) or starts.max() + n < 1 << 31) else np.int64
    return np.arange(n, dtype=kind) - np.repeat((ends - sizes - starts).astype(kind), sizes)


class PieceModel:
    """The pieces of a model as arrays: characters, ranks, last merges and the pairs that merge."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        byte = [i for i in ids if sp.is_byte(i)]
        if len(byte) != 256:
            raise ValueError("only models with byte fallback are supported")
        self.byte_ids = np.zeros(256, np.int32)
        for i in byte:
            self.byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        normal = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in normal}
        self.raw = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        self.raw[sp.unk_id()] = " ⁇ ".encode()
        self.raw_size = np.array([len(x) for x in self.raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        alphabet = sorted({c for p in self.pieces for c in p})
        self.code = {c: k + 2 for k, c in enumerate(alphabet)}
        if len(alphabet) + 2 >= 1 << 16:
            raise ValueError("too many characters for 16-bit codes")
        # A character that is in pieces but is none itself is a piece of its own that ends as bytes.
        self.n = len(ids)
        self.bare = {c: self.n + k for k, c in enumerate(c for c in alphabet if c not in self.pieces)}
        every = self.pieces | self.bare
        rank = {p: r for r, p in enumerate(sorted((p for p in self.pieces if len(p) > 1), key=lambda p: (-sp.get_score(self.pieces[p]), self.pieces[p])))}
        size = self.n + len(self.bare)
        self.made = np.full(size + 1, -1, np.int64)  # the rank at which a piece is made; -1: a character
        self.left, self.right = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        pairs, matched = [], []
        for p, i in every.items():
            if len(p) > 1:
                self.made[i] = rank[p]
                pairs += [(every[p[:k]], every[p[k:]], rank[p]) for k in range(1, len(p)) if p[:k] in every and p[k:] in every]
                split = self._last_merge(p, every, rank)
                if split is None:
                    continue  # merging never ends in this piece
                self.left[i], self.right[i] = split
            matched.append((p, i))
        self.stride = size + 1
        keys = np.array([a * self.stride + b for a, b, _ in pairs] or [-1], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], np.array([r for *_, r in pairs] or [-1], np.int64)[order]
        self.longest = max((len(p) for p in every), default=1)
        width = -(-self.longest // 4) * 4
        codes, self.piece_id, self.piece_len = np.zeros((len(matched), width), np.uint64), np.array([i for _, i in matched]), np.array([len(p) for p, _ in matched])
        for k, (p, _) in enumerate(matched):
            codes[k, : len(p)] = [self.code[c] for c in p]
        filled = np.where(np.arange(width) < self.piece_len[:, None], codes, np.uint64(0xFFFF))
        self.low, self.high = self._pack(codes), self._pack(filled)
        self.spanned = np.array(sorted({(self.code[a], self.code[b]) for p in every for a, b in zip(p, p[1:], strict=False)}), np.int64).reshape(-1, 2)
        self._tables: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    @staticmethod
    def _pack(codes: np.ndarray) -> np.ndarray:
        c = codes.reshape(len(codes), -1, 4)
        return ((c[..., 0] << np.uint64(48)) | (c[..., 1] << np.uint64(32)) | (c[..., 2] << np.uint64(16)) | c[..., 3]).T.copy()

    @staticmethod
    def _last_merge(piece: str, ids: dict[str, int], rank: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces whose merge makes ``piece`` when its characters are merged by rank."""
        parts = list(piece)
        while len(parts) > 2:
            best = min((rank.get(a + b, len(rank)), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == len(rank):
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return ids[parts[0]], ids[parts[1]]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code of each code point; which codes may stand side by side in a piece; remembered pairs. Built once a process."""
        if self._tables is None:
            codes = np.full(0x110000, _UNKNOWN, np.uint16)
            for c, k in self.code.items():
                codes[ord(c)] = k
            beside = np.zeros((len(self.code) + 2,) * 2, bool)
            beside[self.spanned[:, 0], self.spanned[:, 1]] = True
            self._tables = codes, beside, np.full(1 << 21, -1, np.int64)
        return self._tables

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of pieces a and b by rank gives a and b again; a may be _START."""
        known = self.tables()[2]
        key = a.astype(np.int64) * self.stride + b
        slot = (key * 0x9E3779B1 >> 11) & (len(known) - 1)
        got = known[slot]
        ok = (got & 1).astype(bool) | (a == _START)
        new = np.flatnonzero((got >> 1 != key) & (a != _START))
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            ok[new] = self._decide(fresh // self.stride, fresh % self.stride)[back]
            known[slot[new]] = key[new] << 1 | ok[new]
        return ok

    def _decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok, limit, live = np.ones(len(a), bool), np.full(len(a), np.iinfo(np.int64).max), np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(live):
            key = a * self.stride + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merges = (self.pair_keys[at] == key) & (self.pair_rank[at] < limit)
            ok[live[merges]] = False
            ra, rb = self.made[a], self.made[b]
            back_a = ra > rb  # of equal pieces the left one is made first
            # One step back: the later made of the two was its halves before; of equal ranks the leftmost merges first.
            limit = np.where(back_a, ra, rb + 1)
            a, b = np.where(back_a, self.right[a], a), np.where(back_a, b, self.left[b])
            go = ~merges & (np.maximum(ra, rb) >= 0)
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return ok

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all occurrences of all pieces in ``codes``."""
        n, words = len(codes), len(self.low)
        padded = np.r_[codes.astype(np.uint64), np.zeros(4 * words + 4, np.uint64)]
        word = (padded[:-3] << np.uint64(48)) | (padded[1:-2] << np.uint64(32)) | (padded[2:-1] << np.uint64(16)) | padded[3:]
        order = np.argsort(word[:n])
        depth = 4
        while depth < self.longest:
            key = word[:n][order] if depth == 4 else key[order]
            rank = np.empty(n + depth, np.uint64)
            rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]]).astype(np.uint64) + np.uint64(1)
            rank[n:] = 0
            key = (rank[:n] << np.uint64(32)) | rank[depth : n + depth]
            order = np.argsort(key)
            depth *= 2
        columns = [word[order + 4 * k] for k in range(words)]

        def bisect(wanted: np.ndarray, right: bool) -> np.ndarray:
            lo, hi = np.zeros(wanted.shape[1], np.int64), np.full(wanted.shape[1], n)
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
                for column, want in zip(columns, wanted, strict=True):
                    have = column[np.minimum(mid, n - 1)]
                    less |= same & (have < want)
                    same &= have == want
                less |= same & right
                lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            return lo

        first = bisect(self.low, False)
        count = bisect(self.high, True) - first
        return order.astype(np.int32)[_ragged(first, count)], np.repeat(self.piece_len.astype(np.int32), count), np.repeat(self.piece_id.astype(np.int32), count)

    def _relax(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the parts codes[begin : begin + size]: flat ids, and their number for each part."""
        start, length, piece = self._edges(codes)
        reach = np.diff(np.r_[begin, len(codes)])
        end = start + length
        step = end - np.repeat(begin.astype(np.int32), reach)[start]
        alone = np.repeat(size > LONG, reach)[start]
        last, tokens = np.full(len(codes) + 1, -2, np.int64), np.zeros(len(codes) + 1, np.int64)
        came = np.zeros(len(codes) + 1, np.int64)
        last[begin] = _START
        if (~alone).any():
            keep = np.flatnonzero(~alone) if alone.any() else slice(None)
            s, e, p, ln = start[keep], end[keep], piece[keep], length[keep]
            key = (step[keep] * (self.longest + 1) + self.longest - ln).astype(np.uint16)
            order = np.argsort(key, kind="stable")
            s, e, p, key = s[order], e[order], p[order], key[order]
            bounds = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                es, ee, ep = s[lo:hi], e[lo:hi], p[lo:hi]
                todo = (last[ee] == -2) & (last[es] != -2)
                es, ee, ep = es[todo], ee[todo], ep[todo]
                ok = self.compatible(last[es], ep)
                es, ee = es[ok], ee[ok]
                last[ee], came[ee], tokens[ee] = ep[ok], es, tokens[es] + 1
        if alone.any():
            keep = np.flatnonzero(alone)
            order = keep[np.lexsort((-length[keep], end[keep]))]
            for es, ee, ep in zip(start[order].tolist(), end[order].tolist(), piece[order].tolist(), strict=True):
                if last[ee] == -2 and last[es] != -2 and self.compatible(last[es : es + 1], np.array([ep]))[0]:
                    last[ee], came[ee], tokens[ee] = ep, es, tokens[es] + 1
        at = begin + size
        count = tokens[at]
        out, top = np.empty(count.sum(), np.int64), np.cumsum(count)
        live = np.flatnonzero(size > 0)
        at, top = at[live], top[live]
        while len(at):
            top -= 1
            out[top] = last[at]
            at = came[at]
            go = last[at] != _START
            at, top = at[go], top[go]
        return out, count

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and the number of ids of each."""
        count, out = np.zeros(len(texts), np.int64), [np.empty(0, np.int32)]
        chunks: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            ids, n = self._encode(chunks)
            out.append(ids)
            np.add.at(count, owners, n)
            chunks.clear()
            owners.clear()

        for k, t in enumerate(texts):
            for chunk in self._chunks(SPACE + t.replace(" ", SPACE)) if t else ():
                chunks.append(chunk)
                owners.append(k)
                size += len(chunk)
                if size > BLOCK:
                    flush()
                    size = 0
        flush()
        return np.concatenate(out), count

    def _chunks(self, text: str):
        """The text in chunks of about BLOCK characters, cut where no piece spans the cut."""
        table, beside, _ = self.tables()
        done, look = 0, 2 * BLOCK
        while len(text) - done > BLOCK:
            codes = table[np.frombuffer(text[done : done + look].encode("utf-32-le"), np.uint32)]
            cuts = np.flatnonzero(~beside[codes[:-1], codes[1:]]) + 1
            late = cuts[cuts >= BLOCK]
            if not len(cuts) and look < len(text) - done:
                look *= 2  # a part longer than a chunk stays whole
                continue
            at = done + int(late[0]) if len(late) else done + int(cuts[-1]) if len(cuts) else len(text)
            yield text[done:at]
            done, look = at, 2 * BLOCK
        if done < len(text):
            yield text[done:]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        table, beside, _ = self.tables()
        chars = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        codes = table[points]
        cut = np.ones(len(codes), bool)
        cut[1:] = ~beside[codes[:-1], codes[1:]]
        doc_first = np.cumsum(chars) - chars
        cut[doc_first[chars > 0]] = True
        starts = np.flatnonzero(cut)
        # Distinct parts, by Arrow's dictionary over the UTF-8 bytes.
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        places = np.r_[0, np.cumsum(width, dtype=np.int64)]
        offsets = np.r_[places[starts], places[-1]].astype(np.int32)
        parts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(joined.encode())).dictionary_encode()
        which, distinct = parts.indices.to_numpy(), len(parts.dictionary)
        sample = np.empty(distinct, np.int64)
        sample[which[::-1]] = starts[::-1]
        size_at = np.diff(np.r_[starts, len(codes)])
        size = np.empty(distinct, np.int64)
        size[which[::-1]] = size_at[::-1]
        space = size + 1
        begin = np.cumsum(space) - space
        flat = np.full(space.sum(), _END, np.uint16)
        flat[_ragged(begin, size)] = codes[_ragged(sample, size)]
        # An unknown character is a part of its own.
        strange = codes[sample] == _UNKNOWN
        ids, count = self._relax(flat, begin[~strange], size[~strange]) if (~strange).any() else (np.empty(0, np.int64), np.empty(0, np.int64))
        ids, count = self._spell(ids, count, strange, sample, points)
        first = np.cumsum(count) - count
        out = ids[_ragged(first[which], count[which])]
        per_part = np.r_[0, np.cumsum(count[which])]
        part_of = np.searchsorted(starts, np.r_[doc_first, len(codes)])
        return out.astype(np.int32), np.diff(per_part[part_of])

    def _spell(self, ids: np.ndarray, count: np.ndarray, strange: np.ndarray, sample: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts in the byte pieces of unknown characters, for all distinct parts in order."""
        if not strange.any() and not (ids >= self.n).any():
            return ids, count
        for c, i in self.bare.items():
            if (ids == i).any():
                own = self.byte_ids[list(c.encode())]
                part = np.repeat(np.arange(len(count)), count)
                times = np.where(ids == i, len(own), 1)
                count = np.bincount(part, times, minlength=len(count)).astype(np.int64)
                at = np.cumsum(times) - times
                grown = np.repeat(ids, times)
                grown[_ragged(at[ids == i], times[ids == i])] = np.tile(own, (ids == i).sum())
                ids = grown
        own = [self.byte_ids[list(chr(points[sample[k]]).encode())] for k in np.flatnonzero(strange)]
        whole = np.zeros(len(strange), np.int64)
        whole[~strange], whole[strange] = count, [len(x) for x in own]
        first = np.cumsum(whole) - whole
        out = np.empty(whole.sum(), np.int64)
        out[_ragged(first[~strange], count)] = ids
        if own:
            out[_ragged(first[strange], whole[strange])] = np.concatenate(own)
        return out, whole

    def decode(self, ids) -> str:
        """The text of an id list; the space that encoding puts in front is taken away."""
        return self.decode_all(np.asarray([] if ids is None else ids, np.int64), np.array([0 if ids is None else len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """The texts of flat ids; ``count`` has the number of ids of each."""
        size = self.raw_size[ids]
        flat = self.raw_bytes[_ragged(self.raw_start[ids], size)].tobytes()
        ends = np.r_[0, np.cumsum(size, dtype=np.int64)][np.r_[0, np.cumsum(count)]]
        texts = [flat[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def encoder(spark: SparkSession, path: str | None = None):
    """A function from a text column to its ids."""
    model = spark.sparkContext.broadcast(PieceModel(path or public_tokenizers.path(MODEL)))

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        ids, n = model.value.encode(list(texts))
        return pd.Series(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [], dtype=object)

    return encode


def decoder(spark: SparkSession, path: str | None = None):
    """A function from an id column to its text."""
    model = spark.sparkContext.broadcast(PieceModel(path or public_tokenizers.path(MODEL)))

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series([model.value.decode(x) for x in ids], dtype=object)

    return decode


def tokenize(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with token_ids (array of int) and decoded (the text that these ids give), in one pass.

    Arrow batches are handled in slices of about BLOCK bytes, in and out, so a task's memory is bounded by that and its longest text.
    """
    model = docs.sparkSession.sparkContext.broadcast(PieceModel(path or public_tokenizers.path(MODEL)))
    keep = [c for c in docs.columns if c not in ("token_ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            lo = 0
            while lo < len(ends):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, "right")))
                ids, n = model.value.encode(text.slice(lo, hi - lo).to_pylist())
                tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids, pa.int32()))
                decoded = pa.array(model.value.decode_all(ids, n), pa.string())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in keep], tokens, decoded], names=[*keep, "token_ids", "decoded"])
                lo = hi

    schema = StructType([*[docs.schema[c] for c in keep], StructField("token_ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    return docs.mapInArrow(run, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents: doc_id, n_tokens, ids_xxh64 (of the id list), decoded_crc32, round_trip."""
    coded = tokenize(read(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = F.translate(F.coalesce("text", F.lit("")), SPACE, " ")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.xxhash64("token_ids").alias("ids_xxh64"),
                        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), (F.col("decoded") == plain).alias("round_trip"))
