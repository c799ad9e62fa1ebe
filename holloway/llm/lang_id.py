"""Language identification with a byte convolutional network.

Texts are cut into windows of WINDOW bytes. Filters of several widths slide over a window's byte classes, each keeps
its largest response, and a softmax layer turns these into probabilities; a text's probabilities are the mean
over all its windows. The network is trained in numpy on the driver with a bounded sample of the labelled rows: BUCKETS hash buckets
of ids for each label, the first ``docs // BUCKETS`` ids of each, and WINDOWS windows of each document. ``docs`` is DOCS, less where
there are so many labels that DOCS of each would be over ROWS documents; every label keeps BUCKETS documents, so all labels are learned.
Prediction covers whole texts.

Defined cases: a text that is null or has no letter (of any script; digits, signs and numerals are none) is ``und`` with score 0; the last
window is padded; equal probabilities go to the label that sorts first; a null id counts as the empty string when rows are held out; rows that repeat an id and label share one place in the sample, by
the text that sorts first; without labelled rows every text is ``und``; repeated rows are predicted alike; an empty table gives an empty result; columns named held_out,
lang_pred or score are replaced, all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free_name, read

WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 16
#: Sampled documents of a label and of all labels, windows of a document, hash buckets of a label.
DOCS, ROWS, WINDOWS, BUCKETS = 800, 80_000, 8, 32
EPOCHS, BATCH, RATE, SEED = 3, 64, 0.01, 7
#: Bytes of text that are predicted at once.
PART = 1 << 22
RESULT = "struct<lang_pred: string, score: double>"

_LETTER = regex.compile(r"\p{L}")


def _byte_classes() -> np.ndarray:
    """Class of each byte: letters without case 1 to 26, bytes from 128 up one class each, all else 0."""
    out = np.zeros(256, np.int32)
    for i in range(26):
        out[[65 + i, 97 + i]] = 1 + i
    out[128:] = 27 + np.arange(128)
    return out


CLASS_OF, N_CLASSES = _byte_classes(), 27 + 128


def windows(text: str) -> np.ndarray:
    """All windows of a text as byte classes, (n, WINDOW)."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.zeros(max(1, -(-len(raw) // WINDOW)) * WINDOW, np.int32)
    out[: len(raw)] = CLASS_OF[raw]
    return out.reshape(-1, WINDOW)


@dataclass
class ByteCNN:
    languages: list[str]
    taps: dict[int, np.ndarray]  # width -> (width, N_CLASSES, FILTERS)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str]) -> ByteCNN:
        rng = np.random.default_rng(SEED)
        taps = {w: rng.normal(0, 0.3, (w, N_CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS}
        return cls(languages, taps, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
                   rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Pooled responses of windows (n, WINDOW) and where each was found; for training."""
        pooled, where, across = [], {}, np.ascontiguousarray(x.T)
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            y = np.take(self.taps[w][0], across[:n], axis=0)
            for k in range(1, w):
                y += np.take(self.taps[w][k], across[k : k + n], axis=0)
            where[w] = y.argmax(axis=0)
            pooled.append(np.take_along_axis(y, where[w][None], axis=0)[0] + self.bias[w])
        return np.concatenate(pooled, axis=1), where

    def fit(self, x: np.ndarray, y: np.ndarray) -> ByteCNN:
        rng = np.random.default_rng(SEED)
        params = [*self.taps.values(), *self.bias.values(), self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                xb, yb = x[order[lo : lo + BATCH]], y[order[lo : lo + BATCH]]
                raw, where = self._pooled(xb)
                h = np.maximum(raw, 0)
                d = softmax(h @ self.out + self.out_bias)
                d[np.arange(len(yb)), yb] -= 1
                d /= len(yb)
                dh = (d @ self.out.T) * (raw > 0)
                taps, bias, rows = [], [], np.arange(len(xb))[:, None]
                for i, w in enumerate(WIDTHS):
                    g, t = dh[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(self.taps[w])
                    for k in range(w):
                        np.add.at(t[k], (xb[rows, where[w] + k], np.arange(FILTERS)[None, :]), g)
                    taps.append(t)
                    bias.append(g.sum(axis=0))
                step += 1
                for p, g, m, v in zip(params, [*taps, *bias, h.T @ d, d.sum(axis=0)], first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """The filters as look-ups of byte pairs: width -> (offset, table) pairs, whose sum is the response."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        out = {}
        for w in WIDTHS:
            t = self.taps[w]
            parts = [(k, pair(t[k], t[k + 1])) for k in range(0, w - 1, 2)]
            if w % 2:
                parts.append((w - 2, pair(np.zeros_like(t[0]), t[w - 1])))
            out[w] = parts
        return out

    def probabilities(self, x: np.ndarray, tables: dict) -> np.ndarray:
        """Of windows (n, WINDOW), one row each."""
        across = np.ascontiguousarray(x.T, dtype=np.int64)  # positions first: the pooled axis is then the outer one
        pairs = across[:-1] * N_CLASSES + across[1:]
        pooled = []
        for w in WIDTHS:
            n = WINDOW - w + 1
            y = None
            for k, table in tables[w]:
                got = np.take(table, pairs[k : k + n], axis=0)
                y = got if y is None else np.add(y, got, out=y)
            pooled.append(y.max(axis=0) + self.bias[w])
        return softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out + self.out_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> list:
    """Windows of the sampled documents: ids are chosen without reading texts, then their texts are cut in Spark."""
    labels = labelled.select(lang_col).distinct().count()
    each = max(1, min(DOCS, ROWS // max(1, labels)) // BUCKETS)
    # A label may have most rows: each of its buckets has its own quota, and tasks limit theirs before the shuffle.
    order, part = [F.xxhash64(id_col), F.col(id_col)], F.pmod(F.xxhash64(id_col, F.lit(SEED)), F.lit(BUCKETS))
    ids = labelled.select(lang_col, id_col).withColumn("r", F.row_number().over(Window.partitionBy(lang_col, part).orderBy(*order))).where(F.col("r") <= each).drop("r")
    ids = cut(ids.distinct())  # ROWS in all, or BUCKETS a label, so it may be broadcast
    step = F.greatest(F.lit(1), F.floor((F.length(text_col) - WINDOW) / (WINDOWS - 1)).cast("int"))
    n = F.least(F.lit(WINDOWS), F.greatest(F.lit(1), F.ceil(F.length(text_col) / WINDOW).cast("int")))
    cuts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text_col, i * step + 1, F.lit(WINDOW)))
    found = labelled.join(F.broadcast(ids), [lang_col, id_col], "left_semi").select(lang_col, id_col, cuts.alias("w"))
    return found.groupBy(lang_col, id_col).agg(F.min("w").alias("w")).select(lang_col, "w").collect()


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCNN | None:
    """A network for the labels of ``labelled``; None if there is none."""
    labelled = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = sorted(_sample(labelled, id_col, text_col, lang_col))
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    x = [(windows(t)[0], languages.index(r[0])) for r in rows for t in r[1]]
    return ByteCNN.new(languages).fit(np.stack([a for a, _ in x]), np.array([b for _, b in x]))


def predict_texts(model: ByteCNN, texts: list[str | None]) -> list[tuple[str, float]]:
    """(label, score) of each whole text."""
    tables, out = model.tables(), []
    part: list[np.ndarray] = []
    kept: list[bool] = []

    def flush() -> None:
        if part:
            x, n = np.concatenate(part), [len(p) for p in part]
            p = np.concatenate([model.probabilities(x[i : i + 128], tables) for i in range(0, len(x), 128)])
            mean = np.add.reduceat(p.astype(np.float64), np.r_[0, np.cumsum(n)[:-1]], axis=0) / np.array(n)[:, None]
            best, top = mean.argmax(axis=1), np.minimum(mean.max(axis=1), 1.0)
        at = 0
        for ok in kept:
            out.append((model.languages[best[at]], float(top[at])) if ok else ("und", 0.0))
            at += ok
        part.clear()
        kept.clear()

    size = 0
    for t in texts:
        kept.append(bool(t and _LETTER.search(t)))
        if kept[-1]:
            part.append(windows(t))
            size += part[-1].size
        if size > PART:
            flush()
            size = 0
    flush()
    return out


def predictor(spark: SparkSession, model: ByteCNN | None):
    """A function from a text column to a struct of lang_pred and score."""
    if model is None:
        return lambda text: F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(predict_texts(sent.value, list(texts)), columns=["lang_pred", "score"])

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with held_out, lang_pred and score; learned from its labelled rows that are not held out."""
    model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    name = free_name(docs)
    found = docs.withColumn(name, predictor(docs.sparkSession, model)(F.col(text_col)))
    rest = [c for c in docs.columns if c.lower() not in ("held_out", "lang_pred", "score")]
    return found.select(*rest, held_out(id_col).alias("held_out"), f"{name}.lang_pred", f"{name}.score")


def op7_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents: doc_id, held_out, lang_pred, score."""
    return identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
