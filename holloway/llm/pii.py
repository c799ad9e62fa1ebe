"""Personal data: fixed base patterns, and contextual extraction bootstrapped from what these find.

Base spans (emails, IP addresses, payment cards, phone numbers) are seeds, and so are strings that no text has by chance: long runs of mixed
digits and letters, for secrets. The words and signs beside a seed make lexical patterns; the same patterns are read beside every
other identifier-like phrase of the corpus. Spark scores the graph of patterns and values in rounds: a pattern's confidence
in a kind is the mean score of the distinct values that it stands beside, if enough distinct seeds support it; a value's score is one
minus the product of its patterns' doubts. Confident patterns then mark values of a fitting form, as kinds found_email, found_ip,
found_card, found_phone and found_secret; a secret needs a confident pattern too, its form alone marks nothing. Base spans always
stay, and no found span overlaps one.

Forms of found values: masked or undotted mails (local parts to 64 and labels to 63 characters, as mail has them), IPv6 addresses,
digit phrases of 7 to 19 digits, and words of 8 or more letters, digits, ``_``, ``+``, ``/`` or ``-`` that have both letters and digits.

Defined cases: null and empty texts have no spans; each row keeps its own spans, also when ids repeat; patterns and scores
come from all rows; texts of any length are read whole, contexts in whole words, in linear time; an empty table gives an empty
result; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_keyed, read

KINDS = ("email", "ip", "card", "phone")
#: Kinds of found spans; the last has no base pattern.
FOUND = (*KINDS, "secret")
SECRET = len(KINDS)
#: Rounds of scoring, distinct seeds that a pattern needs, and the confidence of patterns and values that mark new spans.
ROUNDS, SEEDS, PATTERN_SURE, VALUE_SURE = 3, 3, 0.8, 0.8

# Fixed patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Forms of values that only context can tell.
_PHRASE = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9])*+")
_MASKED = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}\s?[\[(]at[\])]\s?[\w-]{1,63}(?:\s?(?:[\[(]dot[\])]|\.)\s?[\w-]{1,63})+", re.IGNORECASE)
_AT = re.compile(r"[\[(]at[\])]", re.IGNORECASE)
_V6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])")
_DIGIT = re.compile(r"[0-9]")
_KEY = re.compile(r"(?<![\w+/-])[A-Za-z0-9_+/-]{8,}+(?![\w+/-])")
_LETTER, _CAPITAL, _SMALL = re.compile(r"[A-Za-z]"), re.compile(r"[A-Z]"), re.compile(r"[a-z]")
_HEX = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
#: Signs and words of a context: a run of letters, a run of digits (all alike), or any other character that is no space.
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\s\w]|_")

RESULT = "struct<base: array<struct<kind: int, start: int, stop: int>>, slots: array<struct<kind: int, start: int, stop: int, seed: boolean, value: string, patterns: array<string>>>>"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of local part, @ and domain: at each @, the run before it and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    out = [(0, *s) for s in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub("[ -]", "", m.group())
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def _words_before(text: str, stop: int, n: int) -> list[str]:
    """The last n whole words before a place. The slice that is read grows until it holds one more, so none is cut."""
    size = 64
    while True:
        start = max(0, stop - size)
        words = _WORD.findall(text[start:stop])
        if start == 0 or len(words) > n:
            return words[-n:]
        size *= 4


def _patterns(text: str, start: int, stop: int) -> list[str]:
    """The lexical patterns round a span: three words before it, and one before with one after."""
    before = [_shape(w) for w in _words_before(text, start, 3)]
    m = _WORD.search(text, stop)
    out = []
    if len(before) == 3:
        out.append("L " + " ".join(before))
    if before and m:
        out.append(f"M {before[-1]} _ {_shape(m.group())}")
    return out


def _shape(word: str) -> str:
    return "0" if word[0].isdigit() else word.lower()


def _key_kind(value: str) -> tuple[bool, bool]:
    """Whether a word may be a secret, and whether its form is a seed: 32 hexadecimal digits, or 20 characters with capitals, small letters and digits."""
    if not (_DIGIT.search(value) and _LETTER.search(value)):
        return False, False
    return True, bool(_HEX.fullmatch(value)) or len(value) >= 20 and bool(_CAPITAL.search(value) and _SMALL.search(value))


def scan(text: str | None) -> tuple[list[tuple], list[tuple]]:
    """Base spans, and slots (kind, start, end, seed, value, patterns): seeds and other identifier-like phrases with
    each kind that their form allows, or kind -1."""
    text = text or ""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    slots = [(k, s, e, True, text[s:e], _patterns(text, s, e)) for k, s, e in base]
    found: list[tuple[int, int, list[int]]] = []
    seeds: set[int] = set()
    if "@" in text:
        found += [(m.start(), m.end(), [0]) for m in re.finditer(r"(?<![\w.%+-])[\w.%+-]{1,64}@[\w-]{2,63}", text)]
    if _AT.search(text):
        found += [(m.start(), m.end(), [0]) for m in _MASKED.finditer(text)]
    if text.count(":") >= 3:
        found += [(m.start(), m.end(), [1]) for m in _V6.finditer(text)]
    if _DIGIT.search(text):
        for m in _KEY.finditer(text):
            fits, sure = _key_kind(m.group())
            if fits:
                found.append((m.start(), m.end(), [SECRET]))
                seeds |= {m.start()} if sure else set()
        for m in _PHRASE.finditer(text):
            n = len(_DIGIT.findall(m.group()))
            kinds = [3] * (7 <= n <= 15) + [2] * (13 <= n <= 19)
            found.append((m.start(), m.end(), kinds or [-1]))
    at, last = 0, 0
    for s, e, kinds in sorted(found, key=lambda x: (x[0], -x[1])):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if s < last or at < len(taken) and taken[at][0] < e:
            continue
        last = e
        patterns = _patterns(text, s, e)
        slots += [(k, s, e, k == SECRET and s in seeds, text[s:e], patterns) for k in kinds]
    return base, [x for x in slots if x[5]]


def _scanner():
    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        base, slots = [], []
        for t in texts:
            b, s = scan(t)
            base.append([{"kind": k, "start": x, "stop": y} for k, x, y in b])
            slots.append([{"kind": k, "start": x, "stop": y, "seed": o, "value": v, "patterns": p} for k, x, y, o, v, p in s])
        return pd.DataFrame({"base": base, "slots": slots})

    return run


def _confidence(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(mark, confidence, n, rows) of the marks (a pattern and a kind) with enough seeds; ``values`` has (node, score, n)."""
    scored = join_keyed(edges, values.select("node", "score", "n"), "node", "n")
    total = scored.groupBy("pattern").agg(F.count_distinct("value").alias("values"))
    by_kind = scored.where("kind >= 0").groupBy("pattern", "mark").agg(F.sum("score").alias("mass"), F.count_if("seed").alias("seeds"), F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
    return by_kind.where(F.col("seeds") >= SEEDS).join(total, "pattern").select("mark", (F.col("mass") / F.col("values")).alias("confidence"), "n", "rows")


def bootstrap(slots: DataFrame) -> DataFrame:
    """The slots, of those that are no base spans, that confident patterns mark; ``slots`` has one row for each slot.

    A pattern or value may stand in most rows: joins on them take the number of rows that they have and spare hot ones the shuffle.
    """
    of_kind = lambda c: F.concat_ws(" ", F.col("kind").cast("string"), F.col(c))
    long = slots.select("*", F.explode("patterns").alias("pattern")).select("*", of_kind("value").alias("node"), of_kind("pattern").alias("mark"))
    edges = cut(long.groupBy("pattern", "kind", "value", "node", "mark").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("rows")))
    values = cut(edges.groupBy("node").agg(F.max("seed").cast("double").alias("score"), F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")))
    sure = None
    for _ in range(ROUNDS):
        sure = cut(_confidence(edges, values))
        held = join_keyed(edges.select("node", "mark"), sure.select("mark", "confidence", "n"), "mark", "n")
        doubt = held.groupBy("node").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence")))))).alias("gain"))
        values = cut(values.join(doubt, "node", "left").select("node", F.greatest("score", F.coalesce("gain", F.lit(0.0))).alias("score"), "n", "rows"))
    marks = sure.where(F.col("confidence") >= PATTERN_SURE).select("mark", "rows")
    known = values.where(F.col("score") >= VALUE_SURE).select("node", "rows")
    hits = long.where(f"(NOT seed OR kind = {SECRET}) AND kind >= 0").select("row", "start", "stop", "kind", "node", "mark")
    hits = join_keyed(hits, marks, "mark", "rows").drop("rows", "mark")
    hits = join_keyed(hits, known, "node", "rows")
    return hits.groupBy("row", "start", "stop").agg(F.min("kind").alias("kind"))


def _joined(spans) -> F.Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, *(f"found_{k}" for k in FOUND))])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, base and spans (arrays of kind, start, stop; kinds from 4 are found ones). Positions are code points."""
    scanned = docs.select(F.col(id_col), _scanner()(F.col(text_col)).alias("r")).select(id_col, F.monotonically_increasing_id().alias("row"), "r.base", "r.slots")
    rows = cut(scanned)
    slots = cut(rows.where(F.size("slots") > 0).select("row", F.inline("slots")))
    found = bootstrap(slots).groupBy("row").agg(F.collect_list(F.struct((F.col("kind") + len(KINDS)).alias("kind"), "start", "stop")).alias("found"))
    return rows.join(found, "row", "left").select(id_col, "base", F.concat("base", F.coalesce("found", F.array().cast("array<struct<kind: int, start: int, stop: int>>"))).alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and found), and how many these are (n_spans)."""
    found = find(read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter(F.col("base.kind"), F.lit(k).eqNullSafe)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
