import hashlib
import random
import re

from holloway.llm.pii import FOUND, KINDS, _luhn, base_spans, find, op5_pii, scan

from .cases import TEXTS, documents, empty

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(t):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_are_the_patterns():
    rng = random.Random(3)
    parts = ["1", "22", "4", "255", ".", ".", "@", "a", "b-", "+", "(", ")", " ", "-", "_", "x.y", "4111111111111111", "é"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert base_spans(t) == brute(t), t


def test_long_runs_take_linear_time():
    for t in ("a1 " * 100_000, "x1" * 100_000, ("x" * 50_000 + " 1234567 ") * 5, "1" * 200_000, "1." * 100_000, "a" * 200_000, "a@" * 50_000, "+1" * 50_000, "(at)" * 50_000):
        scan(t)


def test_context_finds_unseen_values(spark):
    docs = [(k, f"Please call phone number: +1 (555) 010-{1000 + k * 7} now") for k in range(8)]
    docs += [(100, "Please call phone number: 555-010-9999 now")] * 2 + [(101, "the year 1999-2000 12345678 was"), (102, "call 12345678 times")]
    rows = find(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {r.doc_id: [tuple(s) for s in r.spans if s.kind >= len(KINDS)] for r in rows}
    assert found[100] == [(7, 26, 38)] and not found[101] and not found[102] and not found[0]
    assert len(rows) == len(docs)


def planted(rng, n):
    """(id, text, kind and span of the value that only context tells, or none): contexts of five kinds, with seeds and unseen forms, and texts that look alike."""
    contexts = {"email": "write to the address <%s> today", "ip": "connected from host [%s] at noon", "card": "paid by card no. %s yesterday", "phone": "reach me on tel: %s or later", "secret": 'set api key = "%s" there'}
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
    card = lambda: next(d for d in iter(lambda: "4" + digits(15), "") if _luhn(d))
    no_card = lambda: next(d for d in iter(lambda: "4" + digits(15), "") if not _luhn(d))
    seeds = {"email": lambda: f"{word(6)}@{word(5)}.org", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "card": card,
             "phone": lambda: f"+1 {digits(3)} {digits(3)} {digits(4)}", "secret": lambda: "a1" + "".join(rng.choice("0123456789abcdef") for _ in range(38))}
    unseen = {"email": lambda: f"{word(6)} (at) {word(5)} (dot) org", "ip": lambda: ":".join(f"{rng.randrange(1 << 16):04x}" for _ in range(8)), "card": no_card,
              "phone": lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", "secret": lambda: f"{word(5)}{digits(4)}-{word(3)}"}
    rows = []
    for k in range(n):
        kind = KINDS[k // 4 % 4] if k % 20 < 16 else "secret"
        lead, tail = " ".join(word(4) for _ in range(rng.randrange(3, 9))), " ".join(word(5) for _ in range(4))
        if k % 4 == 3:  # the same forms elsewhere
            rows.append((k, f"{lead} {unseen[kind]()} {tail}", None))
        else:
            value = seeds[kind]() if k % 4 else unseen[kind]()
            text = f"{lead} {contexts[kind] % value} {tail}"
            at = text.index(value)
            rows.append((k, text, (kind, at, at + len(value)) if not k % 4 or kind == "secret" else None))
    return rows


def test_recall_and_precision_of_found_kinds(spark):
    rows = planted(random.Random(5), 600)
    want = {(i, *x) for i, _, x in rows if x}
    out = find(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)).collect()
    got = {(r.doc_id, FOUND[s.kind - len(KINDS)], s.start, s.stop) for r in out for s in r.spans if s.kind >= len(KINDS)}
    for kind in FOUND:
        w, g = {x for x in want if x[1] == kind}, {x for x in got if x[1] == kind}
        assert len(w) > 20 and len(w & g) >= 0.95 * len(w) and len(w & g) >= 0.95 * len(g), kind


def test_contexts_are_whole_words(spark):
    long = "x" * 5000
    docs = [(k, f"the {long} number {n} end") for k, n in enumerate(["+1 555 010 1000", "+1 555 010 2000", "+1 555 010 3000", "555 010 4000"])] + [(9, f"the {long[:-1]}y number 555 010 5000 stop")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: [3], 1: [3], 2: [3], 3: [7], 9: []}


def test_cases(spark):
    assert find(documents(spark)).count() == len(TEXTS)
    assert find(empty(spark)).count() == 0


def test_query(spark, sf):
    rows = op5_pii(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        want = brute(r.text or "")
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == i for s in want) for i in range(4)]
        joined = [f"{KINDS[k]}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | {""} and r.n_spans == len([x for x in r.spans.split(",") if x])
