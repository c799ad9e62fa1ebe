"""Main text of raw HTML pages by two-pass block rules.

A page is cut into blocks at its block-level tags. The first pass decides by a block's own features. Full of links: boilerplate, but for a
lone one in an article, which stays open. Long with many stop words: main text. Long with few stop words: boilerplate, if the page has main text elsewhere and the block is in no
article; on a page where no block has many, as in a language without a list, length decides alone. Stop words are those of STOP_WORDS and the page's own frequent short words. Short blocks, headings and stopless blocks of an article stay open. In the second pass these inherit the
label of the nearest decided block of their region, headings of the one after them; of two equally near ones main text counts. Blocks of
links give no label where nothing is main text. Short blocks that end no sentence, above the first heading or main text, are menus where there is no article.

Where a block stands is a further feature. Menus, footers and hidden parts are boilerplate, and forms that hold less than half of the page's words. Class and id names mark adverts,
side bars or comments by their last word (``cookie-notice`` is one, ``social-history`` is not); they are disregarded on a page
without article elements that has nothing else. Article elements are a region each: those with main text win over those
without (teaser cards), and none of them counts if there is more main text beside them than they have words.

Defined cases: null, empty and markup-only pages give the empty text; raw text of scripts and styles is skipped up to its end
tag, or to the end of the page; unclosed tags end with their container, list items and table cells, rows and parts also where the next
one begins; a tag with an open quote ends at the next ``>``; a page is handled as a whole, whatever its length; repeated pages give
repeated rows; an empty table gives an empty result; further columns stay, those named text or n_chars are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter, defaultdict
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import read

#: Words of a long block; shares of stop words and of link text; how many times an article's words the main text beside it must have to count.
LONG_WORDS, STOP_SHARE, LINK_SHARE, BESIDE = 10, 0.12, 0.5, 2
#: Share of the page's words above which a form is the page; letters of a page's own stop words at most, and how often it must have them.
FORM_SHARE, OWN_LETTERS, OWN_TIMES = 0.5, 3, 4

# Tags by their role, class and id words of boilerplate, frequent words of several languages.
BLOCK_TAGS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                 "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = set("article aside body dd details dialog div dl dt fieldset figure footer form head header li main menu nav ol section table tbody td th tr ul button select title".split())
BAD_TAGS = set("aside button dialog footer head menu nav select title".split())
RAW_TAGS = "script|style|noscript|template|textarea|svg|iframe|object|canvas|audio|video|math"
BAD_WORDS = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
                "footer gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup "
                "promo promoted promotion recommended related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
                "tagcloud teaser toolbar widget widgets".split())
#: Last words of names whose word before tells what they hold.
HOLDERS = set("area banners bar block body box btn button buttons card cards col column container content cta entry form frame group holder icon icons inner item items label "
              "link links list module outer panel posts row section slot stories text title unit wrap wrapper zone".split())
#: First words of names that tell a state, and tags whose names do.
STATES, STATE_TAGS = set("has is no not show toggle with without".split()), {"html", "body"}
BAD_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_ITEM_ENDS = CONTAINERS - {"li", "dd", "dt", "div"}
_TABLE = {"table"}
#: Tags that end open ones when they begin: which, and the open tags that they do not look beyond.
IMPLIED = {"li": ({"li"}, _ITEM_ENDS | {"dd", "dt"}), "dd": ({"dd", "dt"}, _ITEM_ENDS | {"li"}), "dt": ({"dd", "dt"}, _ITEM_ENDS | {"li"}),
           "td": ({"td", "th"}, _TABLE | {"tr"}), "th": ({"td", "th"}, _TABLE | {"tr"}), "tr": ({"tr", "td", "th"}, _TABLE),
           **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th"}, _TABLE))}
STOP_WORDS = set("a an and are as at be been but by for from had has have he her his i if in into is it its not of on or she so that the their there they this to was we were "
                 "which who will with would you der die das den dem des ein eine einer und oder ist sind war nicht mit von zu im auf für als auch sich es er sie wir ich "
                 "le la les un une des du de et ou est sont dans par pour pas que qui sur avec ce cette il elle au aux en el los las y o es son del al se lo como más pero sus su "
                 "con no una por para "
                 "di che è della dei nel alla sono ha più anche delle gli "  # Italian
                 "os da dos das em um uma não com mais foi ao às pelo seu sua "  # Portuguese
                 "het een van op te dat niet zijn aan ook maar voor met werd deze "  # Dutch
                 "och att det som på är av för med den till har inte om var ett "  # Swedish
                 "og at af på er til ikke det som har med blev også "  # Danish and Norwegian
                 "i w na z że nie się do jest o jak po za od był był oraz przez są "  # Polish
                 "ve bir bu da de için ile çok olarak daha olan gibi "  # Turkish
                 "a az és hogy nem egy is volt meg el ki de "  # Hungarian
                 "v je se že na s o ve by do pro ale jsou byl jako "  # Czech
                 "и в не на что с по как это к из у за от но его был она они для так все же или "  # Russian
                 "και το να η τα με της για στο που οι την από είναι του "  # Greek
                 "של את על לא עם זה הוא היא כי גם אל היה היו כבר מן לפני רק או יש אין מה "  # Hebrew
                 "في من على أن إلى هذا التي الذي كان عن مع لا ما "  # Arabic
                 "के में है की को से का और पर यह हैं ने था "  # Hindi
                 "的 了 是 在 不 和 有 这 我 他 们 与 也 为 "  # Chinese
                 "の は を に が で と も た し て い".split())  # Japanese

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW_TAGS})(?=[\s/>])[^<>]*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<open>/?[a-zA-Z][^<>]*)>|<[!?/][^<>]*>|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: A word: a character of scripts that are written without spaces and have stop words of one character, or what stands between these and white space.
_WORD = re.compile(r"[\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF]|[^\s\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF]+")
_SENTENCE = re.compile(r"[.!?:…。！？।؟][\"'»”’)\]]*$")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NOTICE = re.compile(r"(?:©|\(c\) |copyright\b|all rights reserved)", re.IGNORECASE)
#: How sure it is that a place is boilerplate.
CLEAR, NAMED, PLACED = 0, 1, 2


class _Block:
    __slots__ = ("parts", "link", "bad", "main", "heading", "form")

    def __init__(self, bad: int, main: int, heading: bool, form: int):
        self.parts: list[str] = []
        self.link, self.bad, self.main, self.heading, self.form = 0, bad, main, heading, form


def _bad_name(name: str) -> bool:
    """Whether one class or id tells boilerplate: by its last word, or by the one before a word that only holds."""
    words = [w.lower() for w in _NAME.findall(name)]
    while len(words) > 1 and words[-1] in HOLDERS:
        words.pop()
    return bool(words) and words[-1] in BAD_WORDS and words[0] not in STATES


def _attributes(rest: str) -> tuple[int, bool]:
    """How sure a tag's attributes tell boilerplate, and whether they tell main text."""
    bad, main = CLEAR, False
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if any(map(_bad_name, value.split())):
                bad = max(bad, NAMED)
        elif name == "role":
            bad = PLACED if value.lower() in BAD_ROLES else bad
            main |= value.lower() == "main"
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            bad = PLACED
        elif name == "itemprop":
            main |= value == "articleBody"
    return bad, main


def blocks(html: str) -> list[tuple[str, int, int, int, bool]]:
    """(text, characters of link text, CLEAR, NAMED or PLACED, number of the article or 0, heading) of each block in page order; forms with little of the page's text are PLACED."""
    out: list[_Block] = []
    stack: list[tuple[str, int, int, int]] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # where each tag stands in the stack
    bad, main, articles, links, form, forms = CLEAR, 0, 0, 0, 0, 0
    now = _Block(CLEAR, 0, False, 0)

    def turn(heading: bool = False) -> None:
        nonlocal now
        if now.parts:
            out.append(now)
        now = _Block(bad, main, heading, form)

    def close(k: int) -> None:
        nonlocal bad, main, form
        bad, main, form = stack[k][1:]
        for tag, *_ in stack[k:]:
            places[tag].pop()
        del stack[k:]

    last = html.rfind(">")
    for m in _TOKEN.finditer(html):
        text = m["text"]
        if text == "<" and m.start() > last and html[m.end() : m.end() + 1].isalpha():
            break  # a tag that never ends
        if text is not None:
            now.parts.append(text)
            if links:
                now.link += len(text.strip())
            continue
        tag, end, rest = m["tag"], m["end"], m["rest"]
        if m["open"]:
            end, tag, rest = re.match(r"(/?)([^\s/]*)(.*)", m["open"], re.DOTALL).groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            now.parts.append(" ")
        elif tag == "a":
            links = 0 if end else 1
        elif end:
            if tag in BLOCK_TAGS or stack and stack[-1][0] == tag:
                if places[tag]:
                    close(places[tag][-1])
                links = 0
                turn()
        else:
            own_bad, own_main = _attributes(rest) if rest.strip(" /") and tag not in STATE_TAGS else (CLEAR, False)
            if tag in BLOCK_TAGS:
                if stack and stack[-1][0] == "p":  # a paragraph ends where a block begins
                    close(len(stack) - 1)
                if tag in IMPLIED:
                    ended, within = IMPLIED[tag]
                    limit = max((places[t][-1] for t in within if places[t]), default=-1)
                    over = [p[at] for t in ended if (at := bisect(p := places[t], limit)) < len(p)]
                    if over:
                        close(min(over))
                links = 0
            if tag in CONTAINERS or own_bad:
                places[tag].append(len(stack))
                stack.append((tag, bad, main, form))
                if tag == "form" and not form:
                    forms += 1
                    form = forms
                bad = max(bad, own_bad, PLACED if tag in BAD_TAGS or tag == "header" and not main else CLEAR)
                if not bad and not main and (tag in ("article", "main") or own_main):
                    articles += 1
                    main = articles
            if tag in BLOCK_TAGS or tag in BAD_TAGS or own_bad:
                turn(len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
    turn()
    found = [(b, text) for b in out if (text := " ".join(unescape("".join(b.parts)).split()))]
    words: Counter = Counter()
    for b, text in found:
        if b.bad != PLACED and b.link <= LINK_SHARE * len(text):
            words[b.form] += len(text)
    small = {f for f in words if f and words[f] <= FORM_SHARE * words.total()}
    return [(text, b.link, PLACED if b.form in small or b.form and b.form not in words else b.bad, b.main, b.heading) for b, text in found]


def _words(text: str) -> list[str]:
    return [w.strip(".,;:!?\"'()。、，").lower() for w in _WORD.findall(text)]


def _size(text: str, words: list[str]) -> float:
    """The length of a text in words; where there are no spaces two characters, or eight of an alphabet, count as one."""
    return max(len(words) - sum(len(w) == 1 and w >= "\u3040" for w in words) / 2, len(text) / 8)


def inherit(label: list[bool | None], region: list[int], same: list[bool], heading: list[bool]) -> list[bool]:
    """The second pass: open blocks take the label of the nearest decided block of their region, before or after them."""
    def nearest(places) -> list[int | None]:
        seen: dict[int, int] = {}
        out: list[int | None] = [None] * len(label)
        for k in places:
            out[k] = seen.get(region[k])
            if label[k] is not None and same[k]:
                seen[region[k]] = k
        return out

    before, after = nearest(range(len(label))), nearest(reversed(range(len(label))))
    out = []
    for k, got in enumerate(label):
        if got is None:
            a, b = before[k], after[k]
            if a is None or b is None:
                got = True if a is b else bool(label[b if a is None else a])
            else:
                got = bool(label[b] if heading[k] or b - k < k - a else label[a] or b - k == k - a and label[b])
        out.append(got)
    return out


def classify(found: list[tuple[str, int, int, int, bool]]) -> list[bool]:
    """Whether each block is main text."""
    words = [_words(text) for text, *_ in found]
    size = [_size(text, w) for (text, *_), w in zip(found, words, strict=True)]
    linked = [link > LINK_SHARE * len(text) for text, link, *_ in found]
    often = Counter(w for ws, full in zip(words, linked, strict=True) if not full for w in ws if len(w) <= OWN_LETTERS and w.isalpha())
    stops = STOP_WORDS | {w for w, n in often.items() if n >= OWN_TIMES} if STOP_WORDS else STOP_WORDS
    density = lambda ws: sum(w in stops for w in ws) / len(ws)
    long = [not heading and n >= LONG_WORDS and not full for n, full, (*_, heading) in zip(size, linked, found, strict=True)]
    dense = [ok and density(w) >= STOP_SHARE for ok, w in zip(long, words, strict=True)]
    sure = CLEAR
    if not any(main for *_, main, _ in found) and not any(bad == CLEAR and not full for full, (_, _, bad, _, _) in zip(linked, found, strict=True)):
        sure = NAMED  # nothing but what names tell against: they are disregarded
    named = [bad <= sure for _, _, bad, _, _ in found]
    main_of = [main for *_, main, _ in found]
    heading = [h for *_, h in found]
    open_ = [ok and not full for ok, full in zip(named, linked, strict=True)]
    dense = [ok and d for ok, d in zip(open_, dense, strict=True)]
    if not any(dense):
        dense = [ok and n for ok, n in zip(open_, long, strict=True)]  # no block has stop words: length decides alone
    # Regions: the articles with main text, or all if none has any; none if more main text stands beside them than they have words.
    chosen = {main for d, main in zip(dense, main_of, strict=True) if d and main} or {main for ok, main in zip(open_, main_of, strict=True) if ok and main}
    inside = sum(n for n, ok, main in zip(size, open_, main_of, strict=True) if ok and main in chosen)
    beside = sum(n for n, d, main in zip(size, dense, main_of, strict=True) if d and not main)
    teasers = beside > BESIDE * inside
    if teasers:
        chosen = set()
    region = [main if main in chosen else 0 for main in main_of]
    # A lone block of links between others of an article is a sentence that is linked, not a list.
    lone = [full and ok and r > 0 and not any(0 <= j < len(found) and linked[j] and region[j] == r for j in (k - 1, k + 1)) for k, (full, ok, r) in enumerate(zip(linked, named, region, strict=True))]
    candidate = [(ok or alone) and (not chosen or r in chosen) and (not teasers or d or not main) for ok, alone, d, r, main in zip(open_, lone, dense, region, main_of, strict=True)]
    any_dense = any(d and ok for d, ok in zip(dense, candidate, strict=True))
    top = next((k for k, (d, ok, h) in enumerate(zip(dense, candidate, heading, strict=True)) if ok and (d or h)), 0)
    # First pass.
    label: list[bool | None] = []
    for k, (n, ok, d, r, (text, *_)) in enumerate(zip(size, candidate, dense, region, found, strict=True)):
        short = n < LONG_WORDS
        if not ok or short and not r and (_NOTICE.match(text) or k < top and not _SENTENCE.search(text)):
            label.append(False)
        elif d:
            label.append(True)
        elif heading[k] or short or r or not any_dense:
            label.append(None)
        else:
            label.append(False)
    decides = [(not chosen or r in chosen and ok) and (any_dense or not full) for r, ok, full in zip(region, named, linked, strict=True)]
    return inherit(label, region, decides, heading)


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks in order, joined by single spaces."""
    found = blocks(html or "")
    return " ".join(b[0] for b, keep in zip(found, classify(found), strict=True) if keep)


@F.pandas_udf(StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars (its code points); columns of these two names are replaced."""
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    return pages.select(*rest, _main_text(F.col(html_col)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of pages: page_id, url, text, n_chars."""
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
