"""Main text of a web page by the maximum-scoring subsequence.

The page becomes one sequence of words and tags. Words score +w, tags -t, and a
linear scan finds the contiguous stretch with the best sum: the content region.
w and t are learned from labelled pages (``pagelabels``: 300 pages of real size made by
rule, each block marked as content or not) as log-odds of a word, and of each group of
tags, to lie in content.

Elements that are never article text (scripts, styles, navigation, asides, forms,
notices, adverts, comments) are taken out first, by name, role, or a class or id all of
whose parts say so; within an article only by the plainest of these. Their
tags stay in the sequence, so the scan sees where they were, but their words don't.
The region grows to the blocks it cuts. Article and main elements (outermost, not
inside what was taken out) with text are evidence on that scan, learned as well: a
block inside scores more and its own tags cost nothing, crossing the element's edge
costs. Words outside weigh from fully for content to fully against it, by the share of
the page's words that such elements hold: a teaser leaves the body of the page its
weight, a whole article takes it. Further maximal stretches with article text are
content too. Elements without text are no evidence.

Cases: null or empty html, and pages of boilerplate only, give an empty text; broken
markup is read as a browser would, unclosed elements end with their parent, at any depth;
long pages are read whole in time proportional to their length; repeated rows give
repeated rows; further columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of
from .pagelabels import pages as labelled_pages

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
DROP = frozenset(
    "script style noscript template iframe object svg math canvas nav aside footer form button select option "
    "textarea input dialog menu head title audio video map noembed noframes fieldset label datalist".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q ruby rb rp rt s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Parts of class and id names of what is no article text. A name tells if one of its
#: parts is in NOISE and all others are in NOISE or PLAIN: ``cookie-notice``, not ``share-price``.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising advertorial sponsor sponsored sponsors promo promos promotion banner "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar sidebars nav navbar "
    "navigation menu menus breadcrumb breadcrumbs footer footers masthead topbar comment comments commentlist disqus replies respond related "
    "recommended recommendations sharing share social widget widgets toolbar pagination pager skip copyright disclaimer".split()
)
PLAIN = frozenset(
    "bar box block list section wrapper wrap container content inner outer area item items links link row col column panel group main site page "
    "top bottom left right primary secondary global header message buttons button icons form area text title unit slot reader user to in up".split()
)
#: Outside an article these tell as well.
NOISE_OUTSIDE = NOISE | frozenset("side aside foot tag tags alert legal rating reply header".split())
_SPLIT = re.compile(r"([a-z0-9])([A-Z])")
_PARTS = re.compile(r"[^a-z]+")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?")
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"\s+")
#: What a start tag ends, unless one of the second set is open within it. Fixed values of HTML.
_P_STOPS = frozenset("button table td th caption li dd dt div section article aside main blockquote body".split())
_P = ("p", _P_STOPS)
_TABLE = frozenset(["table"])
_ENDS: dict[str, list[tuple[str, frozenset[str]]]] = {
    **dict.fromkeys("p div ul ol dl table section article aside nav header footer main form h1 h2 h3 h4 h5 h6 pre blockquote hr figure address details fieldset".split(), [_P]),
    "li": [("li", frozenset(["ul", "ol"])), _P], "dt": [("dt", frozenset(["dl"])), ("dd", frozenset(["dl"])), _P],
    "dd": [("dt", frozenset(["dl"])), ("dd", frozenset(["dl"])), _P], "tr": [("tr", _TABLE), ("td", _TABLE), ("th", _TABLE)],
    "td": [("td", _TABLE), ("th", _TABLE)], "th": [("td", _TABLE), ("th", _TABLE)], "option": [("option", frozenset(["select"]))],
}
#: Labelled pages to learn from, and the seed that they are made of.
LEARN_PAGES, LEARN_SEED = 300, 20240521


def _attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        v = m.group(2) or ""
        out.setdefault(m.group(1).lower(), htmllib.unescape(v[1:-1] if v[:1] in "\"'" and v else v))
    return out


def _unwanted(name: str, raw: str, in_article: bool) -> bool:
    if name in DROP:
        return True
    if name == "header":
        return not in_article
    if not raw or "=" not in raw and "hidden" not in raw:
        return False
    a = _attrs(raw)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.IGNORECASE):
        return True
    if name in ("html", "body", "article", "main") or name in INLINE and name != "span":
        return False
    telling = NOISE if in_article else NOISE_OUTSIDE
    for word in _SPLIT.sub(r"\1-\2", f"{a.get('class', '')} {a.get('id', '')}").lower().split():
        parts = [x for x in _PARTS.split(word) if x]
        if any(x in telling for x in parts) and all(x in telling or x in PLAIN for x in parts):
            return True
    return False


class Block:
    """A stretch of text between block-level tags, with the tags in front of it."""

    __slots__ = ("tags", "text", "zone")

    def __init__(self, zone: int):
        self.tags: list[str] = []
        self.text: list[str] = []
        self.zone = zone


def blocks(page: str) -> list[Block]:
    """The page in order. zone: the number of the article or main element that a
    block lies in, 0 outside."""
    # Open elements (name, taken out, zone): blocks, what is taken out, and all inside that.
    # Plain inline elements change nothing, so they aren't kept.
    stack: list[tuple[str, bool, int]] = []
    where: dict[str, list[int]] = defaultdict(list)  # places on the stack by name
    out = [Block(0)]
    zones = 0
    at, n = 0, len(page)

    def state() -> tuple[bool, int]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    def close(place: int) -> None:
        while len(stack) > place:
            where[stack.pop()[0]].pop()

    def cut(tag: str) -> None:
        out[-1].tags.append(tag) if not out[-1].text else None
        if out[-1].text or out[-1].zone != state()[1]:
            out.append(Block(state()[1]))
            out[-1].tags.append(tag)

    def say(text: str) -> None:
        if text and not state()[0]:
            out[-1].text.append(htmllib.unescape(text) if "&" in text else text)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            if page.startswith("</", lt):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                say("<")
                at = lt + 1
            continue
        at = m.end()
        name, raw = m.group(2).lower(), m.group(3)
        if m.group(1):
            if where[name]:
                close(where[name][-1])
            if name not in INLINE:
                cut("/" + name)
            continue
        ends = [where[x][-1] for x, stops in _ENDS.get(name, ()) if where[x] and all(not where[y] or where[y][-1] < where[x][-1] for y in stops if y != x)]
        if ends:
            close(min(ends))
        gone, zone = state()
        if name in VOID:
            if name in ("br", "hr") or name not in INLINE and name != "img":
                out[-1].text.append(" ") if name == "br" and out[-1].text else None
                if name == "br":
                    out[-1].text.append(" ")
                elif name not in ("input", "link", "meta", "wbr"):
                    cut(name)
            continue
        gone = gone or _unwanted(name, raw, zone > 0)
        if name in ("article", "main") and not gone and zone == 0:
            zones += 1
            zone = zones
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if name not in DROP and not gone:
                say(page[at : end.start() if end else n])
            at = end.start() if end else n
            if end:
                shut = page.find(">", at)
                at = n if shut < 0 else shut + 1
            cut(name)
            continue
        if raw.endswith("/") and name in ("svg", "path"):
            continue
        if gone or name not in INLINE:
            where[name].append(len(stack))
            stack.append((name, gone, zone))
        if name not in INLINE:
            cut(name)
    return out


#: Tags of what a reader never sees; they tell nothing of the words around them.
UNSEEN = frozenset("html head body script style noscript template meta link base title param source track".split())


def _groups(tags: list[str]) -> set[str]:
    """The groups of a run of tags; without words between them it is one boundary."""
    out = set()
    for tag in tags:
        tag = tag.lstrip("/")
        if tag in UNSEEN:
            continue
        if tag in ("p", "br", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"):
            out.add("prose")
        elif tag in ("li", "ul", "ol", "td", "tr", "table", "th", "tbody", "thead", "dl", "dt", "dd"):
            out.add("list")
        else:
            out.add("frame")
    return out


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    """Log-odds of a word, of each tag group, of a block's place in an article and of
    an article's edge to lie in content, from labelled pages; words and places are kept above
    zero, tags and edges below it."""
    inside: dict[str, float] = {}
    outside: dict[str, float] = {}

    def count(good: bool, key: str, n: int = 1) -> None:
        side = inside if good else outside
        side[key] = side.get(key, 0) + n

    for page, content in labelled_pages(LEARN_PAGES, LEARN_SEED):
        last = None
        texts = set(content)
        for b in blocks(page):
            text = _SPACE.sub(" ", "".join(b.text)).strip()
            good = text in texts
            if not b.zone:
                for group in _groups(b.tags):
                    count(good, group)
            count(good, "word", len(text.split()))
            if text:
                if b.zone:
                    count(good, "zone")
                if last and (last[0] > 0) != (b.zone > 0):
                    count(good and last[1], "edge")
                last = (b.zone, good)
    total = ("word", "prose", "list", "frame", "zone", "edge")
    base = math.log((sum(inside.values()) + 1) / (sum(outside.values()) + 1))
    odds = {k: math.log((inside.get(k, 0) + 0.5) / (outside.get(k, 0) + 0.5)) - base for k in total}
    up = {k: max(0.2, odds.pop(k)) for k in ("word", "zone")}
    return up | {k: min(-0.05, v) for k, v in odds.items()}


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous stretch with the largest sum; the earliest and
    longest of equal ones; (0, 0) if no sum is above zero."""
    best, lo, hi = 0.0, 0, 0
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best + 1e-12 or (best and start == lo and abs(total - best) <= 1e-12):
            best, lo, hi = total, start, i + 1
    return lo, hi


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    w = weights()
    own = blocks(page)
    texts = [_SPACE.sub(" ", "".join(b.text)).strip() for b in own]
    words = [len(t.split()) for t in texts]
    share = sum(n for n, b in zip(words, own, strict=True) if b.zone) / max(1, sum(words))
    stray = w["word"] * (1 - 2 * share)
    scores: list[float] = []
    at: list[int] = []  # the block of a score, -1 for tags and edges
    last = None
    for i, (b, n) in enumerate(zip(own, words, strict=True)):
        if n and last is not None and (b.zone > 0) != (last > 0):
            scores.append(w["edge"])
            at.append(-1)
        if b.zone:
            scores.append(w["word"] * n + w["zone"] if n else 0.0)
        else:
            scores.append(sum(w[g] for g in _groups(b.tags)))
            at.append(-1)
            scores.append(stray * n)
        at.append(i)
        last = b.zone if n else last
    articles = [i for i, k in enumerate(at) if k >= 0 and own[k].zone and words[k]]
    runs = []
    work = [(0, len(scores))]
    while work:
        a, z = work.pop()
        # the best of all, then the best of what is left that holds article text
        if runs and bisect_left(articles, a) == bisect_left(articles, z):
            continue
        lo, hi = best_run(scores[a:z])
        if lo < hi:
            runs.append((a + lo, a + hi))
            work += [(a, a + lo), (a + hi, z)]
    keep: set[int] = set()
    for lo, hi in runs:
        got = [k for k in at[lo:hi] if k >= 0]
        keep.update(got)
        # the heading right above belongs to it
        k = got[0]
        while k > 0 and own[k - 1].tags[-1:] and own[k - 1].tags[-1] in ("h1", "h2", "h3") and own[k - 1].zone == own[k].zone:
            k -= 1
            keep.add(k)
    return " ".join(texts[k] for k in sorted(keep) if texts[k])


def main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of df. One pass, no shuffle."""

    def run(batches):
        for b in pieces_of(batches, 2):
            texts = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    narrow = df.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
