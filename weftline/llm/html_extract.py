"""Main text of HTML pages as the contiguous run of tokens with the largest score.

A page becomes a sequence of tags and stretches of words. Words score positive where labelled pages
have words of their kind in the article more often than outside, tags negative, by how much more often
they stand outside; one linear scan finds the run with the largest sum. Menus, forms, comments and the
like inside that run are left out. A kind is the element a word stands in, or the sort of furniture
around it, which names, roles, classes and ids of elements tell.

Labelled pages are those of a bounded sample (sample_pages, the smallest hashes of page_id) that mark
their article with an article or main element; what lies in it, furniture aside, is main text.

Odd rows: a null page is an empty one; without words, or where no run has a positive sum, the text is
empty (n_chars 0). Unclosed, stray and cut-off tags are tolerated, at any depth and in time in
proportion to the page: a head without an end tag ends where something stands that it can't hold, other
silent elements without one are as if they were not there, but scripts and their like, which hide all
that follows. Pages of any length are gone through whole. Rows that repeat give a row each, an empty
table none. Other columns than page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import batch, prepare

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*)>|<[a-zA-Z/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template iframe object svg math canvas head title textarea select option button audio video datalist".split())
#: Those whose content is raw text, up to the end of the page if they have no end tag.
RAW = frozenset("script style textarea title noscript iframe".split())
_HEAD_ENDS = re.compile(r"</head\s*>|(?=<(?!(?:title|meta|link|script|style|base|noscript|template)\b)[a-z])", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: Furniture by element, by role, and by words in class or id.
BY_NAME = {"nav": "menu", "footer": "footer", "aside": "side", "form": "form", "menu": "menu", "dialog": "notice", "header": "header"}
BY_ROLE = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form", "form": "form", "dialog": "notice", "alertdialog": "notice", "alert": "notice", "toolbar": "menu"}
BY_WORD = {
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs topbar toolbar pagination pager toc tabs skip",
    "header": "header masthead",
    "footer": "footer copyright colophon legal",
    "side": "sidebar side aside widget widgets related recommended recommendations popular trending tags",
    "notice": "notice notices cookie cookies consent gdpr alert popup modal overlay banner disclaimer paywall toast",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted teaser outbrain taboola",
    "form": "form login signin signup search subscribe subscription newsletter",
    "comment": "comment comments commentlist reply replies respond disqus discussion feedback",
    "share": "share sharing social follow",
}
_WORD_KIND = {w: kind for kind, words in BY_WORD.items() for w in words.split()}
_CONTENT_WORDS = frozenset("article entry post content story main body text".split())
_PARTS = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_CLOSED_BY = {"p": "p", "li": "li", "tr": "tr", "td": "td", "th": "th", "dt": "dt", "dd": "dd", "option": "option"}


def _furniture(name: str, attributes: str, in_article: bool) -> str:
    kind = BY_NAME.get(name, "")
    if kind == "header" and in_article:
        kind = ""
    if kind or not attributes or name in ("html", "body", "article", "main"):
        return kind
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return "hidden"
        if key == "role" and value.lower() in BY_ROLE:
            return BY_ROLE[value.lower()]
        if key in ("class", "id"):
            for one in value.split():
                words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower()) if w]
                kinds = [_WORD_KIND[w] for w in words if w in _WORD_KIND]
                if kinds and not (_CONTENT_WORDS.intersection(words) and kinds[-1] in ("header", "side", "notice")):
                    return kinds[0]
    return ""


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, text, inside): tags have an empty text; a tag that parts words of a block gives a text of one space first."""
    stack: list[tuple[str, str]] = []  # open elements with the furniture they begin
    blocks: list[str] = []  # the names of those that are not inline
    opened: Counter[str] = Counter()
    around: list[str] = []  # furniture around, innermost last
    endless: set[str] = set()  # silent elements that no end tag follows
    articles, at, end = 0, 0, len(page)

    def pop(k: int) -> None:
        nonlocal articles
        for name, kind in stack[k:]:
            articles -= name in ("article", "main")
            opened[name] -= 1
            if kind:
                around.pop()
            if name not in INLINE or name == "a":
                blocks.pop()
        del stack[k:]

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            block = blocks[-1] if blocks else ""
            yield "w:" + (around[-1] if around else block), entities.unescape(page[at:stop]), articles > 0 and not around
        if not m:
            return
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if opened[name] > 0:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
        elif name in SILENT and not m[3].rstrip().endswith("/"):
            if name not in endless:
                close = (_HEAD_ENDS if name == "head" else re.compile(rf"</{re.escape(name)}\s*>", re.I)).search(page, at)
                if close:
                    at = close.end()
                elif name in RAW:
                    at = end
                else:
                    endless.add(name)
        elif name not in VOID:
            if name not in INLINE:
                while stack and (stack[-1][0] in INLINE and stack[-1][0] != "a" and len(stack) > 1 and stack[-2][0] == "p"):
                    pop(len(stack) - 1)
                if stack and (stack[-1][0] == "p" or _CLOSED_BY.get(name) == stack[-1][0]):
                    pop(len(stack) - 1)
            kind = _furniture(name, m[3], articles > 0)
            stack.append((name, kind))
            opened[name] += 1
            if name not in INLINE or name == "a":
                blocks.append(name)
            if kind:
                around.append(kind)
            articles += name in ("article", "main")
        yield "t:" + name, "" if name in INLINE else " ", articles > 0 and not around


def learn(pages: list[str]) -> dict[str, float]:
    """Weights by kind from labelled pages."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page in pages:
        for kind, text, within in tokens(page):
            (inside if within else outside)[kind] += len(text.split()) if kind[0] == "w" else 1
    weights = {}
    for kind in inside.keys() | outside.keys():
        odds = math.log((inside[kind] + 0.5) / (outside[kind] + 0.5))
        weights[kind] = max(-3.0, min(2.0, odds)) if kind[0] == "w" else -min(2.0, max(0.1, 0.3 - odds / 4))
    return weights


def score(kind: str, weights: dict[str, float]) -> float:
    """A kind that labelled pages don't show: words count for, furniture and tags against."""
    found = weights.get(kind)
    if kind[0] == "t":
        return -0.4 if found is None else found
    if kind[2:] in BY_WORD or kind[2:] == "hidden":
        return min(-1.0, found or -1.0)
    return 1.0 if found is None else found if found > 0 else max(found, -1.0)


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The run with the largest sum, furniture left out."""
    found = list(tokens(page or ""))
    best = total = 0.0
    start = first = last = 0
    for k, (kind, text, _) in enumerate(found):
        total += score(kind, weights) * (len(text.split()) if kind[0] == "w" else 1)
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, first, last = total, start, k + 1
    return " ".join("".join([t for k, t, _ in found[first:last] if k[0] == "t" or not (k[2:] in BY_WORD or k[2:] == "hidden")]).split())


def main_text(pages: DataFrame, sample_pages: int = 400) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    spark = pages.sparkSession
    prepare(spark)
    sample = pages.select("page_id", F.col("html").cast("string").alias("html")).filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    chosen = sample.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    known = sample.join(F.broadcast(chosen), "page_id", "left_semi").select("html")  # sample_pages ids at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = learn([page for rows in batches for page in rows.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], names=["kind", "weight"])

    learned = {r["kind"]: r["weight"] for r in known.repartition(1).mapInArrow(count, "kind string, weight double").collect()}  # a few hundred kinds
    weights = spark.sparkContext.broadcast(learned)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [extract(p, weights.value) for p in rows.column(2).to_pylist()]
            yield batch(schema, page_id=rows.column(0), url=rows.column(1), text=texts, n_chars=[len(t) for t in texts])

    columns = F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")
