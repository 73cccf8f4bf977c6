"""Text functions with state, for use row by row in Arrow batches: sentences, summaries, links in HTML."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftline.config import ABBREVIATIONS, QUESTION_MARKS, QUESTION_PHRASES, STOPWORDS
from weftline.session import ship

_SPLIT = regex.compile(r"(?<=[.!?])\s+")
_JOINED = regex.compile(r"([.!?])(?=\p{Lu})")
_WORD_EDGE = regex.compile(r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$")
_TAG = re.compile(r"""<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:"[^"]*"|'[^']*'|[^'">])*>""", re.S)
#: Elements in whose text no link is set.
NO_LINKS = frozenset(("a", "code", "pre", "script", "style", "h1", "h2", "h3", "h4", "h5", "h6"))


def sentences(text: str | None) -> list[str]:
    """Sentences of a text; a full stop after an initial or an abbreviation ends none."""
    parts = _SPLIT.split(_JOINED.sub(r"\1 ", " ".join((text or "").split())))
    out: list[str] = []
    for part in filter(None, parts):
        if out and _goes_on(out[-1]):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def _goes_on(part: str) -> bool:
    if not part.endswith("."):
        return False
    last = (part[:-1].split() or [""])[-1]
    return bool(regex.fullmatch(r"\p{L}", last)) or last.lower() in ABBREVIATIONS


def normal_word(word: str) -> str:
    return _WORD_EDGE.sub("", word.lower())


def overlap(a: set[str], b: set[str]) -> float:
    """Shared words by those of the smaller set; 0 if either is empty."""
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def furniture_ratio(words: list[str], site_wide: set[str]) -> float:
    return sum(w in site_wide for w in words) / len(words) if words else 0.0


def is_question(sentence: str) -> bool:
    return any(m in sentence for m in QUESTION_MARKS) or any(p in sentence.lower() for p in QUESTION_PHRASES)


def trim_to_words(text: str, n: int) -> str:
    words = text.split()
    return text if len(words) <= n else " ".join(words[:n]).rstrip(" ,;:") + "…"


def summarise(text: str, weights: dict[str, int], budget: int = 40, site_wide: frozenset[str] = frozenset()) -> str:
    """Up to four sentences of 8 to 45 words, by the weights of their words, within a budget of words, in reading order.

    Questions, captions, options after a stem and sentences of site-wide wording count for less; a
    sentence that opens like a chosen one, or shares most of its words with it, is passed over.
    """
    scored, stem = [], -9
    for k, sentence in enumerate(sentences(text)):
        words = [w for w in map(normal_word, sentence.split()) if w]
        is_stem = sentence.endswith(":") or any(p in sentence.lower() for p in ("the following", "given below"))
        if 8 <= len(words) <= 45:
            score = sum(weights.get(w, 0) for w in set(words)) / len(words) ** 0.5
            score *= 0.15 if is_question(sentence) else 0.3 if k - stem <= 3 else 1.0
            score *= 0.4 if ":" in sentence and len(sentence.split(":")[0].split()) <= 4 else 1.0
            score *= 0.2 if furniture_ratio(words, site_wide) >= 0.5 else 1.0
            scored.append((-score, k, sentence, words))
        if is_stem:
            stem = k
    chosen: list[tuple[int, str, list[str]]] = []
    used = 0
    for score, k, sentence, words in sorted(scored):
        if len(chosen) == 4 or score == 0:
            break
        if chosen and used + len(words) > budget:
            continue
        if any(words[:12] == other[:12] or overlap(set(words), set(other)) > 0.7 for _, _, other in chosen):
            continue
        chosen.append((k, sentence, words))
        used += len(words)
    return trim_to_words(" ".join(s for _, s, _ in sorted(chosen)), budget)


def insert_link(page: str, anchor: str, href: str) -> str:
    """The page with its first eligible, whole-word occurrence of the anchor linked; unchanged if there is none."""
    if not anchor:
        return page
    find = regex.compile(r"(?<![\p{L}\p{Nd}])" + regex.escape(anchor) + r"(?![\p{L}\p{Nd}])")
    at, closed = 0, 0
    for m in [*_TAG.finditer(page), None]:
        stop = m.start() if m else len(page)
        if not closed and (hit := find.search(page, at, stop)):
            return f'{page[: hit.start()]}<a href="{html.escape(href)}">{anchor}</a>{page[hit.end() :]}'
        if m:
            at = m.end()
            if m[2] and m[2].lower() in NO_LINKS:
                closed = max(0, closed + (-1 if m[1] else 1))
    return page


def visible(page: str) -> str:
    return " ".join(html.unescape(_TAG.sub("", page)).split())


def summaries(pages: DataFrame, postings: DataFrame, budget: int = 40, site_wide: frozenset[str] = frozenset()) -> DataFrame:
    """(post_id, summary); pages: post_id, parsed_text; postings: post_id, term, tf, or a row for each page with post_id, terms, tfs; site-wide terms don't count."""
    from pyspark.sql import functions as F

    lists = postings if "terms" in postings.columns else postings.groupBy("post_id").agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"))  # stored terms of a page are bounded

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            weights = ({t: n for t, n in zip(a, b, strict=True) if t not in site_wide} if a is not None else {} for a, b in zip(f["terms"], f["tfs"], strict=True))
            yield pd.DataFrame({"post_id": f["post_id"], "summary": [summarise(t or "", w, budget, site_wide) for t, w in zip(f["parsed_text"], weights, strict=True)]})

    ship(pages.sparkSession)
    return pages.join(lists, "post_id", "left").select("post_id", "parsed_text", "terms", "tfs").mapInPandas(run, "post_id long, summary string")


def sentence_rows(pages: DataFrame) -> DataFrame:
    """(post_id, place, sentence)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, k, s) for p, t in zip(f["post_id"], f["parsed_text"], strict=True) for k, s in enumerate(sentences(t))]
            yield pd.DataFrame(rows, columns=["post_id", "place", "sentence"])

    ship(pages.sparkSession)
    return pages.select("post_id", "parsed_text").mapInPandas(run, "post_id long, place int, sentence string")


def linked_pages(pages: DataFrame, anchor: str, href: str) -> DataFrame:
    """(page_id, html, placed) with the link set where it may be; the visible text stays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            new = [insert_link(h or "", anchor, href) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"], "html": new, "placed": [a != (b or "") and visible(a) == visible(b or "") for a, b in zip(new, f["html"], strict=True)]})

    ship(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(run, "page_id long, html string, placed boolean")


def stored_term(raw: str) -> str:
    """A word as it is kept: without quotes and hyphens at its ends, of 80 bytes at most; empty if it isn't kept."""
    term = raw.strip("'-")
    size = len(term.encode())
    return "" if size < 3 or term in _STOP else term if size <= 80 else term.encode()[:80].decode(errors="ignore")


_STOP = frozenset(STOPWORDS)


def term_lists(pages: DataFrame, most: int, own: int) -> DataFrame:
    """(post_id, lang_code, in_scope, terms, tfs, own): of each row that has any the `most` most frequent terms, ties in their order, and how many of them are among the first `own`.

    pages: post_id, lang_code, in_scope, parsed_text. Nothing is shuffled, so a page must be one row.
    """
    spark = pages.sparkSession
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # words of whole texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column(3)
            words = lists.flatten().dictionary_encode()
            kept = [stored_term(w) for w in words.dictionary.to_pylist()]
            names = sorted({*kept} - {""})
            number = {t: k for k, t in enumerate(names)} | {"": -1}
            code = np.array([number[t] for t in kept], np.int64)[words.indices.to_numpy()] if kept else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            pairs, tf = np.unique((row * (len(names) + 1) + code)[code >= 0], return_counts=True)
            row, code = np.divmod(pairs, len(names) + 1)
            order = np.lexsort((code, -tf, row))
            row, code, tf = row[order], code[order], tf[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < most
            row, code, tf = row[first], code[first], tf[first]
            at, sizes = np.unique(row, return_counts=True)
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            terms = pa.ListArray.from_arrays(ends, pa.array(names, pa.string()).take(pa.array(code)))
            columns = [*(rows.column(k).take(pa.array(at)) for k in range(3)), terms, pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64())), pa.array(np.minimum(sizes, own), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["post_id", "lang_code", "in_scope", "terms", "tfs", "own"])

    words = pages.selectExpr("post_id", "lang_code", "in_scope", r"""regexp_extract_all(lower(parsed_text), r"\p{L}[\p{L}\p{Nd}'-]{2,}", 0) AS words""")
    return words.mapInArrow(run, "post_id long, lang_code string, in_scope boolean, terms array<string>, tfs array<long>, own int")
