"""Text of pages that are kept as trees of blocks or widgets, and links set in those that may be written to."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from weftline.functions import text
from weftline.session import ship

_SHORTCODE = re.compile(r"\[/?[^\]]+\]")
_BLOCK = re.compile(r"<!-- (/?)wp:([a-z][a-z0-9/-]*)(?: (\{.*?\}))? (/?)-->", re.S)
# Settings of widgets that hold text.
WIDGET_TEXTS = ("editor", "title", "description", "text", "html", "content")
#: Blocks of text that a link may be set in.
LEAVES = frozenset(("paragraph", "list-item", "quote", "heading", "verse", "table"))


def shortcode_html(content: str) -> str:
    return _SHORTCODE.sub(" ", content)


def block_html(content: str) -> str:
    """Inner HTML of all blocks, without their comments."""
    return _BLOCK.sub("", content)


def _texts(node) -> Iterator[str]:
    if isinstance(node, list):
        for x in node:
            yield from _texts(x)
    elif isinstance(node, dict):
        for name, value in (node.get("settings") or {}).items() if isinstance(node.get("settings"), dict) else ():
            if name in WIDGET_TEXTS and isinstance(value, str):
                yield value
        yield from _texts(node.get("elements") or node.get("nodes") or [])


def tree_html(data: str | None) -> str:
    """Texts of a tree of widgets as JSON, in order; what is no JSON has none."""
    try:
        return "\n".join(_texts(json.loads(data or "[]")))
    except ValueError:
        return ""


def page_html(system: str, content: str | None, tree: str | None = None) -> str:
    if system in ("elementor", "beaver"):
        return tree_html(tree)
    return block_html(content or "") if system == "gutenberg" else shortcode_html(content or "") if system in ("divi", "wpbakery") else content or ""


def _leaves(content: str) -> Iterator[tuple[int, int]]:
    """Where the inner HTML of leaf blocks begins and ends."""
    open_: list[tuple[str, int, bool]] = []
    for m in _BLOCK.finditer(content):
        if m[4]:
            continue
        if not m[1]:
            if open_:
                open_[-1] = (*open_[-1][:2], True)
            open_.append((m[2], m.end(), False))
        elif open_ and open_[-1][0] == m[2]:
            name, start, inner = open_.pop()
            if name in LEAVES and not inner:
                yield start, m.start()


def place(system: str, content: str, anchor: str, href: str) -> tuple[str, str]:
    """The content with the link set, and "ok" or why not; visible text never changes."""
    if not anchor:
        return content, "empty_anchor"
    if system == "classic":
        new = text.insert_link(content, anchor, href)
    elif system == "gutenberg":
        new = content
        for a, b in _leaves(content):
            if (part := text.insert_link(content[a:b], anchor, href)) != content[a:b]:
                new = content[:a] + part + content[b:]
                break
    else:
        return content, "suggest_only"
    if new == content:
        return content, "anchor_not_found"
    return (new, "ok") if text.visible(new) == text.visible(content) else (content, "integrity_check_failed")


def can_place(system: str, content: str, anchor: str) -> bool:
    """Whether a proposal is worth keeping: pages that are not written to take any."""
    return system not in ("classic", "gutenberg") or place(system, content, anchor, "/")[1] == "ok"


def unwrap(page: str, mark: str) -> str | None:
    """The page without the one link that carries the mark; null unless there is exactly one."""
    find = re.compile(rf'<a\b[^>]*\bdata-link="{re.escape(mark)}"[^>]*>(.*?)</a>', re.S)
    return find.sub(lambda m: m[1], page) if len(find.findall(page)) == 1 else None


def placements(pages: DataFrame) -> DataFrame:
    """pages: id, system, content, anchor, href; the result has id, content and reason, a row for each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [place(s, c or "", a or "", h or "") for s, c, a, h in zip(f["system"], f["content"], f["anchor"], f["href"], strict=True)]
            yield pd.DataFrame({"id": f["id"], "content": [c for c, _ in found], "reason": [r for _, r in found]})

    ship(pages.sparkSession)
    return pages.select("id", "system", "content", "anchor", "href").mapInPandas(run, "id long, content string, reason string")
