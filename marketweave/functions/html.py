"""Article texts and tables of HTML pages, and entries of feeds: helpers for Arrow batches."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterable
from html.parser import HTMLParser
from itertools import accumulate
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

# Elements whose text is a block, elements whose text is none, least characters of a block and of an article's own blocks, and of a text in all.
BLOCKS = {"h1", "h2", "h3", "p", "li", "blockquote"}
SKIPPED = {"script", "style", "noscript", "svg", "nav", "header", "footer", "form"}
LEAST_BLOCK, LEAST_ARTICLE, MOST_CHARS = 20, 120, 40_000
# Meta elements that describe a page.
DESCRIPTIONS = {"description", "og:description", "twitter:description"}


class _Events(HTMLParser):
    """A page as a flat list of (kind, name or text, attributes)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple[str, str, dict]] = []

    def handle_starttag(self, tag, attrs):
        self.seen.append(("open", tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.seen.append(("close", tag, {}))

    def handle_data(self, data):
        self.seen.append(("text", data, {}))


def events(html: str) -> list[tuple[str, str, dict]]:
    reader = _Events()
    reader.feed(html or "")
    reader.close()
    return reader.seen


def _depth(page: list[tuple[str, str, dict]], names: set[str]) -> list[int]:
    """How many elements of these names are open after each event; a close too many counts for nothing."""
    steps = ((kind == "open") - (kind == "close") if name in names else 0 for kind, name, _ in page)
    return list(accumulate(steps, lambda depth, step: max(0, depth + step), initial=0))[1:]


def _flat(parts: Iterable[str], between: str = " ") -> str:
    return " ".join(between.join(parts).split())


def blocks(page: list[tuple[str, str, dict]]) -> list[tuple[bool, str]]:
    """The texts of block elements, each with whether it begins inside of an article or main element.

    A block goes from its opening to the next closing of that name; blocks inside of it are part of it.
    """
    skipped, inside = _depth(page, SKIPPED), _depth(page, {"article", "main"})
    closings: dict[str, list[int]] = {}
    for at, (kind, name, _) in enumerate(page):
        if kind == "close":
            closings.setdefault(name, []).append(at)
    out, free = [], 0
    for at, (kind, name, _) in enumerate(page):
        if at < free or kind != "open" or name not in BLOCKS or skipped[at]:
            continue
        ends = closings.get(name, [])
        k = bisect_left(ends, at)
        # one that is never closed has no text, and none begins after it
        free = ends[k] + 1 if k < len(ends) else len(page)
        if k < len(ends):
            out.append((inside[at] > 0, _flat(x for (what, x, _), skip in zip(page[at:free], skipped[at:free], strict=True) if what == "text" and not skip)))
    return [(own, text) for own, text in out if len(text) >= LEAST_BLOCK]


def article(html: str) -> str:
    """The blocks inside article or main if they have 120 characters, else the others, else descriptions; each once."""
    page = events(html)
    found = blocks(page)
    chunks = [t for own, t in found if own]
    if len(" ".join(chunks)) < LEAST_ARTICLE:
        chunks = [t for own, t in found if not own]
    if not chunks:
        chunks = [_flat([x.get("content") or ""]) for kind, name, x in page if (kind, name) == ("open", "meta") and (x.get("name") or x.get("property") or "").lower() in DESCRIPTIONS]
    once: dict[str, str] = {}
    for text in filter(None, chunks):
        once.setdefault(text.casefold(), text)
    return "\n\n".join(once.values())[:MOST_CHARS]


def cells(html: str) -> list[list[list[str]]]:
    """Tables as rows of cell texts; a cell goes on to the next closing td or th."""
    found: list[list[list[str]]] = []
    cell: list[str] | None = None
    for kind, name, _ in events(html):
        if kind == "text":
            if cell is not None:
                cell.append(name)
        elif kind == "open" and name == "table":
            found.append([])
        elif kind == "open" and name == "tr" and found:
            found[-1].append([])
        elif name in ("td", "th") and found and found[-1]:
            if kind == "close" and cell is not None:
                found[-1][-1].append(_flat(cell, ""))
            cell = [] if kind == "open" else None
    return found


@F.pandas_udf(StringType())
def article_text(html: pd.Series) -> pd.Series:
    return html.map(article)


@F.pandas_udf(ArrayType(ArrayType(ArrayType(StringType()))))
def tables(html: pd.Series) -> pd.Series:
    """Tables as rows of cell texts."""
    return html.map(cells)


def plain(html: str) -> str:
    """All text of a fragment, white space runs as one space."""
    return _flat((text for kind, text, _ in events(html) if kind == "text"), "")


@F.pandas_udf(StringType())
def plain_text(html: pd.Series) -> pd.Series:
    return html.map(plain)


class _Cards(HTMLParser):
    """List entries (li, or role listitem): the first link and the texts of their elements with class or tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, list | None]] = []
        self.cards: list[dict] = []

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        starts = tag == "li" or named.get("role") == "listitem"
        if starts:
            self.cards.append({"href": "", "parts": []})
        inside = starts or any(s for _, s, _ in self.stack)
        part = None
        if inside and not starts and tag in ("p", "span", "h1", "h2", "h3", "h4", "time"):
            part = [named.get("class") or tag, ""]
            self.cards[-1]["parts"].append(part)
        if inside and tag == "a" and not self.cards[-1]["href"]:
            self.cards[-1]["href"] = named.get("href") or ""
        if tag not in ("br", "img", "input", "meta", "link", "hr"):
            self.stack.append((tag, starts, part))

    def handle_endtag(self, tag):
        while self.stack and any(t == tag for t, _, _ in self.stack):
            if self.stack.pop()[0] == tag:
                break

    def handle_data(self, data):
        part = next((p for _, _, p in reversed(self.stack) if p is not None), None)
        if part is not None:
            part[1] += data


def list_cards(html: str) -> list[dict]:
    reader = _Cards()
    reader.feed(html or "")
    reader.close()
    return [{"href": c["href"], "parts": [{"kind": k, "text": " ".join(t.split())} for k, t in c["parts"]]} for c in reader.cards]


CARD = StructType([StructField("href", StringType()), StructField("parts", ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType())])))])


@F.pandas_udf(ArrayType(CARD))
def cards(html: pd.Series) -> pd.Series:
    return html.map(list_cards)


_BARE = re.compile(r"&(?!#\d+;|#x[0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]+;)")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def entries(xml: str) -> list[dict[str, str]]:
    """RSS items or Atom entries as maps: repeated elements become a JSON list; an entry without title or link is dropped.

    Bare ampersands and control characters are mended once.
    """
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        try:
            root = ElementTree.fromstring(_CONTROL.sub("", _BARE.sub("&amp;", xml)))
        except ElementTree.ParseError:
            return []
    out = []
    for node in root.iter():
        if _name(node.tag) not in ("item", "entry"):
            continue
        values: dict[str, list[str]] = {}
        for child in node:
            text = "".join(child.itertext()).strip()
            if _name(child.tag) == "link" and not text and child.attrib.get("rel", "alternate") == "alternate":
                text = child.attrib.get("href", "")
            if _name(child.tag) == "category":
                text = child.attrib.get("term") or text
            values.setdefault(_name(child.tag), []).append(text)
        if values.get("title", [""])[0] and values.get("link", [""])[0]:
            out.append({k: v[0] if len(v) == 1 else json.dumps(v, ensure_ascii=False) for k, v in values.items()})
    return out


@F.pandas_udf(ArrayType(MapType(StringType(), StringType())))
def feed_entries(xml: pd.Series) -> pd.Series:
    return xml.map(lambda x: entries(x) if x else [])
