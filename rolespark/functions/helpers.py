"""The few rules that columns cannot express, as small vectorized functions over Arrow batches."""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

BREAKS = frozenset("p div li br h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


# text, plain end tags, plain start tags (not of elements whose content is no markup), doctypes, comments
_TOKEN = re.compile(
    r"""([^<]+)|</([a-z][a-z0-9]*)>|<(?!(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)[\s>])([a-z][a-z0-9]*)((?:[ \t\n]+[a-z][\w:.-]*="[^"]*")*)[ \t\n]*>"""
    r"|<!doctype [^<>]*>|<!--(?=[^>-])[^-]*(?:-[^-]+)*-->",
    re.I | re.A,
)
_ATTRIBUTE = re.compile(r'([\w:.-]+)="([^"]*)"', re.A)


class _Parser(HTMLParser):
    """The library's parser for whole pages, with a short way up to the first markup that is not plain."""

    def feed(self, page):
        at, size, token = 0, len(page), _TOKEN.match
        text, start, end = self.handle_data, self.handle_starttag, self.handle_endtag
        while at < size and (found := token(page, at)):
            data, closed, opened, attributes = found.groups()
            if data:
                text(html.unescape(data) if "&" in data else data)
            elif closed:
                end(closed.lower())
            elif opened:
                start(opened.lower(), [(k.lower(), html.unescape(v)) for k, v in _ATTRIBUTE.findall(attributes)] if attributes else [])
            at = found.end()
        if at < size:
            super().feed(page[at:])

    def updatepos(self, i, j):
        """Nobody asks for line numbers."""
        return j


class _Text(_Parser):
    """Text of a fragment: a line feed after block elements; scripts, styles and comments left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self._hidden = 0

    def handle_starttag(self, tag, attrs):
        self._hidden += tag in ("script", "style")
        if tag == "br":
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self._hidden = max(0, self._hidden - 1)
        elif tag in BREAKS and tag != "br":
            self.parts.append("\n")

    def handle_data(self, data):
        if not self._hidden:
            self.parts.append(data)


def text_of(fragment: str | None) -> str:
    if not fragment:
        return ""
    if "<" in fragment or "&" in fragment:
        parser = _Text()
        parser.feed(fragment)
        parser.close()
        fragment = "".join(parser.parts)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", fragment)).strip()


@F.pandas_udf(T.StringType())
def html_to_text(fragments: pd.Series) -> pd.Series:
    return fragments.map(text_of)


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if t else t)


_HREF = re.compile('href="([^"]+)"')


@F.arrow_udf(T.ArrayType(T.StringType()))
def hrefs(pages: pa.Array) -> pa.Array:
    """Targets in double quotes, in order, of whole pages whose references are resolved first. One page at a time becomes a
    Python text, and none comes back."""
    return pa.array([None if page is None else _HREF.findall(html.unescape(page)) for page in (p.as_py() for p in pages)], pa.list_(pa.string()))


# fixed values: number words, and the wording of years that a posting asks for
NUMBERS = "one two three four five six seven eight nine ten eleven twelve".split()
_N = rf"(\d{{1,2}}|{'|'.join(NUMBERS)})"
YEARS_PATTERNS = (
    re.compile(
        _N + r"\s*(?:\(\d{1,2}\)\s*)?(?:\+|plus)?\s*(?:(?:-|–|to)\s*" + _N + r"\s*\+?\s*)?(?:or more\s+)?years?\b"
        r"(?:[^.\n]{0,60}?\bexperience|\s+(?:building|developing|working|using|deploying|shipping|designing|in|as)\b)",
        re.I,
    ),
    re.compile(r"(?:minimum|at least|min\.?)\s+(?:of\s+)?" + _N + r"\s*\+?\s*years?\b", re.I),
)
OPTIONAL = re.compile(r"\bprefer(?:red|ably)?\b|nice to have|\bbonus\b|\ba plus\b", re.I)
_BOUNDARY = re.compile(r"\n|\. ")


def years_of(text: str | None) -> int | None:
    """Least number of years, 1 to 30, that a sentence not marked as optional asks for."""
    if not text:
        return None
    cuts = [m.start() for m in _BOUNDARY.finditer(text)]
    found = []
    for pattern in YEARS_PATTERNS:
        for hit in pattern.finditer(text):
            before, after = bisect_left(cuts, hit.start()), bisect_left(cuts, hit.end())
            first = cuts[before - 1] + 1 if before else 0
            last = cuts[after] if after < len(cuts) else len(text)
            word = hit[1].lower()
            years = int(word) if word.isdigit() else NUMBERS.index(word) + 1
            if 1 <= years <= 30 and not OPTIONAL.search(text, first, last):
                found.append(years)
    return min(found, default=None)


@F.pandas_udf(T.IntegerType())
def min_years_required(texts: pd.Series) -> pd.Series:
    return texts.map(years_of).astype("Int32")


def sorted_ratio(a: str, b: str) -> float:
    """Token-sorted Indel similarity: 100 * 2 * LCS / (|a| + |b|), the LCS by bit-parallel steps."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not a or not b:
        return 100.0 if a == b else 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        hit = rows & places.get(c, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return 200.0 * (len(a) - rows.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else sorted_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def rarest_pieces(often: pd.Series, n: pd.Series, pieces: pd.Series, length: pd.Series) -> pd.Series:
    """Of each text of n characters so many disjoint pieces (pos, q) of about this length that their occurrences add up to the
    least. often: occurrences of its substrings, by length (length - 1, if any, to length + 1) and place."""

    def choose(counts: np.ndarray, size: int, wanted: int, middle: int) -> list[list[dict]]:
        """For texts of one length, a row of counts each."""
        tables, at = {}, 0
        for q in range(max(1, middle - 1), min(middle + 1, size) + 1):
            tables[q] = counts[:, at : at + size - q + 1]
            at += size - q + 1
        cost = np.full((size + 1, len(counts), wanted + 1), np.inf)  # of so many pieces in a prefix
        cost[:, :, 0] = 0
        last = np.zeros((size + 1, len(counts), wanted + 1), dtype=np.int32)
        for end in range(1, size + 1):
            cost[end] = cost[end - 1]
            for q, table in tables.items():
                if end >= q:
                    with_it = cost[end - q, :, :-1] + table[:, end - q, None]
                    less = with_it < cost[end, :, 1:]
                    cost[end, :, 1:][less], last[end, :, 1:][less] = with_it[less], q
        out = []
        for row in range(len(counts)):
            found, end, left = [], size, wanted
            while left:
                if q := int(last[end, row, left]):
                    end, left = end - q, left - 1
                    found.append({"pos": end, "q": q})
                else:
                    end -= 1
            out.append(found)
        return out

    rows: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(n, pieces, length, strict=True)):
        rows.setdefault(key, []).append(k)
    result: list = [None] * len(n)
    for key, members in rows.items():
        for at in range(0, len(members), 256):
            some = members[at : at + 256]
            for k, found in zip(some, choose(np.stack([np.asarray(often.iloc[k], dtype=np.float64) for k in some]), *map(int, key)), strict=True):
                result[k] = found
    return pd.Series(result)


class _Tree(_Parser):
    """A light element tree: (tag, attributes, children), strings as leaves."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ("", {}, [], None)
        self._at = self.root

    def handle_starttag(self, tag, attrs):
        node = (tag, dict(attrs), [], self._at)
        self._at[2].append(node)
        if tag not in VOID:
            self._at = node

    def handle_startendtag(self, tag, attrs):
        self._at[2].append((tag, dict(attrs), [], self._at))

    def handle_endtag(self, tag):
        node = self._at
        while node[3] is not None and node[0] != tag:
            node = node[3]
        if node[3] is not None:
            self._at = node[3]

    def handle_data(self, data):
        self._at[2].append(data)


def tree(page: str | None):
    parser = _Tree()
    parser.feed(page or "")
    parser.close()
    return parser.root


def walk(node):
    """Elements below a node in page order."""
    below = [iter(node[2])]
    while below:
        child = next(below[-1], None)
        if child is None:
            below.pop()
        elif not isinstance(child, str):
            yield child
            if child[2]:
                below.append(iter(child[2]))


def inner_text(node) -> str:
    """Trimmed text pieces joined by blanks."""
    pieces, below = [], [iter(node[2])]
    while below:
        child = next(below[-1], None)
        if child is None:
            below.pop()
        elif isinstance(child, str):
            pieces.append(child.strip())
        elif child[0] not in ("script", "style"):
            below.append(iter(child[2]))
    return " ".join(p for p in pieces if p)


def markup(node) -> str:
    """The element as HTML again."""
    parts, left = [], [node]
    while left:
        n = left.pop()
        if isinstance(n, str):
            parts.append(n)
            continue
        attributes = "".join(f' {k}="{html.escape(v or "")}"' for k, v in n[1].items())
        parts.append(f"<{n[0]}{attributes}>")
        if n[0] not in VOID:
            left.append(f"</{n[0]}>")
            left.extend(html.escape(c, quote=False) if isinstance(c, str) else c for c in reversed(n[2]))
    return "".join(parts)


def classes(node) -> list[str]:
    names = node[1].get("class")
    return names.split() if names else []


def up(node, test):
    node = node[3]
    while node is not None and not (node[0] and test(node)):
        node = node[3]
    return node


# comments, and start tags of elements whose content is no markup
_RAW = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|title|textarea)(?=[\s/>])((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.I | re.S)
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I) for tag in ("script", "style", "title", "textarea")}


@lru_cache(1024)
def _holds_json(attributes: str) -> bool:
    first = next(walk(tree(f"<script{attributes}>")), None)
    return first is not None and not attributes.endswith("/") and first[1].get("type") == "application/ld+json"


def ld_scripts(page: str) -> Iterator[str]:
    """Texts of the JSON-LD scripts in page order. Other markup is passed over, not parsed."""
    at = 0
    while start := _RAW.search(page, at):
        at = start.end()
        if start[1] and not start[2].endswith("/"):
            at = _CLOSE[start[1].lower()].search(page, start.end()).start()
            if start[1].lower() == "script" and _holds_json(start[2]):
                yield page[start.end() : at]


def job_posting(page: str | None) -> str | None:
    """The first schema.org JobPosting among the page's JSON-LD scripts, as JSON."""
    for text in ld_scripts(page or ""):
        try:
            data = json.loads(text)
        except ValueError:
            continue
        listed = data if isinstance(data, list) else data.get("@graph", [data]) if isinstance(data, dict) else []
        for item in listed:
            if isinstance(item, dict) and item.get("@type") == "JobPosting":
                return json.dumps(item)
    return None


@F.pandas_udf(T.StringType())
def jsonld_job(pages: pd.Series) -> pd.Series:
    return pages.map(job_posting)


# else a filter on what is found would run the function a second time
jsonld_job = jsonld_job.asNondeterministic()
