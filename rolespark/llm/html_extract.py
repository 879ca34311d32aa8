"""Main text of web pages by minimum cut.

A page becomes text blocks with the elements above them. A linear classifier gives each block the cost of calling it
content or boilerplate; these costs are the capacities to the two terminals. Neighbouring blocks and blocks of one
parent are joined by edges, weaker the further apart they are in the document tree. The minimum cut labels all blocks
of a page together."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+>"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]+|<""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

# fixed values: HTML element kinds
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("head title noscript template svg math iframe object audio video canvas select option textarea button datalist script style".split())
CHROME = frozenset("nav header footer aside form menu dialog fieldset".split())
CLOSED_BY_SELF = frozenset("p li dt dd tr td th option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_HINTS = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar "
    "footer foot sidebar aside rail widget related recommended share sharing social cookie cookies consent gdpr notice alert popup modal overlay newsletter "
    "subscribe subscription signup login search form comment comments reply replies respondent disqus pagination pager copyright legal skip hidden".split()
)
GOOD_HINTS = frozenset("article content main post entry story body text".split())
COMMENT_HINTS = frozenset("comment comments reply replies respondent disqus".split())
#: What may follow a hint in a compound name ("comment-list"), and what turns a name into one of something else ("has-sidebar").
HOLDERS = frozenset(
    "area bar block body bottom box button buttons card cards container content form group icons inner item items left links list menu outer panel posts region right "
    "section slot stories text thread top unit widget wrap wrapper".split()
)
TURNING = frozenset("has no not with without is".split())
#: A hint, or a tag of CHROME, says nothing if this share of the page's text stands below it, most of it not in links.
MOST_TEXT = 0.6
#: Hinted elements around one another that are told apart.
HINTS_KEPT = 8

#: Weights of the classifier; z > 0 speaks for content.
BIAS, ARTICLE, BAD_TAG, BAD_HINT, GOOD_HINT, LINKS, LENGTH, PARAGRAPH, HEADING, LISTED, COPYRIGHT = -0.4, 4.0, -9.0, -9.0, 1.5, -5.0, 0.9, 1.0, 0.5, -0.5, -2.0
NEAR, SIBLING = 1.0, 0.5


@dataclass
class Element:
    tag: str
    number: int
    depth: int
    silent: bool
    article: bool
    hint_good: bool
    chrome: tuple[int, ...]
    hints: tuple[int, ...]
    comment: bool
    up: Element | None


@dataclass
class Block:
    element: Element
    link: int = 0
    parts: list[str] = field(default_factory=list)
    text: str = ""
    z: float = 0.0
    plain: bool = False


def is_bad_hint(name: str) -> bool:
    """Whether a class, id or role names boilerplate: the name itself, the last part of a compound ("site-header"), or the
    first before a word for a container ("comment-list"). "has-sidebar" or "legal-opinion" name something else."""
    parts = [x for x in re.split(r"[_-]+", name) if x]
    if not parts or TURNING & set(parts):
        return False
    return parts[-1] in BAD_HINTS or parts[0] in BAD_HINTS and parts[-1] in HOLDERS


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, without blank ones."""
    root = Element("", 0, 0, False, False, False, (), (), False, None)
    stack, out, number, open_block, links = [root], [], 0, None, 0
    opened: Counter[str] = Counter()  # so that the stack is searched only for what is in it

    def pop(n: int) -> None:
        nonlocal open_block, links
        for e in stack[n:]:
            opened[e.tag] -= 1
            if e.tag == "a":
                links -= 1
            if e.tag not in INLINE:
                open_block = None
        del stack[n:]

    for m in TOKEN.finditer(page):
        token = m[0]
        tag = m[3] or m[6]
        if not tag:
            if token[0] == "<" and len(token) > 1 or stack[-1].silent:
                continue
            if open_block is None:
                holder = next(e for e in reversed(stack) if e.tag not in INLINE)
                open_block = Block(holder)
                out.append(open_block)
            text = html.unescape(token) if "&" in token else token
            open_block.parts.append(text)
            if links:
                open_block.link += len(text)
            continue
        tag, closing, rest = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if closing:
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0) if opened[tag] else 0
            if at:
                pop(at)
            elif tag not in INLINE:
                open_block = None
            continue
        if tag == "br":
            if open_block:
                open_block.parts.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                open_block = None
            continue
        if tag not in INLINE:
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p"), 0) if opened["p"] else 0
            if at and not any(e.tag in ("table", "button", "object") for e in stack[at:]):
                pop(at)
            if tag in CLOSED_BY_SELF and opened[tag]:
                at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag or stack[k].tag in ("ul", "ol", "dl", "table")), 0)
                if at and stack[at].tag == tag:
                    pop(at)
            open_block = None
        if rest.rstrip().endswith("/"):  # closes itself
            continue
        up, number = stack[-1], number + 1
        names: list[str] = []
        off = False
        if rest and tag not in ("html", "body"):
            for name, value in ATTRIBUTE.findall(rest):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id", "role"):
                    names += value.split()
                elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
                    off = True
        chrome = tag in CHROME and not (tag == "header" and up.article)
        words = {part for name in names for part in re.split(r"[_-]+", name)}
        hinted = any(is_bad_hint(name) and not (up.article and re.search(r"(^|[_-])header$", name)) for name in names)
        stack.append(
            Element(
                tag,
                number,
                up.depth + 1,
                up.silent or off or tag in SILENT,
                up.article or tag in ("article", "main"),
                up.hint_good or bool(words & GOOD_HINTS),
                (*up.chrome, number) if chrome and len(up.chrome) < HINTS_KEPT else up.chrome,
                (*up.hints, number) if hinted and len(up.hints) < HINTS_KEPT else up.hints,
                up.comment or hinted and bool(words & COMMENT_HINTS),
                up,
            )
        )
        opened[tag] += 1
        links += tag == "a"
    kept = []
    for b in out:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            kept.append(b)
    return kept


def trusted_hints(blocks: list[Block]) -> set[int]:
    """The hinted elements and those of CHROME that do not hold most of the page's text themselves: a form around the whole
    page, or a body whose class is "sidebar", says nothing."""
    below, links = Counter(), Counter()
    for b in blocks:
        for h in {*b.element.hints, *b.element.chrome}:
            below[h] += len(b.text)
            links[h] += min(b.link, len(b.text))
    most = MOST_TEXT * sum(len(b.text) for b in blocks)
    return {h for h, n in below.items() if n < most or 2 * links[h] > n}


def link_share(block: Block) -> float:
    return min(1.0, block.link / len(block.text))


def preference(block: Block, bad_tag: bool, hint_bad: bool) -> float:
    """Log odds that a block is content."""
    e = block.element
    z = BIAS + ARTICLE * e.article + BAD_TAG * bad_tag + BAD_HINT * hint_bad + GOOD_HINT * e.hint_good
    z += LENGTH * math.log1p(block.text.count(" ") / 10) + LINKS * link_share(block)
    z += PARAGRAPH * (e.tag == "p") + HEADING * (e.tag in HEADINGS) + LISTED * (e.tag in ("li", "td", "th"))
    return z + COPYRIGHT * ("©" in block.text)


def tree_distance(a: Element, b: Element) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def minimum_cut(content: list[float], boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the content side. content[i] is the cost of calling node i content, boilerplate[i] of the
    other; edges cost what they weigh when their ends differ. Max-flow by blocking flows on breadth-first levels."""
    n = len(content)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        room.append(forth)
        at[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        straight = min(content[i], boilerplate[i])  # flows from source to sink through i alone
        join(source, i, boilerplate[i] - straight, 0.0)
        join(i, sink, content[i] - straight, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                cut = next(k for k, e in enumerate(path) if room[e] - least <= tiny)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                del path[cut:]
                a = to[path[-1]] if path else source
                continue
            while following[a] < len(at[a]):
                e = at[a][following[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                following[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                following[a] += 1
                continue
            path.append(e)
            a = to[e]


def extract(page: str | None) -> str:
    """The main text of one page: its content blocks in page order, joined by a line feed; empty if there are none. Where
    the cut calls nothing content, blocks without any sign of boilerplate are the text."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    groups: list[list[Block]] = []
    trusted = trusted_hints(blocks)
    for b in blocks:
        marked = not trusted.isdisjoint(b.element.chrome), b.element.comment or not trusted.isdisjoint(b.element.hints)
        b.z = preference(b, *marked)
        b.plain = not any(marked) and 2 * link_share(b) < 1 and "©" not in b.text
        last = groups[-1][-1] if groups else None
        # blocks of one parent that agree in their preference are one node
        if last and (last.z > 0) == (b.z > 0) and last.element.up is b.element.up:
            groups[-1].append(b)
        else:
            groups.append([b])
    edges, latest = [], {}
    # text and links side by side need not be of one kind
    alike = lambda a, b: 1 - abs(link_share(groups[a][-1]) - link_share(groups[b][0]))
    for k, g in enumerate(groups):
        first = g[0].element
        if k:
            edges.append((k - 1, k, alike(k - 1, k) * NEAR / (1 + tree_distance(groups[k - 1][-1].element, first))))
        if (before := latest.get(first.up.number if first.up else -1)) is not None:
            edges.append((before, k, alike(before, k) * SIBLING))
        latest[first.up.number if first.up else -1] = k
    softplus = lambda z: max(z, 0.0) + math.log1p(math.exp(-abs(z)))
    label = minimum_cut([sum(softplus(-b.z) for b in g) for g in groups], [sum(softplus(b.z) for b in g) for g in groups], edges)
    if any(label):
        return "\n".join(b.text for g, yes in zip(groups, label, strict=True) if yes for b in g)
    return "\n".join(b.text for b in blocks if b.plain)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html). A null, empty or textless page has an
    empty text; null ids and urls stay null; repeated rows are pages of their own; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
