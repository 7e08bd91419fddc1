"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. Each block gets a cost for being content and a cost for
being boilerplate (terminal capacities), neighbouring blocks and blocks with a common
parent are tied by smoothness edges, and the minimum cut of that graph labels the blocks.
A page is small, so its graph is solved in the task that reads the page.

Defined cases: null, empty and text-only pages are parsed like any other (no blocks, no
text); unclosed and stray tags never fail; frames, drawings and the like are skipped from tag
to closing tag, and where they are self-closed or unclosed only the tag is; very long pages are read in one pass; repeated
rows are extracted alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.batches import map_rows

#: Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
SKIPPED = frozenset("noscript template iframe svg math object canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr img picture source".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Evidence of an element, as cost of calling its text content (positive) or boilerplate (negative).
TAG_COST = {
    "nav": 9.0, "footer": 9.0, "aside": 9.0, "form": 9.0, "header": 5.0, "menu": 9.0, "dialog": 9.0, "button": 9.0,
    "select": 9.0, "head": 20.0, "article": -4.0, "main": -3.0, "p": -1.0, "pre": -1.0, "blockquote": -1.0,
}
#: Words in class, id or role that mark boilerplate, comments and content.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs promo promoted sponsor sponsored "
    "cookie cookies consent gdpr notice notification alert popup modal overlay nav navbar navigation menu submenu "
    "sidebar side widget related recommended recommendations footer foot header masthead topbar toolbar social share "
    "sharing follow subscribe subscription newsletter signup login search form pagination pager copyright legal "
    "disclaimer skip outbrain taboola contentinfo complementary".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion reactions reviews".split())
CONTENT_WORDS = frozenset("article content main post entry story body articlebody text prose".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")
_NAME = re.compile(r"[a-z]+")

#: Weights of the smoothness edges: blocks in a row, and blocks of one parent.
ADJACENT, SAME_PARENT = 0.4, 1.2
#: Text without any evidence leans to content; short blocks outside the article lean less.
LEANING, LONG_BLOCK = 0.75, 12


def _name_cost(name: str) -> float:
    words = set(_NAME.findall(name))
    if words & {"has", "with", "no", "without"}:
        return 0.0
    if words & COMMENT_WORDS:
        return 12.0
    return 9.0 if words & BOILERPLATE_WORDS else -3.0 if words & CONTENT_WORDS else 0.0


def _hidden(attributes: str) -> bool:
    """By attributes of these names; the words in other attributes, such as a class, say nothing."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if name == "hidden" and value != "false" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and _NOT_SHOWN.search(value):
            return True
    return False


class Element:
    __slots__ = ("tag", "parent", "cost", "inside")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.cost = TAG_COST.get(tag, 0.0)
        self.inside = parent.inside if parent else False
        if attributes and tag not in ("html", "body"):
            marks = [m[2] or m[3] or m[4] or "" for m in _MARK.finditer(attributes)]
            self.cost += max((_name_cost(name) for mark in marks for name in mark.lower().split()), key=abs, default=0.0)
            if _hidden(attributes):
                self.cost += 12.0
        if tag == "header" and self.inside:
            self.cost -= TAG_COST["header"]
        if tag in ("article", "main"):
            self.inside = True


class Block:
    __slots__ = ("text", "element", "words", "linked")

    def __init__(self, text: str, element: Element, words: int, linked: float):
        self.text, self.element, self.words, self.linked = text, element, words, linked


def _closing(page: str, tag: str) -> dict[int, int]:
    """Where each element of the tag that is closed starts and ends; self-closed ones are left out."""
    ends, opened = {}, []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", page, re.I):
        if not m[1]:
            if not m[2].endswith("/"):
                opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, white space turned into single spaces."""
    root = Element("html", "", None)
    stack, found = [root], []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            holder = next((e for e in reversed(stack) if e.tag not in INLINE), root)
            found.append(Block(text, holder, text.count(" ") + 1, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    at, raw_until = 0, 0
    closed: dict[str, dict[int, int]] = {}
    for token in _TOKEN.finditer(page):
        if token.start() < raw_until:
            continue
        if token.start() > at:
            piece = page[at : token.start()]
            parts.append(piece)
            linked += len(piece) if links else 0
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if tag == "br":
            parts.append(" ")
            continue
        if token[1]:
            if tag not in INLINE:
                flush()
            held = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if held and (tag not in INLINE or all(e.tag in INLINE for e in stack[held:])):
                links -= sum(e.tag == "a" for e in stack[held:])
                del stack[held:]
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = raw_until = end.end() if end else len(page)
            continue
        if tag in SKIPPED:
            if token[3].endswith("/"):
                continue
            if tag not in closed:
                closed[tag] = _closing(page, tag)
            at = raw_until = closed[tag].get(token.start(), at)
            continue
        if tag not in INLINE:
            flush()
            closes = {"p"} if tag in CLOSES_PARAGRAPH else CLOSES_ITSELF.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    links -= sum(e.tag == "a" for e in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE and stack[i].tag not in ("p", "td", "th"):
                    break
        if tag not in VOID and not token[3].endswith("/"):
            if tag not in INLINE or tag == "a" or token[3]:
                stack.append(Element(tag, token[3], stack[-1]))
                links += tag == "a"
    if at < len(page):
        parts.append(page[at:])
        linked += len(page) - at if links else 0
    flush()
    return found


def block_cost(block: Block) -> float:
    """Positive: costs that much to call the block content; negative: to call it boilerplate."""
    path = 0.0
    element = block.element
    while element is not None:
        path += element.cost
        element = element.parent
    length = min(block.words, 60) / 60
    cost = path + 4.0 * block.linked - 1.5 * length - LEANING
    if block.words < LONG_BLOCK and block.element.tag not in HEADINGS and not block.element.inside:
        cost += 0.5
    if block.element.tag in HEADINGS:
        cost -= 1.0
    return cost


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node, whether it is on the source side (content) of a minimum cut.

    A node's cost is its capacity to the sink if positive, from the source if negative.
    Flow is pushed along shortest paths from nodes with supply to nodes with demand; what
    can still be reached from remaining supply is the source side.
    """
    left = [-c for c in costs]
    residual: list[dict[int, float]] = [{} for _ in costs]
    for a, b, weight in edges:
        residual[a][b] = residual[a].get(b, 0.0) + weight
        residual[b][a] = residual[b].get(a, 0.0) + weight
    tiny = 1e-9

    def reach() -> tuple[list[int], int]:
        came = [-2] * len(costs)
        queue = deque(i for i, x in enumerate(left) if x > tiny)
        for i in queue:
            came[i] = -1
        while queue:
            node = queue.popleft()
            for other, capacity in residual[node].items():
                if capacity > tiny and came[other] == -2:
                    came[other] = node
                    if left[other] < -tiny:
                        return came, other
                    queue.append(other)
        return came, -1

    while True:
        came, end = reach()
        if end < 0:
            return [c != -2 for c in came]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        pushed = min(left[path[-1]], -left[end], *(residual[b][a] for a, b in zip(path, path[1:], strict=False)))
        left[path[-1]] -= pushed
        left[end] += pushed
        for a, b in zip(path, path[1:], strict=False):
            residual[b][a] -= pushed
            residual[a][b] = residual[a].get(b, 0.0) + pushed


def main_text(page: str) -> str:
    """The blocks on the content side, joined by one space."""
    found = blocks(page)
    if not found:
        return ""
    edges, last = [], {}
    for i, block in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT))
        parent = id(block.element if block.element.tag not in ("p", "li", *HEADINGS) else block.element.parent)
        if parent in last:
            edges.append((last[parent], i, SAME_PARENT))
        last[parent] = i
    kept = minimum_cut([block_cost(b) for b in found], edges)
    return " ".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def setup():
        def of_row(row):
            text = main_text(row["html"] or "")
            return row["page_id"], row["url"], text, len(text)

        return of_row

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return map_rows(rows, setup, schema, "page_id long, url string, text string, n_chars long")
