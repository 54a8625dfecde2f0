"""Main text of web pages by minimum cuts.

A page is read into blocks of text. A linear classifier over a block's markup and text gives each block a cost of being
content and a cost of being boilerplate; these are the capacities to the two terminals. Neighbours in page order, and
neighbours that share a container, are joined by smoothness edges, which are stronger the closer they lie in the tree.
The minimum cut is the cheapest labelling, found by augmenting paths; blocks whose own cost outweighs all their edges
are settled before, which leaves little or nothing to search on most pages.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brightwell.llm.batches import map_batches, pieces

#: Fixed values of HTML: elements that are no part of a line of text, whose content is no text, and that hold no content.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol option optgroup p
pre search section select summary table tbody td template textarea tfoot th thead title tr ul button iframe noscript
object video audio canvas""".split())
RAW = "script|style|noscript|template|svg|iframe|textarea|select|title|noframes|noembed|xmp"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key closes an open one of the values, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol menu dir dl table tbody thead tfoot select div section article aside nav header footer form main body".split())
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<svg(?=[\s/>])[^>]*/>|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    rf"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S | re.I)
HINTS = re.compile(r"\b(class|id|role|aria-label|itemprop|data-component)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Weights of the classifier; positive speaks for content. Elements and words of class, id and role count for all
#: blocks below them.
ELEMENTS = {"article": 4.0, "main": 3.0, "nav": -12.0, "header": -3.0, "footer": -12.0, "aside": -12.0, "form": -12.0,
            "button": -12.0, "menu": -8.0, "dialog": -12.0, "head": -20.0, "fieldset": -6.0, "h1": 1.5, "p": 1.0,
            "blockquote": 0.5, "pre": 0.5, "figcaption": 0.3, "search": -12.0, "label": -4.0, "option": -8.0}
HINT_WORDS = {
    **dict.fromkeys("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie
cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login menu nav
navbar navigation breadcrumb breadcrumbs sidebar widget toolbar footer masthead comment comments disqus respond reply
replies reviews share sharing social related recommended recommendations pagination pager copyright legal disclaimer
toc contentinfo complementary search skip hidden""".split(), -12.0),
    **dict.fromkeys("article content main post entry story body text articlebody".split(), 2.0), "header": -3.0}
#: Elements that hold the page or its text, whatever their names say of the layout; words that make a name say whether
#: something is there, and what a negative word then counts.
OUTER = frozenset(("html", "body", "main", "article"))
MODIFIERS = frozenset("has have with without no not hide show is enable enabled disable disabled supports".split())
MODIFIED = -0.25
#: Elements that hold text rather than parts of a page. In an article a negative word that is only a part of their name, or
#: of any element's id, which is often made from a title, is mostly a word of the text and counts this much.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption code".split())
IN_TEXT = -1.0
PER_CHARACTER, MOST_BY_LENGTH, BASE, LINK_SHARE, HIDDEN_WEIGHT = 0.01, 1.5, 0.3, -3.0, -20.0
#: Smoothness of neighbours in page order by the distance to their common container, and of those within a container.
ADJACENT, SAME_CONTAINER = 1.0, 2.0
UNITS = 1000


@dataclass
class Node:
    tag: str
    parent: int
    weight: float
    depth: int
    inside: bool = False


@dataclass
class Block:
    container: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def hint_weight(attributes: str, name: str = "div", inside: bool = False) -> float:
    """The weight of the words of class, id and role; the strongest negative and the strongest positive count once.

    A name of which a negative word is only a part, beside words that say that something is there or not, as has-sidebar
    or no-sidebar, describes the layout and counts ``MODIFIED`` at most; ``inside`` an article such parts count ``IN_TEXT``
    at most on elements of text and in ids. Names of an outer element speak for it only.
    """
    low = high = 0.0
    for kind, found in HINTS.findall(attributes):
        for label in found.strip("\"'").split():
            words = [w.lower() for w in WORD.findall(label)]
            values = [HINT_WORDS[w] for w in words if w in HINT_WORDS]
            partial = len(values) < len(words) and min(values, default=0.0) < 0
            least = -math.inf
            if not MODIFIERS.isdisjoint(words):
                least = MODIFIED
            elif partial and inside and (name in TEXTUAL or kind.lower() == "id"):
                least = IN_TEXT
            low = min([low, *(max(v, least) for v in values)])
            high = max([high, *values])
    if name in OUTER:
        return high
    return high + low if low >= IN_TEXT else low


def blocks_of(source: str) -> tuple[list[Block], list[Node]]:
    """The page's blocks in order, and the tree of its block elements."""
    nodes = [Node("#page", -1, 0.0, 0)]
    blocks: list[Block] = []
    at, links, position = 0, 0, 0
    open_block: Block | None = None
    inline_hidden: list[str] = []

    def say(text: str) -> None:
        nonlocal open_block
        if not text or inline_hidden:
            return
        if open_block is None:
            if text.isspace():
                return
            open_block = Block(at)
            blocks.append(open_block)
        open_block.parts.append(text)
        if links:
            open_block.linked += len(text)

    for token in TOKEN.finditer(source):
        if token.start() > position:
            say(source[position:token.start()])
        position = token.end()
        raw, slash, name, attributes = token.group(1), token.group(2) or token.group(5), token.group(3) or token.group(6), \
            token.group(4) or token.group(7) or ""
        if raw:
            if raw.lower() in ("title", "textarea", "select", "iframe", "noscript", "template"):
                open_block = None
            continue
        if not name:
            continue
        name = name.lower()
        if name not in BLOCKS:
            if name == "br":
                say(" ")
            elif name == "a":
                links = 0 if slash else 1
            elif name not in VOID and not attributes.endswith("/"):
                if slash:
                    if inline_hidden and inline_hidden[-1] == name:
                        inline_hidden.pop()
                elif inline_hidden and inline_hidden[-1] == name or attributes and (
                        HIDDEN.search(attributes) or name == "label"):
                    inline_hidden.append(name)
            continue
        open_block, links = None, 0
        inline_hidden.clear()
        if slash:
            k = at
            while k > 0 and nodes[k].tag != name:
                k = nodes[k].parent
            if k > 0:
                at = nodes[k].parent
            continue
        if name == "hr":
            continue
        k = at
        if nodes[k].tag == "p":  # a paragraph holds no other block
            at = k = nodes[k].parent
        if name in CLOSES:
            while k > 0 and nodes[k].tag not in LISTS:
                if nodes[k].tag in CLOSES[name]:
                    at = nodes[k].parent
                    break
                k = nodes[k].parent
        elif name == "body" and nodes[at].tag == "head":
            at = nodes[at].parent
        weight = ELEMENTS.get(name, 0.0)
        if attributes:
            weight += hint_weight(attributes, name, nodes[at].inside)
            if HIDDEN.search(attributes):
                weight += HIDDEN_WEIGHT
        parent = nodes[at]
        nodes.append(Node(name, at, parent.weight + weight, parent.depth + 1, parent.inside or name in ("article", "main")))
        at = len(nodes) - 1
    if position < len(source):
        say(re.sub(r"<[a-zA-Z/!][^>]*\Z", "", source[position:], flags=re.S))
    out = []
    for block in blocks:
        block.text = " ".join(html.unescape("".join(block.parts)).split())
        if block.text:
            out.append(block)
    return out, nodes


def costs(block: Block, nodes: list[Node]) -> int:
    """The classifier's preference for content in units, negative for boilerplate."""
    size = sum(map(len, block.parts))
    value = nodes[block.container].weight + BASE + min(MOST_BY_LENGTH, PER_CHARACTER * len(block.text))
    return round(UNITS * (value + LINK_SHARE * block.linked / size))


def smoothness(blocks: list[Block], nodes: list[Node]) -> list[tuple[int, int, int]]:
    """Edges between neighbours in page order, and between consecutive blocks of one container's children."""
    edges: list[tuple[int, int, int]] = []
    last: dict[int, int] = {}
    for k, block in enumerate(blocks):
        if k:
            a, b, steps = blocks[k - 1].container, block.container, 0
            while a != b:
                if nodes[a].depth >= nodes[b].depth:
                    a = nodes[a].parent
                else:
                    b = nodes[b].parent
                steps += 1
            edges.append((k - 1, k, round(UNITS * ADJACENT / (1 + steps))))
        parent = nodes[block.container].parent
        if parent in last:
            edges.append((last[parent], k, round(UNITS * SAME_CONTAINER)))
        last[parent] = k
    return edges


def minimum_cut(prefer: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The labels of least total cost: a block against its preference costs its size, an edge between labels its own.

    ``prefer`` above zero asks for True. Of several cheapest labellings the one with the fewest True is returned.
    """
    n = len(prefer)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, capacity in edges:
        if a != b and capacity > 0:
            near[a][b] = near[a].get(b, 0) + capacity
            near[b][a] = near[b].get(a, 0) + capacity
    excess = list(prefer)
    label: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:  # a block that outweighs its edges keeps its side; its edges become costs of its neighbours
        k = waiting.popleft()
        if label[k] is not None or abs(excess[k]) < sum(near[k].values()) or excess[k] == 0 and near[k]:
            continue
        if excess[k] > 0 and excess[k] == sum(near[k].values()) and near[k]:
            continue
        label[k] = excess[k] > 0
        for other, capacity in near[k].items():
            del near[other][k]
            excess[other] += capacity if label[k] else -capacity
            waiting.append(other)
        near[k] = {}
    left = [k for k in range(n) if label[k] is None]
    if left:
        _augment(left, excess, near)
        reached = deque(k for k in left if excess[k] > 0)
        for k in reached:
            label[k] = True
        while reached:
            k = reached.popleft()
            for other, capacity in near[k].items():
                if capacity > 0 and label[other] is None:
                    label[other] = True
                    reached.append(other)
    return [bool(x) for x in label]


def _augment(left: list[int], excess: list[int], near: list[dict[int, int]]) -> None:
    """Pushes flow along shortest paths from blocks with excess to blocks with need, until none is left."""
    while True:
        before: dict[int, int] = {k: k for k in left if excess[k] > 0}
        queue, end = deque(before), None
        while queue and end is None:
            k = queue.popleft()
            for other, capacity in near[k].items():
                if capacity > 0 and other not in before:
                    before[other] = k
                    if excess[other] < 0:
                        end = other
                        break
                    queue.append(other)
        if end is None:
            return
        path = [end]
        while before[path[-1]] != path[-1]:
            path.append(before[path[-1]])
        amount = min(excess[path[-1]], -excess[end], *(near[b][a] for a, b in zip(path, path[1:])))
        excess[path[-1]] -= amount
        excess[end] += amount
        for a, b in zip(path, path[1:]):
            near[b][a] -= amount
            near[a][b] = near[a].get(b, 0) + amount


def main_text(source: str | None) -> str:
    """The content blocks of a page in order, one per line; an empty text if there is none."""
    blocks, nodes = blocks_of(source or "")
    if not blocks:
        return ""
    keep = minimum_cut([costs(b, nodes) for b in blocks], smoothness(blocks, nodes))
    return "\n".join(b.text for b, own in zip(blocks, keep) if own)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row from its whole html; null or empty html has an empty text.

    Rows that repeat or share an id are read one by one; an empty table gives no rows. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "html"):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, type=pa.string()),
                 pa.array([len(x) for x in texts], type=pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     F.col(html_col).cast("string").alias("html"))
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
