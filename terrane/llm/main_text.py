"""Main text of web pages by a minimum cut (operator 2).

A page becomes a row of text blocks.  A classifier prices each block as content and as
boilerplate; these prices are the capacities of its edges to the two terminals.  Blocks next
to each other, and blocks under the same element, are tied by smoothness edges that weaken
with their distance in the element tree.  The minimum cut, found by maximum flow, is the
cheapest labelling.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements whose whole content is code or data.
_RAW = frozenset("script style noscript template textarea iframe object svg math select xmp title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html head body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul button label legend".split()
)
#: What an opening tag closes when it is open within the nearest container.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_PARAGRAPH = frozenset({"p"})
_FENCE = frozenset("ul ol dl table div section article main body aside nav header footer form blockquote td th".split())
_SKIP_ELEMENT = frozenset("nav footer aside form header menu button label legend dialog fieldset head".split())
_GOOD_ELEMENT = frozenset("article main".split())
_BAD_NAME = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted reader related reply replies search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)
_GOOD_NAME = frozenset("article body content entry main post story text".split())


@dataclass(frozen=True)
class Costs:
    """Log-odds that the classifier adds up, and the weights of the smoothness edges."""

    bias: float = -0.8
    per_log_word: float = 0.55
    link_share: float = -4.0
    paragraph: float = 1.0
    heading: float = 0.4
    list_item: float = -0.8
    in_article: float = 3.5
    good_name: float = 1.5
    boilerplate_element: float = -9.0
    bad_name: float = -7.0
    #: Next to what a few words weigh, so that the cut decides where no element or name tells.
    adjacency: float = 3.0
    proximity: float = 2.0


@dataclass
class Block:
    text: str
    tag: str
    linked: int
    #: The element, the one around it, and how many are open.
    ident: int
    parent: int
    depth: int
    #: Elements between this block and the one before it in the tree.
    apart: int
    odds: float = 0.0


@dataclass(slots=True)
class _Open:
    """An open element and what it inherits, so that nothing looks through the whole stack."""

    tag: str
    block: _Open | None = None  # the nearest block element, perhaps itself
    ident: int = 0
    parent: int = 0
    depth: int = 0
    article: bool = False
    bad_element: bool = False
    own_header: bool = False
    bad_name: bool = False
    good_name: bool = False

    def inner(self, tag: str, ident: int, hidden: bool, names: set[str]) -> _Open:
        x = _Open(tag, self.block, self.ident, self.parent, self.depth, self.article, self.bad_element or hidden, self.own_header, self.bad_name, self.good_name or bool(names & _GOOD_NAME))
        x.bad_name |= bool(names & _BAD_NAME) and tag not in ("body", "html")
        if tag in _BLOCK:
            x.block, x.ident, x.parent, x.depth = x, ident, self.ident, self.depth + 1
        if tag == "header" and self.article:
            x.own_header = True  # the article's own headline, unless another article begins in it
        elif tag in _SKIP_ELEMENT:
            x.bad_element = True
        if tag in _GOOD_ELEMENT:
            x.bad_element |= x.own_header
            x.article, x.own_header = True, False
        return x


class _Stack:
    """Open elements, with the places of each tag."""

    def __init__(self) -> None:
        self.open = [_Open("")]
        self.places: dict[str, list[int]] = {}

    @property
    def top(self) -> _Open:
        return self.open[-1]

    def push(self, x: _Open) -> None:
        self.places.setdefault(x.tag, []).append(len(self.open))
        self.open.append(x)

    def cut(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()

    def last(self, tags: Iterable[str]) -> int:
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def end(self, tag: str) -> None:
        """Close ``tag`` and what is open in it; inline elements don't reach beyond a container."""
        at = self.last((tag,))
        if at and (tag in _BLOCK or at > self.last(_FENCE)):
            self.cut(at)

    def make_room(self, tag: str) -> None:
        """Close what ``tag`` closes by beginning, within the nearest container."""
        close = _CLOSES.get(tag, _PARAGRAPH)
        fence = self.last(_FENCE - close)
        found = [at[k] for t in close if (at := self.places.get(t)) and (k := bisect_right(at, fence)) < len(at)]
        if found:
            self.cut(min(found))

    @property
    def in_link(self) -> bool:
        return bool(self.places.get("a"))


def _score(text: str, linked: int, o: _Open, tag: str, c: Costs) -> float:
    n = text.count(" ") + 1
    s = c.bias + c.per_log_word * math.log2(1 + n) + c.link_share * min(1.0, linked / max(1, len(text)))
    s += c.paragraph * (tag in ("p", "pre", "blockquote")) + c.heading * (tag[:1] == "h" and tag[1:].isdigit()) + c.list_item * (tag in ("li", "td", "option"))
    s += c.in_article * o.article + c.good_name * o.good_name
    return s + c.boilerplate_element * o.bad_element + c.bad_name * o.bad_name


def read_blocks(page: str, costs: Costs) -> list[Block]:
    """Text blocks in page order, each with its place in the element tree and log-odds of being content."""
    blocks: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = counter = low = before = 0  # low: least depth since the last block, which was ``before`` deep

    def flush() -> None:
        nonlocal linked, low, before
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                o = stack.top
                tag = o.block.tag if o.block else ""
                low = min(low, o.depth)
                blocks.append(Block(text, tag, linked, o.ident, o.parent, o.depth, before + o.depth - 2 * low, _score(text, linked, o, tag, costs)))
                low = before = o.depth
            parts.clear()
        linked = 0

    at = 0
    for m in _tokens(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if stack.in_link:
                linked += len(piece.strip())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        if tag in _BLOCK:
            flush()
        if m[1]:
            stack.end(tag)
        elif tag in _BLOCK:
            stack.make_room(tag)
        low = min(low, stack.top.depth)
        if m[1] or tag in _VOID or (m[3] or "").endswith("/"):
            continue
        counter += 1
        names = {w for x in _NAMES.findall(m[3]) for w in _WORD.findall("".join(x).lower())} if m[3] else set()
        stack.push(stack.top.inner(tag, counter, bool(m[3]) and bool(_HIDDEN.search(m[3])), names))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return blocks


def _tokens(page: str) -> Iterator[re.Match]:
    """Markup in page order; the content of raw elements is passed over."""
    at = 0
    while m := _TOKEN.search(page, at):
        yield m
        at = m.end()
        tag = (m[2] or "").lower()
        if tag in _RAW and not m[1]:
            close = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(page, at)
            yield _Skip(at, close.start() if close else len(page))
            at = close.start() if close else len(page)


class _Skip:
    """Stands for the content of a raw element, as if it were one comment."""

    def __init__(self, start: int, end: int) -> None:
        self._span = start, end

    def start(self) -> int:
        return self._span[0]

    def end(self) -> int:
        return self._span[1]

    def __getitem__(self, i: int) -> None:
        return None


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Cheapest labelling: True on the source side.  odds > 0 is what leaving that side costs."""
    n = len(odds)
    label: list[bool | None] = [None] * n
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, c in edges:
        near[i].append((j, c))
        near[j].append((i, c))
    rest = list(odds)
    # a node whose own price exceeds all its ties keeps its label in every minimum cut
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(rest[i]) > sum(c for j, c in near[i] if label[j] is None):
            label[i] = rest[i] > 0
            for j, c in near[i]:
                if label[j] is None:
                    rest[j] += c if label[i] else -c
                    todo.append(j)
    open_ = [i for i in range(n) if label[i] is None]
    if open_:
        for i, side in zip(open_, _max_flow(open_, rest, near, label), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], odds: list[float], near: list[list[tuple[int, float]]], label: list) -> list[bool]:
    """Flow along shortest paths, all of one length in a phase; what the source still reaches is its side of the cut."""
    place = {v: k for k, v in enumerate(nodes)}
    s, t = len(nodes), len(nodes) + 1
    cap: list[dict[int, float]] = [{} for _ in range(len(nodes) + 2)]
    for v, k in place.items():
        if odds[v] > 0:
            cap[s][k], cap[k][s] = odds[v], 0.0
        else:
            cap[k][t], cap[t][k] = -odds[v], 0.0
        for u, c in near[v]:
            if label[u] is None:
                cap[k][place[u]] = cap[k].get(place[u], 0.0) + c
    while True:
        level = {s: 0}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for u, c in cap[v].items():
                if c > 1e-9 and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if t not in level:
            return [k in level for k in range(len(nodes))]
        ahead = {v: iter([u for u in cap[v] if level.get(u) == level[v] + 1]) for v in level}
        path, now = [s], next(ahead[s], None)
        while now is not None or len(path) > 1:
            if now is None:  # a dead end: go back and try what comes next
                path.pop()
            elif cap[path[-1]][now] > 1e-9:
                path.append(now)
                if now == t:
                    steps = list(zip(path, path[1:], strict=False))
                    flow = min(cap[a][b] for a, b in steps)
                    for a, b in steps:
                        cap[a][b] -= flow
                        cap[b][a] = cap[b].get(a, 0.0) + flow
                    full = next(k for k, (a, b) in enumerate(steps) if cap[a][b] <= 1e-9)
                    del path[full + 1 :]
            now = next(ahead[path[-1]], None)


def ties(blocks: list[Block], costs: Costs) -> list[tuple[int, int, float]]:
    """Smoothness edges: to the next block, and to the next one under the same element, weaker with distance."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, costs.adjacency / (1 + b.apart)))
        if (j := last.get(b.parent)) is not None:
            a = blocks[j]
            apart = 0 if a.ident == b.ident else a.depth + b.depth - 2 * max(0, min(a.depth, b.depth) - (a.depth == b.depth))
            edges.append((j, i, costs.proximity / (1 + apart)))
        last[b.parent] = i
    return edges


def extract(page: str | None, costs: Costs) -> str:
    blocks = read_blocks(page or "", costs)
    content = min_cut([b.odds for b in blocks], ties(blocks, costs))
    return "\n".join(b.text for b, yes in zip(blocks, content, strict=True) if yes)


def main_text(pages: DataFrame, costs: Costs | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of ``pages``.

    Null or empty html, and pages without content, give an empty text.  Repeated rows each get
    a row; other columns are not read; an empty table gives an empty one.
    """
    costs = costs or Costs()
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(h, costs) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, url string, text string, n_chars long").withColumnRenamed("url", url_col)
