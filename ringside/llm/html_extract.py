"""Main text of web pages by minimum-cut labelling.

A page is read into blocks: runs of text between block-level tags, each with its DOM path.
A logistic classifier over simple features of a block gives the costs of calling it content
or boilerplate; they are the capacities to the two terminals. Neighbouring blocks, and
blocks of one parent, are joined by edges that weigh more the nearer they are in the DOM:
cutting one costs its weight. The maximum flow between the terminals is the cheapest
labelling, and the blocks on the content side are the text.

The classifier is trained on blocks whose markup says what they are (an article element; a
nav or footer element), with and without the features of that markup, so that it also learns
what such blocks look like elsewhere. Its weights are drawn to prior ones, which hold where
the pages teach nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drawn, text_of

#: Fixed values of HTML: tags that begin and end a block, whose content is no text, and that have no end.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN_TAGS = frozenset("script style noscript template iframe svg title textarea select button object canvas audio video noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noframes iframe".split())
#: Words of class and id attributes that mark boilerplate, and content.
AWAY = re.compile(r"(?<![a-z])(?:ads?|adverts?|advertis\w*|adsense|banner|breadcrumbs?|comments?|commentlist|respond|disqus|cookies?|consent|gdpr|notice|notices|alert|copyright|footer|foot|menu|menus|modal|nav|navbar|navigation|newsletter|overlay|pagination|pager|popup|promo\w*|recommend\w*|related|replies|share|sharing|sidebar|sidebars|signup|skip|social|sponsor\w*|subscribe|subscription|tags|toolbar|trending|widget|widgets|login|search)(?![a-z])")
TOP = re.compile(r"(?<![a-z])(?:header|masthead)(?![a-z])")  # boilerplate outside an article only
TOWARDS = re.compile(r"(?<![a-z])(?:article|articlebody|body|content|entry|main|post|story|text)(?![a-z])")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*\Z",
    re.S,
)
ATTR = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

FEATURES = ("bias", "length", "links", "heading", "paragraph", "item", "stops", "article", "nav", "footer", "header", "aside", "form", "away", "towards", "all_links")
#: Weights that the trained ones are drawn to.
PRIOR = np.array([-0.5, 1.0, -2.0, 0.3, 1.0, -0.5, 1.0, 3.0, -4.0, -4.0, -3.0, -4.0, -3.0, -4.0, 1.0, -1.5])
#: Features that follow from the markup that labels training blocks.
MARKUP = np.isin(FEATURES, ("article", "nav", "footer", "header", "aside", "form", "away", "towards"))


@dataclass
class Block:
    text: str
    depth: int  # how many elements hold it
    parent: int  # the number of the element around the innermost of them; 0: none
    shared: int  # how many of them hold the block before, too
    features: list[float]


class _Attrs(dict):
    """What the class, id and role attributes of a tag say: (away, top, towards); remembered."""

    def __missing__(self, attrs: str) -> tuple[bool, bool, bool]:
        if len(self) > 100_000:
            self.clear()
        said = " ".join(CAMEL.sub("-", "".join(m)) for m in ATTR.findall(attrs)).lower()
        self[attrs] = got = tuple(bool(said and p.search(said)) for p in (AWAY, TOP, TOWARDS))
        return got


_ATTRS = _Attrs()
_PLAIN = (False, False, False)


class _Stack:
    """The open elements, with counts and places that spare a walk through them."""

    #: What an element may say, by its tag.
    SAYS = {"article": "article", "main": "article", "nav": "nav", "menu": "nav", "footer": "footer", "header": "header", "aside": "aside", "dialog": "aside", "form": "form", "fieldset": "form", "a": "a"}

    def __init__(self):
        self.elements: list[tuple[str, int, list[str]]] = []  # tag, number, what it says
        self.places: dict[str, list[int]] = {}  # of each tag
        self.blocks: list[int] = []  # places of block elements
        self.said = dict.fromkeys((*self.SAYS.values(), "away", "top", "towards"), 0)
        self.number = self.low = 0  # low: least depth since the last block of text

    def enter(self, tag: str, marks: tuple[bool, bool, bool]) -> None:
        self.number += 1
        says = [self.SAYS[tag]] if tag in self.SAYS else []
        says += [k for k, m in zip(("away", "top", "towards"), marks) if m]
        for k in says:
            self.said[k] += 1
        self.places.setdefault(tag, []).append(len(self.elements))
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.elements))
        self.elements.append((tag, self.number, says))

    def leave(self, at: int) -> None:
        """End the element at a place, and those in it."""
        while len(self.elements) > at:
            tag, _, says = self.elements.pop()
            self.places[tag].pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()
            for k in says:
                self.said[k] -= 1
        self.low = min(self.low, at)

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost element with one of the tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def block(self, text: str, links: float) -> Block:
        depth, shared = len(self.elements), self.low
        self.low = depth
        inner = self.elements[self.blocks[-1]][0] if self.blocks else ""
        return Block(text, depth, self.elements[-2][1] if depth > 1 else 0, shared, _features(text, links, inner, self.said))


#: Elements that end an open one of their kind, and where the search for it stops.
ITEMS = frozenset(("li", "dd", "dt", "option", "td", "th", "tr"))
ITEM_BOUNDS = ("ul", "ol", "table", "dl", "menu", "article", "div", "section", "main", "body")
TEXT_BOUNDS = ("article", "div", "section", "main", "body", "td", "th", "li")


def blocks(html: str) -> list[Block]:
    """The blocks of a page that have text, in page order; the work is linear in the page."""
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = hidden = at = 0
    hidden_tag, inner = "", {}  # inner: open elements within the hidden one, by tag
    endless: set[str] = set()  # raw elements of which no end tag follows

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(stack.block(text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if stack.said["a"]:
                linked += len(text.strip())

    for m in TOKEN.finditer(html):
        if m.start() < at:  # inside a raw element that has been passed
            continue
        say(html[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, close = tag.lower(), m["close"] or m["close2"]
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in RAW_TAGS and not close:  # up to its own end tag, whatever is between; a slash ends it only if there is none
            end = None if tag in endless else _raw_end(tag).search(html, at)
            if not end:
                endless.add(tag)
            at = end.end() if end else at if attrs.endswith("/") else len(html)
            continue
        if hidden:
            if tag == hidden_tag and (close or not attrs.endswith("/")):
                hidden += -1 if close else 1
                continue
            if tag in VOID_TAGS or attrs.endswith("/"):
                continue
            if not close or inner.get(tag) or not stack.places.get(tag):
                inner[tag] = max(0, inner.get(tag, 0) + (-1 if close else 1))
                continue
            hidden = 0  # what holds the hidden element ends, and so does it
        if close:
            if tag in BLOCK_TAGS:
                flush()
            k = stack.last((tag,))
            # an inline end tag doesn't end the blocks around it
            if k >= 0 and (tag in BLOCK_TAGS or not stack.blocks or stack.blocks[-1] < k):
                stack.leave(k)
            continue
        if tag in VOID_TAGS:
            if tag == "hr":
                flush()
            elif tag == "br":
                say(" ")
            continue
        if tag == "head":  # its end tag may be left out; what may stand in it has no text of its own
            flush()
            continue
        if attrs.endswith("/") and tag not in BLOCK_TAGS and tag not in RAW_TAGS:
            continue
        if tag in HIDDEN_TAGS:
            hidden, hidden_tag, inner = 1, tag, {}
            continue
        if tag in BLOCK_TAGS:
            flush()
            # a block ends an open paragraph; items, cells and rows end those before them
            k = stack.last(("p", tag)) if tag in ITEMS else stack.last(("p",))
            if k > stack.last(ITEM_BOUNDS if tag in ITEMS else TEXT_BOUNDS):
                stack.leave(k)
        stack.enter(tag, _ATTRS[attrs] if attrs and tag not in ("html", "body") else _PLAIN)
    say(html[at:])
    flush()
    return out


@lru_cache(maxsize=len(RAW_TAGS))
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


def _features(text: str, links: float, inner: str, said: dict[str, int]) -> list[float]:
    """inner: the innermost block element's tag; said: what the elements around the text say."""
    return [
        1.0,
        float(np.log1p(len(text))) / 4 if len(text) > 256 else _LOG[len(text)],
        links,
        float(len(inner) == 2 and inner[0] == "h" and inner[1].isdigit()),
        float(inner in ("p", "pre", "blockquote")),
        float(inner in ("li", "dt", "td", "th")),
        min(3, sum(map(text.count, ".!?,"))) / 3,
        float(said["article"] > 0),
        float(said["nav"] > 0),
        float(said["footer"] > 0),
        float(not said["article"] and (said["header"] > 0 or said["top"] > 0)),
        float(said["aside"] > 0),
        float(said["form"] > 0),
        float(said["away"] > 0),
        float(said["towards"] > 0),
        float(links > 0.8),
    ]


_LOG = [float(np.log1p(n)) / 4 for n in range(257)]


def max_flow_side(n: int, to_source: list[float], to_sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node, whether it is on the source's side of a minimum cut (the smallest such side).

    Dinic's algorithm: levels by breadth-first search, blocking flows by depth-first search.
    """
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def add(a: int, b: int, ab: float, ba: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(ab)
        head[b].append(len(to))
        to.append(a)
        cap.append(ba)

    for k in range(n):  # what both terminals offer flows straight through
        through = min(to_source[k], to_sink[k])
        if to_source[k] > through:
            add(s, k, to_source[k] - through, 0.0)
        if to_sink[k] > through:
            add(k, t, to_sink[k] - through, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        step = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= least)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while step[a] < len(head[a]):
                e = head[a][step[a]]
                if cap[e] > least and level[to[e]] == level[a] + 1:
                    break
                step[a] += 1
            if step[a] < len(head[a]):
                path.append(head[a][step[a]])
                a = to[path[-1]]
            elif path:
                level[a] = -1
                a = to[path.pop() ^ 1]
            else:
                break


def labels(found: list[Block], weights: np.ndarray, near: float = 1.0, kin: float = 0.5) -> list[bool]:
    """Whether each block is content, by the minimum cut.

    near, kin: weights of edges between neighbours, and to the next block of the same parent;
    both fall off with the DOM distance.
    """
    if not found:
        return []
    margin = np.clip(np.array([b.features for b in found]) @ weights, -8, 8)
    # costs: -log of the probability of the label that a cut would deny
    content, other = np.logaddexp(0, margin).tolist(), np.logaddexp(0, -margin).tolist()
    edges, last = [], {}
    for k, b in enumerate(found):
        if k:
            apart = max(0, found[k - 1].depth + b.depth - 2 * b.shared - 2)
            edges.append((k - 1, k, near * 0.5**apart))
        if (j := last.get(b.parent)) is not None and j < k - 1:
            edges.append((j, k, kin))
        last[b.parent] = k
    return max_flow_side(len(found), content, other, edges)


def extract(html: str, weights: np.ndarray) -> str:
    """The main text of a page: its content blocks in page order, one a line."""
    found = blocks(html)
    return "\n".join(b.text for b, keep in zip(found, labels(found, weights)) if keep)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 500, per_page: int = 200) -> np.ndarray:
    """The classifier's weights, from a sample of pages.

    At most `sample` pages (the first in the order of a hash of the id) give the driver at
    most `per_page` blocks each, drawn by a hash of their text and place; only this training is
    bounded, never the extraction. Pages without telling markup, and an empty table, leave the
    prior weights. A null page counts as an empty one; repeated pages count as often as they are drawn;
    pages are read whole, however long; other columns are ignored.
    """
    bounded_batches(pages.sparkSession)

    def extract_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [b.features for h in pdf["html"] for b in some(blocks(h))]})

    def some(found: list[Block]) -> list[Block]:
        if len(found) <= per_page:
            return found
        hashes = [zlib.crc32(f"{k}:{b.text}".encode("utf-8", "surrogatepass")) for k, b in enumerate(found)]
        return [found[k] for k in sorted(np.argsort(hashes, kind="stable")[:per_page].tolist())]

    rows = drawn(pages.select(F.col(id_col).alias("id"), text_of(html_col).alias("html")), "id", sample, "html")
    got = rows.select("html").mapInPandas(extract_features, "x array<double>").toPandas()
    if not len(got):
        return PRIOR.copy()
    x = np.array(got["x"].tolist())
    col = {k: x[:, n] > 0 for n, k in enumerate(FEATURES)}
    away = col["nav"] | col["footer"] | col["header"] | col["aside"] | col["form"] | col["away"]
    told = away | col["article"]
    x, y = x[told], (~away[told]).astype(float)
    x = np.r_[x, np.where(MARKUP, 0.0, x)]
    y = np.r_[y, y]
    w = PRIOR.copy()
    for _ in range(25):  # Newton steps on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / max(1, len(y)) * 200 + (w - PRIOR)
        h = (x.T * (p * (1 - p))) @ x / max(1, len(y)) * 200 + np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    # no training set may teach that telling markup speaks for the opposite
    return np.where(MARKUP & (PRIOR < 0), np.minimum(w, PRIOR), np.where(MARKUP, np.maximum(w, PRIOR), w))


def main_text(pages: DataFrame, weights: np.ndarray, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every page, from its whole html.

    The text is empty if the page is null, empty or has no content. Pages are read whole, however
    long or deep. Repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series([extract(h, weights) for h in html])

    return pages.select(F.col(id_col).alias("id"), text.asNondeterministic()(text_of(html_col)).alias("text"))
