"""Main-text extraction by minimum cut.

A page is cut into blocks (the text between block-level tags). A logistic classifier
judges each block by its surroundings and its text; its log-odds become capacities
from the source (content) or to the sink (boilerplate). Neighbouring blocks, and
consecutive children of one parent, are joined by smoothness edges that weigh more the
deeper their common ancestor is. The minimum cut is the cheapest consistent labelling;
the source's side is the text.

The classifier is fitted in the driver on ``FITTED_ON`` built pages whose truth is known
(``op3_pages``; a bounded sample by construction) and travels to the tasks as a dozen
numbers. Class and id words are features of the innermost element that has one, never
verdicts; such an element does not count if it holds the page's headline or article and
most of its words, for it is then a wrapper.

Scripts, styles, templates, frames and comments are not text. Controls (buttons, selects,
text areas) and hidden elements are not text; controls end at the next block tag at the latest, an unclosed script at the next block
tag: neither can swallow the page. Fallback content (noscript, object, video, svg, math)
is text like any other. Character references are decoded; white space in a block becomes
single spaces; blocks are joined by line breaks in page order.

Null or empty html gives an empty text; an unfinished tag at the end of a page is no text.
Every row gives one row, repeated rows too; columns other than page_id, url and html are
ignored. Time is linear in the page but for the cut, which sees only blocks that the
classifier leaves in doubt. Row-local: no shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: From a tag's name to its end; quotes count only as values, and nothing is tried twice.
REST = re.compile(r"(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+>")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

#: Elements that are never text, up to their end tag.
RAW = frozenset("script style template iframe head title".split())
CONTROL = frozenset("select textarea button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
BLOCK_TAG = re.compile(r"</?(?:" + "|".join(sorted(BLOCK)) + r")(?=[\s/>])", re.IGNORECASE)
#: A start tag of the key ends an open element of the value, unless a container lies between.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINER = frozenset("article aside body div dl fieldset footer form header html main menu nav ol section table ul".split())

#: A form counts like a telling name: some pages are one form.
AWAY = frozenset("nav footer aside menu dialog search".split())
HOME = frozenset("article main".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
AWAY_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead header comment comments disqus reply replies respond cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget pagination pager toolbar skip copyright".split()
)
HOME_NAMES = frozenset("article content main post entry story body text prose".split())
#: A compound that starts so says something about its surroundings, not what it is.
ABOUT = frozenset("has no with without is not js wp type format single page layout".split())

FEATURES = ["bias", "away tag", "home tag", "away name", "home name", "linked", "words", "stops", "heading", "paragraph", "item"]
FITTED_ON, SEED, ROUNDS, RATE, DECAY = 240, 3, 400, 1.0, 1e-3
#: Smoothness: for neighbours, and for consecutive children of one parent.
NEAR, SIBLING = 0.4, 0.4


@dataclass
class Element:
    name: str
    parent: Element | None
    depth: int  # block elements above it
    tag: int = 0  # -1 away, 1 home, by tag or role
    named: Element | None = None  # the innermost element with a telling class or id, itself included
    sign: int = 0  # what its own class or id tells
    words: int = 0
    headline: bool = False
    hidden: bool = False  # never shown, or a control


@dataclass
class Text:
    element: Element | None
    shared: int  # depth of the last common ancestor with the block before
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    words: int = 0


def name_sign(value: str) -> int:
    """-1, 0 or 1: what a class or id attribute tells."""
    home = False
    for token in value.split():
        parts = [p.lower() for p in NAME_PART.findall(token)]
        away = AWAY_NAMES.intersection(parts)
        own = HOME_NAMES.intersection(parts)
        if not parts or len(parts) > 1 and parts[0] in ABOUT:
            continue
        if away and not (own and away == {"header"}):
            return -1
        home = home or bool(own)
    return int(home)


def opened(name: str, attributes: str, parent: Element | None) -> Element:
    e = Element(name, parent, (parent.depth if parent else 0) + (name in BLOCK))
    if parent:
        e.tag, e.named, e.hidden = parent.tag, parent.named, parent.hidden
    if name in HOME:
        # an article in a header is the article, one in a side column or footer is a teaser
        if e.tag >= 0 or all(p.name == "header" for p in ancestors(e) if p.tag < 0 and (p.parent is None or p.parent.tag >= 0)):
            e.tag = 1
    elif name in AWAY or (name == "header" and e.tag <= 0 and not (e.named and e.named.sign > 0)):
        e.tag, e.named = -1, None  # what holds around it does not hold in it
    e.hidden = e.hidden or name in CONTROL
    if attributes and name not in ("html", "body"):
        signs = []
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "hidden":
                e.hidden = e.hidden or value.lower() != "false"
            elif key == "aria-hidden":
                e.hidden = e.hidden or value.lower() == "true"
            elif key == "style":
                e.hidden = e.hidden or "display:none" in value.replace(" ", "").lower()
            elif key == "role":
                e.tag = 1 if value.lower() == "main" else -1 if value.lower() in AWAY_ROLES else e.tag
            else:
                signs.append(name_sign(value))
        # of its names one that says boilerplate decides, but on <article> and <main> only without one that says content
        e.sign = (1 if name in HOME and 1 in signs else -1) if -1 in signs else int(1 in signs)
    if name == "form" and not e.sign:
        e.sign = -1
    if e.sign:
        e.named = e
    return e


def ancestors(e: Element | None) -> Iterator[Element]:
    e = e.parent if e else None
    while e:
        yield e
        e = e.parent


class Reader:
    """One pass over a page: its blocks in order."""

    def __init__(self, html: str):
        self.html, self.blocks, self.block = html, [], None
        self.stack: list[Element] = []
        self.open: dict[str, list[int]] = {}  # name -> places in the stack
        self.containers: list[int] = []
        self.low = 0  # least depth since the last block
        self.links = 0
        self.missing: set[str] = set()  # raw elements without a further end tag
        self.run()

    def pop(self, k: int) -> None:
        while len(self.stack) > k:
            e = self.stack.pop()
            self.open[e.name].pop()
            if self.containers and self.containers[-1] == len(self.stack):
                self.containers.pop()
            self.links -= e.name == "a"
            if e.parent:
                e.parent.headline = e.parent.headline or e.headline
        self.low = min(self.low, self.stack[-1].depth if self.stack else 0)

    def push(self, e: Element) -> None:
        self.open.setdefault(e.name, []).append(len(self.stack))
        if e.name in CONTAINER:
            self.containers.append(len(self.stack))
        self.links += e.name == "a"
        e.headline = e.name == "h1" or e.name in HOME and e.sign >= 0 and e.tag > 0
        self.stack.append(e)

    def add(self, raw: str) -> None:
        if self.block is None:
            if not raw or raw.isspace():
                return
            top = self.stack[-1] if self.stack else None
            self.block = Text(top, self.low)
            self.low = top.depth if top else 0
            self.blocks.append(self.block)
        text = unescape(raw) if "&" in raw else raw
        self.block.parts.append(text)
        if self.links:
            self.block.linked += len(text.split())

    def close(self, name: str) -> None:
        places = self.open.get(name)
        # only a container's end tag reaches beyond another container
        if places and (name in CONTAINER or not self.containers or places[-1] > self.containers[-1]):
            self.pop(places[-1])

    def run(self) -> None:
        html, at, end, broken = self.html, 0, len(self.html), False
        while at < end:
            start = html.find("<", at)
            if start < 0:
                self.add(html[at:])
                return
            if html.startswith("<!--", start):
                self.add(html[at:start])
                at = html.find("-->", start)
                at = end if at < 0 else at + 3
                continue
            m = NAME.match(html, start + 1)
            if m is None:
                if html[start + 1 : start + 2] in ("!", "?", "/"):
                    self.add(html[at:start])
                    at = html.find(">", start) + 1 or end
                else:  # a bare sign
                    self.add(html[at : start + 1])
                    at = start + 1
                continue
            self.add(html[at:start])
            rest = None if broken else REST.match(html, m.end())
            stop = rest.end() if rest else html.find(">", m.end()) + 1
            broken = broken or rest is None
            if not stop:
                return  # an unfinished tag
            at = self.tag(m[0].lower(), html[m.end() : stop - 1], stop)

    def tag(self, name: str, attributes: str, at: int) -> int:
        """Handles a tag; where to read on."""
        ends, name = name[0] == "/", name.lstrip("/")
        if name in RAW and not (name == "title" and "svg" in self.open and self.open["svg"]):
            if ends:
                return at
            if self.block is not None:
                self.block.parts.append(" ")
            if name not in self.missing:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(self.html, at)
                if close:
                    return close.end()
                self.missing.add(name)
            if name in ("head", "title"):
                return at
            following = BLOCK_TAG.search(self.html, at)
            return following.start() if following else len(self.html)
        if name in BLOCK:
            self.block = None
            for c in CONTROL:
                if places := self.open.get(c):
                    self.pop(places[0])
        elif name == "br" and self.block is not None:
            self.block.parts.append(" ")
        if ends:
            self.close(name)
            return at
        if name in VOID or name not in BLOCK and attributes.endswith("/") and attributes[-2:-1] in ("", " ", "\t", "\n", '"', "'"):
            return at  # <a href=/> is open
        ended = ENDS.get(name, set()) | ({"p"} if name in BLOCK else set())
        inside = self.containers[-1] if self.containers else -1
        places = [p[-1] for e in ended if (p := self.open.get(e)) and p[-1] > inside]
        if places:
            self.pop(min(places))
        self.push(opened(name, attributes, self.stack[-1] if self.stack else None))
        return at


def blocks_of(html: str) -> list[Text]:
    """The page's blocks with text, in order."""
    reader = Reader(html)
    reader.pop(0)
    low, out = None, []
    for b in reader.blocks:
        b.text = " ".join("".join(b.parts).split())
        low = b.shared if low is None else min(low, b.shared)
        if b.text and not (b.element and b.element.hidden):
            b.words, b.shared, low = b.text.count(" ") + 1, low, None
            out.append(b)
    for b in out:
        seen = b.element.named if b.element else None
        while seen:  # every named element around it; those are few
            seen.words += b.words if b.element.tag >= 0 else 0
            seen = seen.parent.named if seen.parent else None
    return out


def features(b: Text, total: int) -> list[float]:
    """What the classifier sees of a block; ``total``: the page's words outside regions that a tag rules out."""
    e = b.element
    tag, named = (e.tag, e.named) if e else (0, None)
    while named and named.sign < 0 and named.headline and 2 * named.words > total:
        named = named.parent.named if named.parent else None  # a wrapper
    sign = named.sign if named else 0
    own = e.name if e else ""
    return [
        1.0, float(tag < 0), float(tag > 0), float(sign < 0), float(sign > 0), min(1.0, b.linked / b.words), math.log1p(min(b.words, 400)),
        float(min(3, sum(b.text.count(c) for c in ".!?"))), float(own in ("h1", "h2", "h3", "h4", "h5", "h6")), float(own == "p"), float(own in ("li", "td", "th", "dd", "dt")),
    ]


def page_features(blocks: list[Text]) -> np.ndarray:
    total = sum(b.words for b in blocks if not b.element or b.element.tag >= 0)
    return np.array([features(b, total) for b in blocks]).reshape(len(blocks), len(FEATURES))


@lru_cache(maxsize=1)
def classifier() -> tuple[float, ...]:
    """Weights (log-odds of content), fitted on built pages; blocks of one page count as much as those of another."""
    from .op3_pages import page

    xs, ys, ws = [], [], []
    for k in range(FITTED_ON):
        html, truth = page(SEED * 100_000 + k)
        blocks = blocks_of(html)
        kept = set(truth)
        xs.append(page_features(blocks))
        ys.append([float(b.text in kept) for b in blocks])
        ws.append(np.full(len(blocks), 1 / max(1, len(blocks))))
    x, y, w = np.concatenate(xs), np.concatenate(ys), np.concatenate(ws)
    w /= w.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(ROUNDS // 20):  # Newton steps: a dozen unknowns
        p = 1 / (1 + np.exp(-x @ beta))
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + DECAY * np.eye(len(beta))
        beta += RATE * np.linalg.solve(hessian, x.T @ (w * (y - p)) - DECAY * beta)
    return tuple(float(b) for b in beta)


def settled(scores: list[float], edges: list[tuple[int, int, float]]) -> tuple[list[float], dict[int, dict[int, float]], list[bool | None]]:
    """Labels of nodes whose own score outweighs all their edges: they have it in every minimum cut.

    Their edges move into their neighbours' scores, which may settle those too.
    """
    scores = list(scores)
    near: dict[int, dict[int, float]] = {i: {} for i in range(len(scores))}
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * len(scores)
    todo = list(range(len(scores)))
    while todo:
        i = todo.pop()
        if label[i] is not None or abs(scores[i]) <= sum(near[i].values()):
            continue
        label[i] = scores[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            scores[j] += w if label[i] else -w
            todo.append(j)
        near[i] = {}
    return scores, near, label


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: the smallest such side of a minimum cut, by blocking flows."""
    scores, near, label = settled(scores, edges)
    left = [i for i, x in enumerate(label) if x is None]
    n, number = len(left), {i: k for k, i in enumerate(left)}
    s, t = n, n + 1
    cap: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for k, i in enumerate(left):
        if scores[i] > 0:
            cap[s][k], cap[k][s] = scores[i], 0.0
        else:
            cap[k][t], cap[t][k] = -scores[i], 0.0
        for j, w in near[i].items():
            cap[k][number[j]] = w
    while True:
        level, ring = {s: 0}, [s]
        while ring and t not in level:
            ahead = []
            for u in ring:
                for v, c in cap[u].items():
                    if c > 1e-9 and v not in level:
                        level[v] = level[u] + 1
                        ahead.append(v)
            ring = ahead
        if t not in level:
            for k, i in enumerate(left):
                label[i] = k in level
            return [bool(x) for x in label]
        rest = {u: iter(list(cap[u])) for u in level}
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))  # noqa: B905
                cut = len(path)
                for k in range(len(path) - 1, 0, -1):
                    a, b = path[k - 1], path[k]
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                    if cap[a][b] <= 1e-9:
                        cut = k
                path = path[:cut]
                continue
            for v in rest[u]:
                if level.get(v) == level[u] + 1 and cap[u][v] > 1e-9:
                    path.append(v)
                    break
            else:
                path.pop()


def labelled(blocks: list[Text], weights: tuple[float, ...]) -> list[bool]:
    """Content or not, for every block. Consecutive blocks of one parent with scores of one sign are one node."""
    scores = (page_features(blocks) @ np.array(weights)).tolist()
    nodes: list[float] = []
    parents: list[Element | None] = []
    of, edges, last = [], [], {}
    for b, s in zip(blocks, scores, strict=True):
        parent = b.element.parent if b.element else None
        if nodes and parents[-1] is parent and (nodes[-1] > 0) == (s > 0):
            nodes[-1] += s
        else:
            i = len(nodes)
            if i:
                deep = max(b.element.depth if b.element else 0, before)
                edges.append((i - 1, i, NEAR * (1 + b.shared) / (1 + max(deep, b.shared))))
            if (j := last.get(id(parent))) is not None:
                edges.append((j, i, SIBLING))
            last[id(parent)] = i
            nodes.append(s)
            parents.append(parent)
        before = b.element.depth if b.element else 0
        of.append(len(nodes) - 1)
    kept = min_cut(nodes, edges)
    return [kept[i] for i in of]


def main_text(html: str | None, weights: tuple[float, ...] | None = None) -> str:
    blocks = blocks_of(html or "")
    return "\n".join(b.text for b, kept in zip(blocks, labelled(blocks, weights or classifier()), strict=True) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``; other columns are ignored."""
    weights = classifier()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
