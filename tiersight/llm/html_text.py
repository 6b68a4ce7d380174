"""Main text of web pages by a tree-structured graphical model.

Every element of a page's DOM, text-level ones aside, has a hidden label: whether main text is in it.
Weights on what the element looks like and a potential between each parent and child are trained on
labelled pages by gradient ascent on the likelihood. Sum-product messages, upward and then downward,
give the exact marginals of both; an element's own text is taken where its marginal reaches a half.
The trees of many pages are one forest whose levels are handled together.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersight.llm.flat import parts
from tiersight.llm.sample_pages import labelled_pages

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
UNSEEN = frozenset("script style template iframe object svg canvas audio video select button textarea option datalist head title annotation annotation-xml".split())
RAW = frozenset("script style textarea title iframe template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas are text of the line that they are in.
INLINE |= frozenset("math semantics mrow mi mn mo ms mtext mstyle mfrac msqrt mroot msub msup msubsup munder mover munderover mpadded mphantom menclose mspace".split())
FIELDS = frozenset("input select textarea".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag ends open elements of these names, down to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "body": ({"head"}, {"html"})}
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
SPECIAL = re.compile("[>\"']")
#: Elements nested deeper become siblings at this depth, as in browsers.
DEEPEST = 512
#: Parts of pages: a form around one may hold the page, not only fields.
LANDMARKS = frozenset("article main header footer nav".split())
NAMED = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\btype\s*=\s*["']?hidden""", re.I)
PART = re.compile(r"[a-z]+")
#: Parts of class names and ids that mark what an element is for.
MARKS = frozenset(
    "ad ads adv advert advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header head masthead top footer foot bottom copyright legal sidebar side aside rail widget related recommended recommendations more trending popular latest teaser comment comments commentlist discussion disqus reply replies response responses respond reader cookie cookies consent gdpr notice notification alert message popup modal overlay share sharing social follow subscribe subscription newsletter signup form login search tags tagcloud category categories meta byline author date pagination pager skip toolbar tools print article content contents main maincontent post entry body text story page column primary prose single hentry document paragraph lead summary".split()
)


class Element:
    """A node: its name, parent's number, marks and the text pieces of its own, in page order."""

    __slots__ = ("tag", "parent", "depth", "marks", "role", "label", "size", "linked", "all_size", "all_linked", "children", "fields", "unseen")

    def __init__(self, tag: str, parent: int, depth: int, marks: tuple, role: str, label: str | None, unseen: bool):
        self.tag, self.parent, self.depth, self.marks, self.role, self.label, self.unseen = tag, parent, depth, marks, role, label, unseen
        self.size = self.linked = self.all_size = self.all_linked = self.children = self.fields = 0


class Page(NamedTuple):
    elements: list[Element]
    #: (element, text, whether in a link); None for the edge of a block.
    flow: list[tuple[int, str | None, bool]]


def _named(attributes: str) -> tuple[tuple, str, str | None]:
    marks, role, label = [], "", None
    if "=" in attributes:
        for name, a, b, c in NAMED.findall(attributes):
            value, name = (a or b or c).lower(), name.lower()
            if name == "role":
                role = value.strip()
            elif name == "data-y":
                label = value
            else:
                marks += [x for x in PART.findall(value) if x in MARKS]
    return tuple(dict.fromkeys(marks)), role, label


class Token(NamedTuple):
    start: int
    end: int
    name: str  # empty for comments and the like
    closing: bool
    attributes: str


class Tokens:
    """Finds tags and comments; reads a page about once, whatever is in it.

    A tag ends at the first `>` outside of quotes, or, where a quote is never closed, at the first `>`.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        #: places outside of quotes from which no end of a tag is reached
        self.dead: set[int] = set()

    def _tag_end(self, at: int) -> int:
        passed, here = [], at
        while here not in self.dead:
            m = SPECIAL.search(self.page, here)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            passed.append(here)
            here = self.page.find(m[0], m.end()) + 1
            if not here:
                break
        self.dead.update(passed)
        return self.page.find(">", at)

    def after(self, at: int) -> Token | None:
        page = self.page
        while (i := page.find("<", at)) >= 0:
            at = i + 1
            if page.startswith("!--", at):
                end = page.find("-->", i + 4)
                return Token(i, end + 3 if end >= 0 else len(page), "", False, "")
            closing = page.startswith("/", at)
            m = NAME.match(page, at + closing) if i < self.last else None
            if m:
                end = self._tag_end(m.end())
                return Token(i, end + 1, m[0].lower(), closing, page[m.end() : end])
            if page[at : at + 1] in ("!", "?", "/"):
                end = page.find(">", at) if i < self.last else -1
                return Token(i, end + 1 if end >= 0 else len(page), "", False, "")
        return None


class Open:
    """The open elements: name, number of the node that their text goes to, whether in a link."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, node: int, link: bool) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, node, link))

    def nearest(self, names: set | frozenset) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def cut(self, place: int) -> int:
        """Close the element at a place and all in it; its node."""
        node = self.stack[place][1]
        for name, _, _ in self.stack[place:]:
            self.places[name].pop()
        del self.stack[place:]
        return node


def parse(page: str) -> Page:
    """The page's elements, parents before children, and its text in order."""
    elements, flow = [Element("", -1, 0, (), "", None, False)], []
    tokens, opened = Tokens(page), Open()
    raw_ends: dict[str, int] = {}

    def text(value: str) -> None:
        _, node, link = opened.stack[-1]
        if value and not elements[node].unseen:
            flow.append((node, value, link))

    def close(names: set | frozenset, until: set | frozenset) -> None:
        place = opened.nearest(names)
        if place > opened.nearest(until):
            flow.append((opened.cut(place), None, False))

    at, end = 0, len(page)
    while at < end:
        token = tokens.after(at)
        if token is None:
            text(page[at:])
            break
        text(page[at : token.start])
        at, name = token.end, token.name
        if not name:
            continue
        if token.closing:
            if place := opened.nearest({name}):
                node = opened.cut(place)
                if name not in INLINE:
                    flow.append((node, None, False))
            continue
        if name in CLOSES_P:
            close({"head"}, {"body"})
            close({"p"}, {"article", "section", "div", "td", "li", "blockquote", "body", "main", "aside", "footer", "header", "form"})
        if name in ENDS:
            close(*ENDS[name])
        _, top, link = opened.stack[-1]
        marks, role, label = _named(token.attributes)
        if name in FIELDS and not HIDDEN.search(token.attributes):
            elements[top].fields += 1
        if name in ("br", "hr"):
            flow.append((top, None, False))
        elif name in INLINE and not marks and not role:
            opened.push(name, top, link or name == "a")
        elif name not in VOID:
            if name not in INLINE:
                flow.append((top, None, False))
            above = top if elements[top].depth < DEEPEST else elements[top].parent
            parent = elements[above]
            parent.children += 1
            elements.append(Element(name, above, parent.depth + 1, marks, role, label, elements[top].unseen or name in UNSEEN))
            opened.push(name, len(elements) - 1, link or name == "a")
            if name in RAW:
                if raw_ends.get(name, -1) < at:
                    done = re.compile(f"</{name}\\b", re.I).search(page, at)
                    raw_ends[name] = done.start() if done else end
                at = raw_ends[name]
    return Page(elements, flow)


def _bucket(n: int, edges: tuple) -> int:
    for k, edge in enumerate(edges):
        if n < edge:
            return k
    return len(edges)


def features(page: Page) -> list[list[tuple]]:
    """What each element looks like."""
    elements = page.elements
    for i, value, linked in page.flow:
        if value:
            n = len(value.strip())
            elements[i].size += n
            elements[i].linked += n * linked
    for e in elements:
        e.all_size, e.all_linked = e.size, e.linked
    for e in reversed(elements):
        if e.parent >= 0:
            elements[e.parent].all_size += e.all_size
            elements[e.parent].all_linked += e.all_linked
    wraps = [False] * len(elements)
    for i in range(len(elements) - 1, 0, -1):
        wraps[elements[i].parent] |= wraps[i] or elements[i].tag in LANDMARKS
        elements[elements[i].parent].fields += elements[i].fields
    # what the nearest form around an element is like: how densely it has fields, its share of the page, and whether parts of pages are in it
    forms: list[tuple] = [()] * len(elements)
    for i, e in enumerate(elements):
        if e.tag == "form":
            forms[i] = (_bucket(int(1000 * e.fields / max(e.all_size, 1)), (1, 3, 6, 12, 25)), _bucket(int(10 * e.all_size / max(elements[0].all_size, 1)), (3, 6, 9)), wraps[i])
        elif i:
            forms[i] = forms[e.parent]
    out = []
    for e, form in zip(elements, forms):
        above = elements[e.parent].tag if e.parent >= 0 else ""
        short = _bucket(e.all_size, (1, 25, 80, 250, 1000))
        own = _bucket(e.size, (1, 25, 80, 250))
        links = _bucket(int(10 * e.all_linked / e.all_size), (1, 3, 6)) if e.all_size else 4
        found = [("bias",), ("tag", e.tag), ("above", above, e.tag), ("size", short), ("own", own), ("links", links), ("tag size", e.tag, short), ("tag links", e.tag, links)]
        if e.unseen:
            found.append(("unseen",))
        if form:
            dense, share, holds = form
            found += [("form", dense, share, holds), ("form fields", dense), ("form tag", e.tag, dense)]
        if e.role:
            found.append(("role", e.role))
        found += [("mark", x) for x in e.marks]
        out.append(found)
    return out


class Forest(NamedTuple):
    """Trees by level: for each level from 1 on, the nodes and their parents."""

    n: int
    levels: list[tuple[np.ndarray, np.ndarray]]


def forest(pages: list[Page]) -> Forest:
    depth, parent, base = [], [], 0
    for page in pages:
        depth += [e.depth for e in page.elements]
        parent += [base + e.parent for e in page.elements]
        base += len(page.elements)
    depth, parent = np.array(depth), np.array(parent)
    order = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[order], np.arange(1, depth.max() + 2))
    return Forest(base, [(order[a:b], parent[order[a:b]]) for a, b in zip(edges, edges[1:])])


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def sum_product(trees: Forest, scores: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1, and the sum over edges of the pair marginals (parent, child).

    scores: log-odds of label 1 of each node; pair: log-potentials (parent, child).
    """
    up = np.zeros((trees.n, 2))
    up[:, 1] = scores
    message = np.zeros((trees.n, 2))
    for nodes, parents in reversed(trees.levels):
        m = _sum_exp(pair[None] + up[nodes][:, None, :], 2)
        message[nodes] = m - m.max(1, keepdims=True)
        np.add.at(up, parents, message[nodes])
    down, pairs = np.zeros((trees.n, 2)), np.zeros((2, 2))
    for nodes, parents in trees.levels:
        rest = up[parents] + down[parents] - message[nodes]
        m = _sum_exp(rest[:, :, None] + pair[None], 1)
        down[nodes] = m - m.max(1, keepdims=True)
        joint = rest[:, :, None] + pair[None] + up[nodes][:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    total = up + down
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -50, 50))), pairs


class Model(NamedTuple):
    weights: dict[tuple, float]
    pair: np.ndarray


def labels_of(page: Page) -> np.ndarray:
    """1 where an element or one below it is marked data-y=1."""
    y = np.array([e.label == "1" for e in page.elements])
    for i in range(len(y) - 1, 0, -1):
        y[page.elements[i].parent] |= y[i]
    return y


def train(labelled: list[str], rounds: int = 400, rate: float = 0.2, prior: float = 0.0003) -> Model:
    """Gradient ascent (Adam) on the likelihood of pages whose main text is marked data-y=1."""
    pages = [parse(p) for p in labelled]
    found = [f for p in pages for f in features(p)]
    index: dict[tuple, int] = {}
    flat = np.array([index.setdefault(x, len(index)) for f in found for x in f])
    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
    y = np.concatenate([labels_of(p) for p in pages]).astype(float)
    trees = forest(pages)
    seen = np.zeros((2, 2))
    for nodes, parents in trees.levels:
        np.add.at(seen, (y[parents].astype(int), y[nodes].astype(int)), 1)
    at, mean, square = np.zeros(len(index) + 4), 0.0, 0.0
    for t in range(1, rounds + 1):
        w, pair = at[:-4], at[-4:].reshape(2, 2)
        marginal, pairs = sum_product(trees, np.bincount(owner, w[flat], len(y)), pair)
        gradient = np.concatenate([np.bincount(flat, (y - marginal)[owner], len(index)), (seen - pairs).ravel()]) - prior * at * len(pages)
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        at = at + rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Model(dict(zip(index, at.tolist())), at[-4:].reshape(2, 2))


@lru_cache(maxsize=1)
def default_model() -> Model:
    """Trained once a session on the generated pages of this package."""
    return train(labelled_pages())


def content_marginals(model: Model, pages: list[Page]) -> list[np.ndarray]:
    weight = model.weights.get
    scores = np.array([sum(weight(x, 0.0) for x in f) for p in pages for f in features(p)])
    marginals, _ = sum_product(forest(pages), scores, model.pair)
    return np.split(marginals, np.cumsum([len(p.elements) for p in pages])[:-1])


def text_of(page: Page, marginals: np.ndarray, least: float = 0.5) -> str:
    """Blocks of main text, white space turned into one space, joined by one space."""
    parts = [" " if value is None else html_module.unescape(value) for i, value, _ in page.flow if value is None or (marginals[i] >= least and not page.elements[i].unseen)]
    return " ".join("".join(parts).split())


def main_texts(model: Model, pages: list[str | None], at_once: int = 64) -> list[str]:
    out = []
    for k in range(0, len(pages), at_once):
        parsed = [parse(p or "") for p in pages[k : k + at_once]]
        out += [text_of(p, m) for p, m in zip(parsed, content_marginals(model, parsed))]
    return out


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns of `pages` but html, and text and n_chars, its code points.

    model: trained on pages of one's own; else on the generated labelled pages of this package.
    Null html counts as empty and has an empty text; so has a page in which no main text is found.
    Rows with null or repeated ids or urls are extracted each for itself. Columns of `pages` named
    text or n_chars are replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    taken = [f for f in pages.schema if f.name.lower() not in ("html", "text", "n_chars")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "html"):
                texts = main_texts(shared.value, part.column("html").to_pylist())
                columns = [part.column(f.name) for f in taken]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*(f.name for f in taken), "text", "n_chars"])

    typed = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in taken)
    return pages.select(*(f"`{f.name}`" for f in taken), F.col("html")).mapInArrow(each, f"{typed}text string, n_chars long")
