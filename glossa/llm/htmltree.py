"""HTML extraction with a tree-structured graphical model.

The nodes of a page's element tree are binary variables (content or not); each has a unary potential from its features and each
parent-child pair a 2 x 2 potential. Sum-product messages, upward and then downward, give exact marginals. Both kinds of potentials are
trained by gradient ascent on the likelihood of labelled pages, the unlabelled nodes being summed out. The pieces of text between tags
are leaves of the tree, so that their order is kept.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv


@dataclass(frozen=True)
class HtmlParams:
    #: Labelled pages to train on: those with the smallest hash of page_id, at most so many.
    max_train_pages: int = 256
    epochs: int = 80
    rate: float = 0.1
    ridge: float = 1e-3
    threshold: float = 0.5


#: No part looks beyond the next "<" (but for what ends comments and raw elements, which is then consumed), so time is linear.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template)\b[^<>]*+>.*?(?:</(?P=raw)\s*+>|\Z)|<[!?][^<>]*+>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^<>\"']|\"[^\"<]*+\"|'[^'<]*+')*+|[^<>]*+)>",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag that ends an open element of the set.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
TAGS = "html head title body header footer nav main article section aside div p span a b i strong em h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre code form button label figure figcaption dl dt dd".split()
_TAG = {t: i for i, t in enumerate(TAGS)}
WORDS = 64
#: One-hot tag (and one for others), hashed class and id words, one-hot parent tag, then bias and numbers.
WIDTH = 2 * (len(TAGS) + 1) + WORDS + 7


#: Elements that don't break the line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())


@dataclass
class Tree:
    """Elements and, as leaves, the pieces of text between tags, in document order."""

    tag: list[str]
    parent: list[int]
    depth: list[int]
    text: list[str]
    names: list[str]
    #: Of pieces of text: whether white space goes before, and the line, which block elements and br end.
    lead: list[bool]
    line: list[int]


def parse(source: str) -> Tree:
    """The element tree. Node 0 is the root; text is a leaf of the innermost open element. Tags that don't nest are repaired as they come."""
    t = Tree(["#root"], [-1], [0], [""], [""], [False], [0])
    stack, open_ = [0], {}
    at, line, space = 0, 0, False

    def add(tag: str, text: str, names: str, lead: bool) -> int:
        t.tag.append(tag)
        t.parent.append(stack[-1])
        t.depth.append(len(stack))
        t.text.append(text)
        t.names.append(names)
        t.lead.append(lead)
        t.line.append(line)
        return len(t.tag) - 1

    def pop() -> None:
        nonlocal line, space
        tag = t.tag[stack.pop()]
        open_[tag] -= 1
        if tag not in INLINE:
            line, space = line + 1, False

    def words(a: int, b: int) -> None:
        nonlocal space
        if b > a:
            s = html.unescape(source[a:b])
            x = _SPACE.sub(" ", s)
            y = x.strip()
            if y:
                add("#text", y, "", space or x[0] == " ")
                space = x[-1] == " "
            else:
                space = space or bool(x)

    for m in _TOKEN.finditer(source):
        words(at, m.start())
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["close"]:
            # An end tag without an open element is passed over; otherwise each element looked at is closed, so time is linear.
            while open_.get(tag, 0):
                last = t.tag[stack[-1]]
                pop()
                if last == tag:
                    break
            continue
        attrs = m["attrs"] or ""
        if tag in VOID:
            if tag in ("br", "hr"):
                line, space = line + 1, False
            elif tag != "wbr":
                space = True
            continue
        ends = CLOSES.get(tag)
        if ends and len(stack) > 1 and t.tag[stack[-1]] in ends:
            pop()
        if tag not in INLINE:
            line, space = line + 1, False
        node = add(tag, "", " ".join(x for g in _NAMES.findall(attrs) for x in g if x).lower() if attrs else "", False)
        if not attrs.endswith("/"):
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1
        elif tag not in INLINE:
            line, space = line + 1, False
    words(at, len(source))
    return t


def lines(t: Tree, nodes: list[int]) -> list[tuple[list[int], str]]:
    """The given pieces of text (ascending) by line, and each line's text."""
    out: list[tuple[list[int], str]] = []
    parts: list[str] = []
    last = -1
    for k in nodes:
        if not out or t.line[k] != t.line[last]:
            if out:
                out[-1] = (out[-1][0], "".join(parts))
            out.append(([], ""))
            parts = []
        elif t.lead[k] or any(t.text[i] for i in range(last + 1, k)):
            parts.append(" ")
        out[-1][0].append(k)
        parts.append(t.text[k])
        last = k
    if out:
        out[-1] = (out[-1][0], "".join(parts))
    return out


@dataclass
class Forest:
    """Trees side by side: features of the nodes, their parents (-1 at roots), depths and pages."""

    x: np.ndarray
    index: np.ndarray
    parent: np.ndarray
    levels: list[np.ndarray]
    page: np.ndarray


def forest(trees: list[Tree]) -> Forest:
    n = sum(len(t.tag) for t in trees)
    parent, depth, page = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    tag, own, link, sign = np.empty(n, np.int64), np.empty(n), np.zeros(n), np.zeros(n)
    index: list[tuple[int, int]] = []
    hashed: dict[str, int] = {}
    a = 0
    for k, t in enumerate(trees):
        b = a + len(t.tag)
        parent[a:b] = np.array(t.parent) + a
        parent[a] = -1
        depth[a:b], page[a:b] = t.depth, k
        tag[a:b] = [_TAG.get(x, len(TAGS)) for x in t.tag]
        own[a:b] = [len(x) for x in t.text]
        link[a:b] = [p >= 0 and t.tag[p] == "a" for p in t.parent]
        sign[a:b] = [x.count(".") + x.count(",") + x.count("!") + x.count("?") if x else 0 for x in t.text]
        for i, names in enumerate(t.names):
            if names:
                for w in re.split(r"[^a-z]+", names):
                    if w:
                        index.append((a + i, hashed.setdefault(w, zlib.crc32(w.encode()) % WORDS)))
        a = b
    sub, linked = own.copy(), own * link
    order = np.argsort(-depth, kind="stable")
    levels = [order[s:e] for s, e in zip(*_runs(depth[order]), strict=True)]
    for level in levels[:-1] if len(levels) else []:
        up = parent[level]
        ok = up >= 0
        np.add.at(sub, up[ok], sub[level[ok]])
        np.add.at(linked, up[ok], linked[level[ok]])
    # Sparse one-hot features as column indices; the last columns are numbers.
    above = np.where(parent >= 0, tag[np.maximum(parent, 0)], len(TAGS))
    numbers = np.column_stack((np.ones(n), np.log1p(own) / 4, np.log1p(sub) / 6, linked / np.maximum(sub, 1), np.minimum(depth, 12) / 6, sign / np.maximum(own, 1) * 10, own > 0))
    x = np.zeros((n, WIDTH), np.float32)
    row = np.arange(n)
    x[row, tag] = 1
    x[row, len(TAGS) + 1 + above] = 1
    if index:
        r, c = np.array(index).T
        x[r, 2 * (len(TAGS) + 1) + c] = 1
    x[:, -7:] = numbers
    return Forest(x, tag, parent, levels, page)


def _runs(sorted_keys: np.ndarray) -> tuple[list[int], list[int]]:
    first = tv.starts_of(sorted_keys)
    return first.tolist(), np.append(first[1:], len(sorted_keys)).tolist() if len(first) else []


def _lse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def sum_product(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact marginals of every node (n x 2) and of every node with its parent (n x 2 x 2, parent first; zero at roots). unary: n x 2, pair: 2 x 2, logarithmic."""
    up = unary.astype(float).copy()  # own potential plus the messages of the children
    msg = np.zeros_like(up)
    for level in f.levels:  # deepest first
        m = _lse(up[level, None, 0] + pair[None, :, 0], up[level, None, 1] + pair[None, :, 1])
        msg[level] = m
        parent = f.parent[level]
        ok = parent >= 0
        np.add.at(up, parent[ok], m[ok])
    belief = up.copy()
    both = np.zeros((len(up), 2, 2))
    for level in reversed(f.levels):
        parent = f.parent[level]
        ok = parent >= 0
        node, parent = level[ok], parent[ok]
        # What the parent believes without this child, then its message down.
        outside = belief[parent] - msg[node]
        joint = outside[:, :, None] + pair[None] + up[node][:, None, :]
        joint -= np.logaddexp.reduce(joint.reshape(len(node), 4), axis=1)[:, None, None] if len(node) else 0
        both[node] = np.exp(joint)
        belief[node] = up[node] + _lse(outside[:, None, 0] + pair[None, 0, :], outside[:, None, 1] + pair[None, 1, :])
    belief -= np.logaddexp.reduce(belief, axis=1)[:, None]
    return np.exp(belief), both


@dataclass(frozen=True)
class HtmlModel:
    weights: np.ndarray
    pair: np.ndarray
    pages: int

    def marginals(self, f: Forest) -> np.ndarray:
        unary = np.column_stack((np.zeros(len(f.x)), f.x @ self.weights))
        return sum_product(f, unary, self.pair)[0][:, 1]


def labels_of(t: Tree, content: str) -> np.ndarray:
    """1, 0 or -1 (not known) for every node: the pieces of a line of text that is a line of the content are content, those of other lines aren't."""
    known = {_SPACE.sub(" ", x).strip() for x in content.split("\n")} - {""}
    y = np.full(len(t.text), -1)
    for nodes, text in lines(t, [i for i, x in enumerate(t.text) if x]):
        y[nodes] = text in known
    return y


def fit(trees: list[Tree], contents: list[str], p: HtmlParams) -> HtmlModel:
    """Gradient ascent (Adam) on the conditional likelihood: statistics with the labels clamped minus those without."""
    if not trees:
        return HtmlModel(np.zeros(WIDTH), np.zeros((2, 2)), 0)
    f = forest(trees)
    y = np.concatenate([labels_of(t, c) for t, c in zip(trees, contents, strict=True)])
    w, pair = np.zeros(WIDTH), np.zeros((2, 2))
    clamp = np.zeros((len(y), 2))
    clamp[y == 0, 1] = -60
    clamp[y == 1, 0] = -60
    m = [np.zeros(WIDTH), np.zeros((2, 2))]
    s = [np.zeros(WIDTH), np.zeros((2, 2))]
    for step in range(1, p.epochs + 1):
        unary = np.column_stack((np.zeros(len(y)), f.x @ w))
        free, free2 = sum_product(f, unary, pair)
        held, held2 = sum_product(f, unary + clamp, pair)
        grads = [f.x.T @ (held[:, 1] - free[:, 1]) / len(trees) - p.ridge * w, (held2 - free2).sum(0) / len(trees) - p.ridge * pair]
        for k, (v, g) in enumerate(((w, grads[0]), (pair, grads[1]))):
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            v += p.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return HtmlModel(w, pair, len(trees))


def train(pages: DataFrame, labelled: DataFrame, p: HtmlParams = HtmlParams()) -> HtmlModel:
    """Fit on at most ``max_train_pages`` of the labelled pages: labelled has (page_id, content), the text that a person would extract.

    Rows with a null page_id, html or content don't count. The few hundred pages are fitted on the driver.
    """
    some = labelled.select(F.col("page_id").alias("_id"), F.col("content").cast("string").alias("content")).where("_id is not null and content is not null")
    some = some.groupBy("_id").agg(F.min("content").alias("content")).join(pages.select(F.col("page_id").alias("_id"), F.col("html").cast("string").alias("html")).where("html is not null"), "_id")
    rows = some.orderBy(F.xxhash64("_id"), "_id", "html").limit(p.max_train_pages).collect()
    return fit([parse(r["html"]) for r in rows], [r["content"] for r in rows], p)


def content_of(trees: list[Tree], model: HtmlModel, p: HtmlParams) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Extracted text of every page, how many nodes have text, and how many of these are content."""
    f = forest(trees)
    prob = model.marginals(f)
    out, texts, chosen, a = [], [], [], 0
    for t in trees:
        q = prob[a : a + len(t.tag)]
        a += len(t.tag)
        have = [i for i, x in enumerate(t.text) if x]
        take = [i for i in have if q[i] >= p.threshold - 1e-9]
        out.append("\n".join(x for _, x in lines(t, take)))
        texts.append(len(have))
        chosen.append(len(take))
    return out, np.array(texts, np.int64), np.array(chosen, np.int64)


def extracted(pages: DataFrame, labelled: DataFrame, p: HtmlParams = HtmlParams()) -> DataFrame:
    """(page_id, text, text_nodes, content_nodes) of every row of pages (page_id, html).

    text has the content's pieces of text in document order; inline elements don't break a line, blocks and br do. A null or empty html
    gives an empty text and no nodes; a page of any size or depth is parsed whole, in linear time; repeated rows and null ids are
    kept; a marginal equal to the threshold is content; an empty table gives an empty result; other columns are not read. Without
    labelled pages every marginal is 1/2 and all text is taken.
    """
    model = train(pages, labelled, p)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = tv.strings(b.column("html"))
            for i, j in tv.chunks(column, 1 << 20):
                trees = [parse(s) for s in column.slice(i, j - i).to_pylist()]
                text, have, take = content_of(trees, shared.value, p)
                yield pa.RecordBatch.from_arrays([b.column("page_id").slice(i, j - i), pa.array(text, pa.string()), pa.array(have), pa.array(take)], ["page_id", "text", "text_nodes", "content_nodes"])

    return pages.select("page_id", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, text string, text_nodes long, content_nodes long")
