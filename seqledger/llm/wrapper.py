"""Main text of web pages by wrapper induction.

For every host the trees of all its pages are aligned with that of one of them by simple tree
matching: nodes that nine tenths of the pages share, text included, are template, the others are
slots. The element that holds the slots' text is the content root of the host's wrapper. A page is aligned with its
host's wrapper; its text is what stands in the aligned root, without elements whose role is not
the article (menus, forms, notices, comments, ...) and without template text beside the root.
"""

from __future__ import annotations

import html as entities
import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Wrappers that are sent to all tasks, and bytes of them.
BROADCAST_HOSTS, BROADCAST_BYTES = 20_000, 32_000_000
#: Open elements at most; deeper ones are taken as siblings. Larger tables of children are worked
#: out row by row, of which few are kept.
DEPTH, TABLE = 150, 250_000

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split())
RAW = {"script", "style", "textarea", "title", "xmp", "noframes", "iframe"}
#: Elements whose text is never the article's.
SKIP = RAW | set(
    "head nav header footer aside form noscript template button select option input label fieldset object embed canvas svg "
    "math audio video dialog menu".split())
#: Start tags that end an open element of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"html", "body", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Words of class, id and role values that mark other parts than the article.
ROLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|"
    r"sidebar|aside|nav|navbar|navigation|menu|breadcrumbs?|footer|header|masthead|toolbar|share|social|related|recommend\w*|"
    r"comments?|replies|respond|discussion|pagination|pager|widget|search|login|signup|complementary|contentinfo|hidden)(?:$|[\s_-])", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@dataclass
class Node:
    """An element, or a text when ``tag`` is empty."""

    tag: str
    text: str = ""
    role: bool = False
    children: list[Node] = field(default_factory=list)
    shape: int = 0
    kind: int = 0
    size: int = 1


def parse(page: str) -> Node:
    """The element tree of a page; end tags that are missing or too many are made good."""
    root = Node("#page")
    open_ = [root]
    at = 0

    def text(end: int) -> None:
        if end > at:
            piece = page[at:end]
            if not piece.isspace():
                open_[-1].children.append(Node("", entities.unescape(piece)))
            elif open_[-1].children:
                open_[-1].children.append(Node("", " "))

    while True:
        m = TAG.search(page, at)
        if m is None:
            text(len(page))
            break
        text(m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth].tag == tag:
                    del open_[depth:]
                    break
            continue
        inside = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        for depth in range(len(open_) - 1, 0, -1):
            if open_[depth].tag in inside:
                del open_[depth:]
                break
            if open_[depth].tag in BLOCK:
                break
        marks = ATTRIBUTE.findall(m[3]) if m[3] else []
        values = [(k.lower(), a or b or c) for k, a, b, c in marks]
        role = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k in ("class", "id", "role") and ROLE.search(v)) for k, v in values)
        node = Node(tag, role=bool(role) and tag not in ("html", "body", "article", "main"))
        open_[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
        if tag not in VOID and not m[3].endswith("/") and len(open_) < DEPTH:
            open_.append(node)
    _measure(root)
    return root


def _measure(root: Node) -> None:
    """Shape (a hash of the element tree), kind (one of the tree with its roles) and number of
    elements of every node."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.children
    for node in reversed(order):
        inner = [c for c in node.children if c.tag]
        node.shape = hash((node.tag, *(c.shape for c in inner)))
        node.kind = hash((node.tag, node.role, *(c.kind for c in inner)))
        node.size = 1 + sum(c.size for c in inner)


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of nodes of the greatest matching of two trees that keeps order and ancestors.

    Simple tree matching: roots must agree; the children of a pair are matched in order, for the
    greatest sum of their own matchings. Trees of one shape match node by node. Tables of many
    children are worked out row by row, with the same result.
    """
    weights: dict[tuple[int, int], int] = {}

    def weight(p: Node, q: Node) -> int:
        if p.tag != q.tag or p.role != q.role:
            return 0
        if p.shape == q.shape:
            return p.size
        key = (p.kind, q.kind)
        if key not in weights:
            x, y = [c for c in p.children if c.tag], [c for c in q.children if c.tag]
            weights[key] = 1 + _greatest(x, y, weight)
        return weights[key]

    pairs, todo = [], [(a, b)] if weight(a, b) else []
    while todo:
        p, q = todo.pop()
        pairs.append((p, q))
        x, y = [c for c in p.children if c.tag], [c for c in q.children if c.tag]
        todo += zip(x, y, strict=True) if p.shape == q.shape else _matched(x, y, weight)
    return pairs


Weight = Callable[[Node, Node], int]


def _alike(p: Node, q: Node) -> bool:
    return p.tag == q.tag and p.role == q.role and p.shape == q.shape


def _greatest(x: list[Node], y: list[Node], weight: Weight) -> int:
    """Greatest sum of weights of children matched in order. Like ones at either end match, as
    neither could weigh more with another."""
    total, start, i, j = 0, 0, len(x), len(y)
    while i and j and _alike(x[i - 1], y[j - 1]):
        i, j = i - 1, j - 1
        total += x[i].size
    while start < min(i, j) and _alike(x[start], y[start]):
        total += x[start].size
        start += 1
    x, y = x[start:i], y[start:j]
    if not x or not y:
        return total
    if len(x) * len(y) <= TABLE:
        return total + _table(x, y, weight)[-1][-1]
    step, row = _steps(y, weight), np.zeros(len(y) + 1, np.int64)
    for p in x:
        row = step(row, p)
    return total + int(row[-1])


def _table(x: list[Node], y: list[Node], weight: Weight) -> list[list[int]]:
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x, 1):
        row, above = m[i], m[i - 1]
        for j, q in enumerate(y, 1):
            row[j] = max(above[j], row[j - 1], above[j - 1] + weight(p, q))
    return m


def _steps(y: list[Node], weight: Weight) -> Callable[[np.ndarray, Node], np.ndarray]:
    """The row of the table that follows a row; nodes of one kind have one weight."""
    firsts = {q.kind: q for q in reversed(y)}
    place = {k: i for i, k in enumerate(firsts)}
    at = np.array([place[q.kind] for q in y])
    known: dict[int, np.ndarray] = {}

    def step(above: np.ndarray, p: Node) -> np.ndarray:
        if p.kind not in known:
            if len(known) >= 100:
                known.clear()
            known[p.kind] = np.array([weight(p, q) for q in firsts.values()], np.int64)
        out = above.copy()
        np.maximum(out[1:], above[:-1] + known[p.kind][at], out=out[1:])
        return np.maximum.accumulate(out)

    return step


def _matched(x: list[Node], y: list[Node], weight: Weight) -> list[tuple[Node, Node]]:
    """The pairs behind the greatest sum, found from the last children on."""
    out, i, j = [], len(x), len(y)
    while i and j and _alike(x[i - 1], y[j - 1]):
        i, j = i - 1, j - 1
        out.append((x[i], y[j]))
    if not i or not j:
        return out
    x, y = x[:i], y[:j]
    if len(x) * len(y) <= TABLE:
        blocks = [(0, _table(x, y, weight))]
    else:
        blocks = _blocks(x, y, weight)
    for start, m in blocks:
        while i > start and j:
            row, above = m[i - start], m[i - start - 1]
            w = weight(x[i - 1], y[j - 1])
            if w and row[j] == above[j - 1] + w:
                i, j = i - 1, j - 1
                out.append((x[i], y[j]))
            elif row[j] == above[j]:
                i -= 1
            else:
                j -= 1
    return out


def _blocks(x: list[Node], y: list[Node], weight: Weight) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The table in blocks of rows with the number of their first one, the last block first. Of
    the whole table only the first row of each block is kept."""
    step, size = _steps(y, weight), math.isqrt(len(x)) + 1
    row, firsts = np.zeros(len(y) + 1, np.int64), []
    for i, p in enumerate(x):
        if i % size == 0:
            firsts.append(row)
        row = step(row, p)
    for k in range(len(firsts) - 1, -1, -1):
        rows = [firsts[k]]
        for p in x[k * size : (k + 1) * size]:
            rows.append(step(rows[-1], p))
        yield k * size, rows


def _own(node: Node) -> str:
    """Direct text of an element, white space made even."""
    return " ".join(" ".join(c.text for c in node.children if not c.tag).split())


def _skipped(node: Node) -> bool:
    return node.tag in SKIP or node.role


@dataclass
class Wrapper:
    """The tree of one page of the host, its content root, and its template nodes."""

    tree: Node
    root: int
    template: set[int]


def _numbered(tree: Node) -> list[Node]:
    """Elements in page order."""
    out, stack = [], [tree]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if c.tag]
    return out


def _volumes(tree: Node, constant: set[int]) -> dict[int, int]:
    """Characters of slot text in each element, without the parts that are never the article."""
    out: dict[int, int] = {}
    for node in reversed(_numbered(tree)):
        if _skipped(node):
            out[id(node)] = 0
            continue
        own = 0 if id(node) in constant else len(_own(node))
        out[id(node)] = own + sum(out[id(c)] for c in node.children if c.tag)
    return out


def _content_root(tree: Node, constant: set[int]) -> Node:
    """The article or main element if there is just one; else the deepest element with nine tenths
    of the slot text, which is not a block of its own."""
    nodes = _numbered(tree)
    for tag in ("article", "main"):
        named = [n for n in nodes if n.tag == tag]
        if len(named) == 1:
            return named[0]
    volume = _volumes(tree, constant)
    at = tree
    while True:
        inner = [c for c in at.children if c.tag and not _skipped(c)]
        best = max(inner, key=lambda c: volume[id(c)], default=None)
        if best is None or not volume[id(at)] or 10 * volume[id(best)] < 9 * volume[id(at)] or best.tag in ("p", "pre", "table", "ul", "ol", "blockquote"):
            return at
        at = best


def shared_nodes(first: Node, page: str) -> list[int]:
    """Numbers of the elements of ``first`` whose text stands in the page too."""
    at = {id(n): i for i, n in enumerate(_numbered(first))}
    return sorted(at[id(p)] for p, q in align(first, parse(page)) if (own := _own(p)) and own == _own(q))


def _template(counts: dict[int, int], pages: int) -> set[int]:
    """Numbers of the elements that nine tenths of the pages share; one page has no template."""
    return {i for i, n in counts.items() if 10 * n >= 9 * pages} if pages > 1 else set()


def wrapper_of(first: Node, template: set[int]) -> Wrapper:
    nodes = _numbered(first)
    root = _content_root(first, {id(nodes[i]) for i in template})
    return Wrapper(first, next(i for i, n in enumerate(nodes) if n is root), template)


def induce(pages: list[str]) -> Wrapper:
    """The wrapper of pages of one host; equal pages count once."""
    pages = list(dict.fromkeys(pages))
    first = parse(pages[0])
    counts = Counter(i for page in pages for i in shared_nodes(first, page))
    return wrapper_of(first, _template(counts, len(pages)))


def extract(page: str | None, wrapper: Wrapper | None) -> str:
    """The main text: one line for each block, white space inside a block made single spaces."""
    if not page:
        return ""
    tree = parse(page)
    root, template = None, set()
    if wrapper is not None:
        nodes = _numbered(wrapper.tree)
        target, fixed = nodes[wrapper.root], {id(nodes[i]) for i in wrapper.template}
        for p, q in align(wrapper.tree, tree):
            if p is target:
                root = q
            if id(p) in fixed and _own(p) == _own(q):
                template.add(id(q))
    if root is None or root.tag not in ("article", "main"):
        # The page's own article goes before what the alignment says.
        own = _content_root(tree, template)
        root = own if root is None or own.tag in ("article", "main") else root
    blocks: list[list[str]] = [[]]
    # Text that all example pages share stays when the host has marked it as article.
    keep_all = root.tag in ("article", "main")
    stack: list = [root]
    while stack:
        node = stack.pop()
        if node is None:
            blocks.append([])
        elif not node.tag:
            blocks[-1].append(node.text)
        elif node.tag == "br":
            blocks[-1].append(" ")
        elif node is root or not _skipped(node):
            if not keep_all and id(node) in template and node is not root:
                continue
            if node.tag in BLOCK:
                blocks.append([])
                stack.append(None)
            stack += reversed(node.children)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def _pack(wrapper: Wrapper) -> bytes:
    """A wrapper as bytes, without the text of its slots."""
    for i, node in enumerate(_numbered(wrapper.tree)):
        if i not in wrapper.template:
            node.children = [c for c in node.children if c.tag]
    return zlib.compress(pickle.dumps(wrapper))


def _unpack(raw: bytes) -> Wrapper:
    wrapper = pickle.loads(zlib.decompress(raw))
    _measure(wrapper.tree)
    return wrapper


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Node] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            nodes = []
            for page, first in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if first not in known:
                    if len(known) >= 100:
                        known.clear()
                    known[first] = parse(first)
                nodes.append(shared_nodes(known[first], page))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.list_(pa.int32()))], ["host", "digest", "nodes"])


def _induced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [_pack(wrapper_of(parse(first), set(nodes or ()))) for first, nodes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["host", "wrapper"])


def _hosts(made: DataFrame, col: str) -> DataFrame:
    """Written rows of one host each, sent to all tasks if they are few and small."""
    n, size = made.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(col)), F.lit(0))).first()
    return F.broadcast(made) if n <= BROADCAST_HOSTS and size <= BROADCAST_BYTES else made.hint("merge")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, Wrapper] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = []
            for page, raw in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if raw is not None and raw not in known:
                    if len(known) >= 500:
                        known.clear()
                    known[raw] = _unpack(raw)
                texts.append(extract(page, None if raw is None else known[raw]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])


def host(url: str) -> F.Column:
    """Host of an address; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    The wrapper of a host is the tree of its page of the least hash, with what all its pages say
    of the template; equal pages count once. A page without url, or with an unreadable one, belongs
    to the host without a name.

    A null or empty html gives an empty text. A host with one page has no template; the page is
    read by its own tree. Rows stay one for one, null and repeated ids included; other columns are
    not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", host("url"))
    usable = rows.filter("html <> ''").select("host", "html", F.xxhash64("page_id", "html").alias("key"))
    firsts = cut(usable.groupBy("host").agg(F.min_by("html", F.xxhash64(F.lit(0), "key")).alias("first")), "firsts")
    pages_of = usable.select("host", F.md5("html").alias("digest"), "html").join(_hosts(firsts, "first"), "host")
    shares = pages_of.select("host", "digest", "html", "first").mapInArrow(_shares, "host string, digest string, nodes array<int>")
    shares = cut(shares.groupBy("host", "digest").agg(F.min("nodes").alias("nodes")), "shares")
    counted = shares.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = shares.select("host", F.explode("nodes").alias("node")).groupBy("host", "node").agg(F.count(F.lit(1)).alias("n"))
    template = counts.join(counted, "host").filter("pages > 1 AND 10 * n >= 9 * pages").groupBy("host").agg(F.collect_list("node").alias("nodes"))
    wrappers = cut(firsts.join(template, "host", "left").select("host", "first", "nodes").mapInArrow(_induced, "host string, wrapper binary"), "wrappers")
    joined = rows.join(_hosts(wrappers, "wrapper"), "host", "left")
    joined = joined.select("page_id", "url", "html", "wrapper")
    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
