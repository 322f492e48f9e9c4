"""Main text of web pages by a tree-structured graphical model over the DOM."""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_REST = re.compile(r"""((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|aria-label|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_LABEL = re.compile(r' data-label="([01])"')
_DEEPEST = 500  # open elements; what is nested deeper writes to the element it is in, as in browsers
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s")

#: Elements of HTML by how they are laid out and nested.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg iframe textarea select option button title head canvas object math".split())
_TO_END = frozenset("script style textarea title".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var img br wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS_WITH_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TEXTUAL = frozenset("p li h1 h2 h3 h4 h5 h6 ul ol dl dt dd tr td th tbody thead blockquote pre figcaption".split())
_SCOPES = frozenset("ul ol dl table body html".split())
_CELLS = frozenset("td th table article body".split())

#: Words in class, id and role attributes that speak against or for main text.
_AGAINST = {
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs toc pager pagination tabs toolbar skip",
    "frame": "header masthead banner footer foot copyright legal topbar sitefooter siteheader credits colophon",
    "side": "sidebar side aside widget related recommended recommendations trending popular more rail complementary",
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promotion promoted adsense affiliate",
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr newsletter subscribe signup paywall warning message dialog",
    "social": "share sharing social follow like tags meta byline author",
    "comment": "comment comments reply replies respond discussion disqus responses reader",
    "form": "form search login register contact feedback survey poll",
}
_FOR = frozenset("article content post entry story main text body maincontent articlebody postcontent prose copy".split())
_CLASS_OF = {w: k for k, words in _AGAINST.items() for w in words.split()}
_GROUPS = {t: t for t in "article main section div p nav header footer aside form li blockquote pre body html figure table dialog address".split()}
_GROUPS |= {f"h{i}": "heading" for i in range(1, 7)} | {t: "list" for t in ("ul", "ol", "dl", "menu")} | {t: "item" for t in ("dt", "dd")}
_GROUPS |= {t: "cell" for t in ("td", "th", "tr", "tbody", "thead")} | {t: "form" for t in ("fieldset", "legend", "label")} | {"figcaption": "figure"}


class Page:
    """Block elements of a page as a tree, and its text runs in page order.

    The time is linear in the page: a tag whose quotes do not close ends at the next ``>``, and from there
    on quotes are not minded; closing tags known to be missing are not sought again; nesting is bounded.
    ``labelled`` pages are those this module writes; no label is read from others.
    """

    __slots__ = ("parent", "depth", "feats", "kind", "labels", "runs")

    def __init__(self, html: str, labelled: bool = False):
        self.parent, self.depth, self.labels, self.runs = [-1], [0], [None], []
        info: list[list] = [["root", (), 0, 0, False, False]]  # tag, name classes, words, words in links, sentence end, inside an article
        stack: list[tuple[str, int]] = [("root", 0)]  # open elements and the block each writes to
        at, links, held = 0, 0, []
        minded, unclosed, beyond = True, set(), {}  # beyond: elements too deep to open, by tag

        def flush():
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                block = stack[-1][1]
                self.runs.append((block, text))
                mine = info[block]
                mine[2] += text.count(" ") + 1
                mine[4] |= text[-1] in ".!?:;\"'”»…)"

        places: dict[str, list[int]] = {"root": [0]}  # where in the stack each tag is open
        blocks, cells = [0], []  # where elements are that are not inline, and those that inline ends do not cross

        def open_(tag: str, node: int):
            places.setdefault(tag, []).append(len(stack))
            if tag not in _INLINE:
                blocks.append(len(stack))
            if tag in _CELLS:
                cells.append(len(stack))
            stack.append((tag, node))

        def close(depth: int):
            nonlocal links
            while len(stack) > depth:
                tag, _ = stack.pop()
                places[tag].pop()
                links -= tag == "a"
            for kept in (blocks, cells):
                while kept and kept[-1] >= depth:
                    kept.pop()

        def last(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=-1)

        while True:
            m = _TOKEN.search(html, at)
            raw = html[at : m.start() if m else len(html)]
            if raw:
                held.append(unescape(raw))
                if links:
                    info[stack[-1][1]][3] += len(raw.split())
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            rest = _REST.match(html, at) if minded else None
            if rest:
                attributes, at = rest[1], rest.end()
            else:
                minded, end = False, html.find(">", at)
                if end < 0:  # no tag any more
                    held.append(unescape(html[m.start() :]))
                    break
                attributes, at = html[at:end], end + 1
            tag = m[2].lower()
            if m[1]:
                if beyond.get(tag):
                    beyond[tag] -= 1
                    continue
                i = last((tag,))
                if i > 0 and not (tag in _INLINE and cells and cells[-1] > i):
                    if tag not in _INLINE:
                        flush()
                    close(i)
                continue
            if tag in _RAW:
                if tag != "head" and not attributes.endswith("/") and tag not in unclosed:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    at = end.end() if end else len(html) if tag in _TO_END else at
                    if not end:
                        unclosed.add(tag)
                if tag != "head":
                    held.append(" ")
                continue
            if tag in _INLINE:
                if tag == "br":
                    held.append(" ")
                elif tag not in _VOID:
                    if len(stack) >= _DEEPEST:
                        beyond[tag] = beyond.get(tag, 0) + 1
                        continue
                    links += tag == "a"
                    open_(tag, stack[-1][1])
                continue
            flush()
            if tag in _VOID:
                continue
            if tag in _ENDS_WITH_LIKE:
                if (i := last(_ENDS_WITH_LIKE[tag])) > last(_SCOPES):
                    close(i)
            elif tag in _CLOSES_P and stack[blocks[-1]][0] == "p":
                close(blocks[-1])
            names, label, hidden = [], None, False
            if labelled and (found := _LABEL.search(attributes)):
                label = int(found[1])
            if attributes:
                for a in _ATTR.finditer(attributes):
                    value = (a[2] or "").strip("\"'")
                    if a[1].lower() == "hidden":
                        hidden = True
                    else:
                        names += [w.lower() for w in _NAME.findall(value)]
            if len(stack) >= _DEEPEST:
                beyond[tag] = beyond.get(tag, 0) + 1
                continue
            classes = {_CLASS_OF[w] for w in names if w in _CLASS_OF} | ({"for"} if any(w in _FOR for w in names) else set()) | ({"hidden"} if hidden else set())
            above = stack[-1][1]
            node = len(self.parent)
            self.parent.append(above)
            self.depth.append(self.depth[above] + 1)
            self.labels.append(label)
            info.append([tag, tuple(sorted(classes)), 0, 0, False, info[above][5] or info[above][0] in ("article", "main")])
            open_(tag, node)
        flush()
        self.feats = [_features(*x) for x in info]
        self.kind = [int(x[0] in _TEXTUAL) for x in info]  # text elements go with their parent more than boxes do


def _features(tag: str, classes: tuple, words: int, linked: int, ends: bool, inside: bool) -> tuple[str, ...]:
    group = _GROUPS.get(tag, "other")
    size = "none" if not words else "few" if words < 4 else "some" if words < 11 else "many" if words < 26 else "long"
    out = [f"tag={group}", f"size={size}", *(f"name={c}" for c in classes)]
    if inside:
        out.append("inside")
        if group in ("header", "footer", "aside", "heading"):
            out.append(f"inside {group}")
    if words:
        share = linked / words
        out.append("links=none" if not linked else "links=some" if share < 0.5 else "links=most")
        if ends:
            out.append("ends")
    return tuple(out)


class Forest:
    """Pages laid end to end, for message passing level by level."""

    def __init__(self, pages: list[Page], index: dict[str, int], grow: bool = False):
        sizes = [len(p.parent) for p in pages]
        base = np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64), sizes) if pages else np.zeros(0, np.int64)
        parent = np.array([x for p in pages for x in p.parent], np.int64)
        self.n, self.parent = len(parent), np.where(parent < 0, -1, parent + base)
        depth = np.array([x for p in pages for x in p.depth], np.int64)
        rows, cols, at = [], [], 0
        for p in pages:
            for feats in p.feats:
                for f in feats:
                    i = index.setdefault(f, len(index)) if grow else index.get(f, -1)
                    if i >= 0:
                        rows.append(at)
                        cols.append(i)
                at += 1
        self.rows, self.cols = np.array(rows, np.int64), np.array(cols, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if self.n else []
        self.kind = np.array([k for p in pages for k in p.kind], np.int64)

    def marginals(self, weights: np.ndarray, bias: float, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum-product. ``pair[t, x, y]`` is the log potential of parent x and child y of kind t. Gives P(node = 1),
        and P(parent, child) of each node with a parent (four columns, in node order)."""
        score = np.bincount(self.rows, weights[self.cols], self.n) + bias if len(self.rows) else np.full(self.n, bias)
        inner = np.stack([np.zeros(self.n), score], 1)  # a node's own score and what its children send
        up = np.zeros((self.n, 2))
        for level in self.levels[:0:-1]:
            own = pair[self.kind[level]]
            up[level] = np.logaddexp(own[:, :, 0] + inner[level, :1], own[:, :, 1] + inner[level, 1:])
            np.add.at(inner, self.parent[level], up[level])
        belief = inner.copy()
        edges = np.zeros((self.n, 2, 2))
        for level in self.levels[1:]:
            rest = belief[self.parent[level]] - up[level]
            joint = rest[:, :, None] + pair[self.kind[level]] + inner[level][:, None, :]
            edges[level] = joint
            belief[level] = np.logaddexp(joint[:, 0], joint[:, 1])
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))
        has = self.parent >= 0
        e = np.exp(edges[has] - edges[has].max((1, 2), keepdims=True))
        return p, e / e.sum((1, 2), keepdims=True)


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    """Synthetic pages whose elements carry ``data-label``: 1 for main text and what encloses it.

    Layouts mix semantic elements with plain ``div`` and names, and leave out tags that browsers add.
    """
    r = random.Random(seed)
    syllables = "ba ne ti lor sa mi du ke ron el ast on de fi gu pra".split()

    def words(lo: int, hi: int, end: str = "") -> str:
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))) + end

    def sentences(k: int) -> str:
        return " ".join(words(4, 16, r.choice(".  .!?").strip() or ".").capitalize() for _ in range(k))

    def el(tag: str, y: int, body: str, names: str = "", closed: bool = True) -> str:
        return f'<{tag} data-label="{y}"' + (f' {r.choice(("class", "id"))}="{names}"' if names else "") + f">{body}" + (f"</{tag}>" if closed else "")

    def name(kind: str) -> str:
        w = r.choice(_AGAINST[kind].split())
        return r.choice((w, f"{w} box", f"site-{w}", f"{w}-{r.randint(1, 9)}"))

    def links(y: int = 0, names: str = "") -> str:
        return el("ul", y, "".join(el("li", y, f'<a href="/x">{words(1, 3)}</a>', closed=r.random() > 0.2) for _ in range(r.randint(2, 8))), names)

    def paragraph() -> str:
        body = sentences(r.randint(1, 6))
        if r.random() < 0.2:
            body += f' <a href="#">{words(1, 3)}</a> {words(2, 6, ".")}'
        if r.random() < 0.15:
            body = f"<b>{words(2, 12)}</b><br>{body}"
        if r.random() < 0.2:
            body = words(1, 5, r.choice(("", ".", "!", "?")))
        elif r.random() < 0.05:
            body = words(10, 90)
        return el("p", 1, body, closed=r.random() > 0.15)

    def article() -> str:
        title = el("h1", 1, words(1, 9) if r.random() < 0.8 else words(9, 40, r.choice(("", "."))))
        if r.random() < 0.15:
            title = el("header", 1, title)
        parts = [title] if r.random() < 0.9 else []
        for _ in range(r.choice((1, 1, 2, 3, 4, 5, 6, 7, 9, 14))):
            kind = r.random()
            if kind < 0.72:
                parts.append(paragraph())
            elif kind < 0.82:
                parts.append(el(r.choice(("h2", "h3")), 1, words(1, 6)))
            elif kind < 0.88:
                parts.append(el(r.choice(("ul", "ol")), 1, "".join(el("li", 1, words(1, 14, r.choice(("", ".")))) for _ in range(r.randint(2, 5)))))
            elif kind < 0.92:
                parts.append(el("blockquote", 1, r.choice((paragraph(), sentences(2)))))
            elif kind < 0.95:
                parts.append(el(r.choice(("pre", "div")), 1, words(5, 30)))
            elif kind < 0.97:
                parts.append(el("table", 1, "".join(el("tr", 1, el("td", 1, words(1, 4)) + el("td", 1, words(1, 6))) for _ in range(3))))
            else:
                parts.append(junk(r.choice(("advert", "side", "social"))))
        body = "".join(parts)
        how = r.random()
        if how < 0.45:
            return el("article", 1, body)
        if how < 0.6:
            return el("main", 1, el("article", 1, body) if r.random() < 0.5 else body)
        return el(r.choice(("div", "section")), 1, body, r.choice(("content", "post", "entry-content", "main", "story", "article-body", "post-body", "text", "")))

    def junk(kind: str) -> str:
        tag = r.choice(("div", "div", "section"))
        if kind == "menu":
            how = r.random()
            return el("nav", 0, links()) if how < 0.5 else el(tag, 0, links(), name(kind)) if how < 0.75 else links(0, name(kind))
        if kind == "frame":
            low = r.random() < 0.5
            body = r.choice((f"&copy; {words(1, 6, '.')}", words(1, 5), el("p", 0, sentences(1)), links()))
            named = name(kind) if r.random() < 0.5 else ""
            return el("footer" if low else "header", 0, body, named) if r.random() < 0.7 else el(tag, 0, body, name(kind))
        if kind == "comment":
            one = lambda: el(r.choice(("div", "li")), 0, el("p", 0, sentences(r.randint(1, 4))), name(kind))
            return el(r.choice(("section", "div")), 0, el("h3", 0, words(1, 2)) + "".join(one() for _ in range(r.randint(1, 5))), r.choice(("comments", "discussion", "comment-list")))
        if kind == "form":
            return el("form", 0, f"<label>{words(1, 3)}</label><input>" + el("p", 0, sentences(1)), name(kind) if r.random() < 0.5 else "")
        body = r.choice((sentences(r.randint(1, 3)), el("p", 0, sentences(r.randint(1, 6))), words(1, 9), el("p", 0, words(1, 15)), el("h3", 0, words(1, 3)) + links(), el("p", 0, sentences(1)) + el("p", 0, sentences(2))))
        if kind == "side" and r.random() < 0.6:
            return el("aside", 0, body, name(kind) if r.random() < 0.5 else "")
        if kind == "notice" and r.random() < 0.2:
            return el("dialog", 0, body)
        return el(tag, 0, body, name(kind))

    pages = []
    for _ in range(n):
        before = [junk(k) for k in ("menu", "frame", "advert", "notice", "side", "form") if r.random() < 0.5]
        after = [junk(k) for k in ("side", "advert", "comment", "frame", "social", "form", "menu", "notice") if r.random() < 0.45]
        r.shuffle(before)
        inner = "".join([*before, article(), *after])
        if r.random() < 0.3:
            inner = el("div", 1, inner, r.choice(("wrapper", "page", "container")))
        pages.append(f'<html data-label="1"><head><title>{words(2, 5)}</title></head><body data-label="1">{inner}</body></html>')
    return pages


@functools.lru_cache(maxsize=4)
def train(pages: int = 600, seed: int = 7, rounds: int = 250, l2: float = 0.5) -> tuple[dict[str, int], np.ndarray, float, np.ndarray]:
    """Feature weights, bias and parent-child potentials of greatest likelihood on labelled pages."""
    found = [Page(h, labelled=True) for h in labelled_pages(pages, seed)]
    index: dict[str, int] = {}
    forest = Forest(found, index, grow=True)
    y = np.array([1 if v is None else v for p in found for v in p.labels], float)
    has = forest.parent >= 0
    up, down, kind = y[forest.parent[has]].astype(int), y[has].astype(int), forest.kind[has]
    seen, expected = np.zeros((2, 2, 2)), np.zeros((2, 2, 2))
    np.add.at(seen, (kind, up, down), 1)
    params = np.zeros(len(index) + 9)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        w, bias, pair = params[:-9], params[-9], params[-8:].reshape(2, 2, 2)
        p, e = forest.marginals(w, bias, pair)
        expected[0], expected[1] = e[kind == 0].sum(0), e[kind == 1].sum(0)
        grad = np.concatenate((np.bincount(forest.cols, (y - p)[forest.rows], len(index)), [(y - p).sum()], (seen - expected).ravel())) - l2 * params
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        params = params + 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return index, params[:-9], float(params[-9]), params[-8:].reshape(2, 2, 2)


def _extract(model: tuple):
    index, weights, bias, pair = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            column = batch.column(2)
            for at in range(0, len(column), 256):
                pages = [Page(x.as_py() or "") for x in column[at : at + 256]]
                p, _ = Forest(pages, index).marginals(weights, bias, pair)
                start = 0
                for page in pages:
                    texts.append(" ".join(t for node, t in page.runs if p[start + node] >= 0.5))
                    start += len(page.parent)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Block elements are nodes of a tree; their marginal chance to be main text comes from messages sent
    up and down it. Text of likely blocks is kept in page order, white space made single, joined by one
    space. Null or empty html, and pages without likely blocks, give an empty text. Rows with null or
    equal ids are read each on its own. A page is read whole, however long, in time linear in its length. An
    empty table gives an empty table; other columns are ignored, whatever their names.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract(train()), f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long")
