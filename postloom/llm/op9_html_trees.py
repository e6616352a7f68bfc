"""Operator 9: main-text extraction with gradient-boosted trees over DOM-node features.

Every element of a page gets features: subtree text, link and punctuation density, paragraphs, tag, tokens of class, id and
role of its own and of its ancestors, depth, position among siblings and what the siblings hold. Boosted regression trees
give the log-odds that the element holds main text. Decoding is hierarchical: over the tree, the set of open elements
that maximises the summed, text-weighted log-odds is found by dynamic programming, where an element can be open only if its
parent is; so no element is kept inside one that is dropped, nor an ancestor dropped above one that is kept.

The trees are fitted here, on labelled pages that a generator writes (many layouts of article, menus, headers, footers, sidebars,
notices, adverts, forms and comments); no page of the input is used, and the fit is the same on every run.

Text of open elements: character references decoded, white space of a block turned into one space and trimmed, blocks joined
in page order by one space. Null, empty and text-free pages give an empty text. Repeated rows get equal texts; other columns are
not read. One narrow stage, no shuffle.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo
from .html_tree import BLOCK, RAW, Node, attributes, parse

_TAGS = ["article", "main", "section", "div", "p", "h", "li", "list", "nav", "header", "footer", "aside", "form", "table", "quote", "figure", "inline", "body", "link", "other"]
_TAG_OF = {
    **{t: _TAGS.index(t) for t in ("article", "main", "section", "div", "p", "li", "nav", "header", "footer", "aside", "form", "body")},
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 5), **dict.fromkeys(("ul", "ol", "dl", "menu"), 7), **dict.fromkeys(("fieldset", "button", "label", "dialog"), 12),
    **dict.fromkeys(("table", "tbody", "thead", "tr", "td", "th"), 13), **dict.fromkeys(("blockquote", "pre"), 14), **dict.fromkeys(("figure", "figcaption"), 15),
    **dict.fromkeys(("b", "i", "em", "strong", "span", "u", "code", "small", "sub", "sup", "mark", "q", "cite", "time", "font", "abbr", "s", "ins", "del", "kbd"), 16), "a": 18, "html": 17, "#page": 17,
}
#: Elements whose text is never main text.
_NEVER = RAW | {"head", "button", "canvas", "audio", "video", "object", "meta", "link"}
_GROUPS = {
    "ad": "ad ads adv advert advertisement adverts sponsor sponsored promo promotion banner adbox adslot teaser offer",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager tabs toc topbar skip",
    "edge": "header masthead head footer foot bottom copyright legal logo brand site colophon imprint",
    "side": "sidebar side aside rail widget widgets related recommended recommendations popular trending more also",
    "talk": "comment comments commentlist disqus reply replies discussion respond thread reader responses feedback reviews",
    "note": "cookie cookies consent notice notices alert popup modal overlay gdpr message subscribe newsletter paywall signup disclaimer warning toast",
    "form": "form search login register input contact",
    "share": "share sharing social follow tags tag meta byline author bio date info tools",
    "body": "article content main post entry story text body prose page copy articlebody maincontent posttext",
}
_GROUP_OF = {w: i for i, words in enumerate(_GROUPS.values()) for w in words.split()}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_G = len(_GROUPS)
N_FEATURES = 26 + 3 * _G + len(_TAGS)


def _attr_groups(raw: str) -> tuple[float, ...]:
    """How often tokens of each group stand in class, id, role and label; the last number: whether it is hidden."""
    found = [0.0] * (_G + 1)
    a = attributes(raw)
    for key in ("class", "id", "role", "aria-label", "itemprop", "data-component"):
        for w in _WORDS.findall(a.get(key, "")):
            g = _GROUP_OF.get(w.lower())
            if g is not None:
                found[g] += 1
    style = a.get("style", "").replace(" ", "").lower()
    found[_G] = float("hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style)
    return tuple(found)


_groups_of = Memo(_attr_groups, 100_000)
_NO_GROUPS = (0.0,) * (_G + 1)


def node_features(nodes: list[Node]) -> np.ndarray:
    """(nodes, N_FEATURES + 2): features, then log text of the subtree and the parent's row, which decoding needs."""
    n = len(nodes)
    own, link, tags, paras, dots, words, blocks, para_text = (np.zeros(n) for _ in range(8))
    parent, depth, code = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
    groups = np.zeros((n, _G + 1))
    never = np.zeros(n, bool)
    for i, v in enumerate(nodes):
        p = v.parent.index if v.parent else 0
        parent[i], depth[i] = p, v.depth
        never[i] = v.tag in _NEVER or never[p]
        code[i] = _TAG_OF.get(v.tag, 19)
        if v.attrs:
            groups[i] = _groups_of[v.attrs]
        tags[i] = 1
        blocks[i] = v.tag in BLOCK
        paras[i] = v.tag == "p"
        if not never[i]:
            for c in v.children:
                if type(c) is str:
                    w = len(c.split())
                    if w:
                        own[i] += len(c)
                        words[i] += w
                        dots[i] += c.count(".") + c.count(",")
        if v.tag == "a":
            link[i] = 1
    in_link = link.copy()
    for i in range(1, n):
        if in_link[parent[i]]:
            in_link[i] = 1
    text, linked, anchors = own.copy(), own * in_link, link.copy()
    long_p = np.zeros(n)
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parent[i]
        text[p] += text[i]
        linked[p] += linked[i]
        anchors[p] += anchors[i]
        tags[p] += tags[i]
        blocks[p] += blocks[i]
        dots[p] += dots[i]
        words[p] += words[i]
        if code[i] == 4:
            para_text[i] = text[i]
            long_p[i] = text[i] > 80
        paras[p] += paras[i]
        para_text[p] += para_text[i] if code[p] != 4 else 0
        long_p[p] += long_p[i]
    # elders: what the ancestors' tokens and tags say
    elder = np.zeros((n, _G + 1))
    elder_tags = np.zeros((n, 8))
    marks = [("nav",), ("header",), ("footer",), ("aside",), ("form",), ("article",), ("main",), ("p", "li", "td")]
    own_tags = np.zeros((n, 8))
    for k, names in enumerate(marks):
        own_tags[:, k] = np.isin(code, [_TAG_OF[x] for x in names])
    for i in range(1, n):
        p = parent[i]
        elder[i] = elder[p] + groups[p]
        elder_tags[i] = np.maximum(elder_tags[p], own_tags[p])
    sibs, before, sib_text, sib_long = (np.zeros(n) for _ in range(4))
    np.add.at(sibs, parent[1:], 1)
    np.add.at(sib_long, parent[1:], long_p[1:])
    seen = np.zeros(n)
    for i in range(1, n):
        before[i] = seen[parent[i]]
        seen[parent[i]] += 1
    sib_text = text[parent]
    page = max(1.0, text[0])
    f = np.zeros((n, N_FEATURES + 2))
    size = np.maximum(1, text)
    f[:, 0] = np.log1p(text)
    f[:, 1] = text / page
    f[:, 2] = linked / size
    f[:, 3] = text / tags
    f[:, 4] = dots / np.maximum(1, words)
    f[:, 5] = np.log1p(paras)
    f[:, 6] = para_text / size
    f[:, 7] = np.log1p(long_p)
    f[:, 8] = np.minimum(depth, 20)
    f[:, 9] = np.minimum(sibs[parent], 50)
    f[:, 10] = before / np.maximum(1, sibs[parent])
    f[:, 11] = text / np.maximum(1, sib_text)
    f[:, 12] = np.log1p(anchors)
    f[:, 13] = np.log1p(own)
    f[:, 14] = np.minimum(words / np.maximum(1, blocks), 200)
    f[:, 15] = np.log1p(sib_long[parent])
    f[:, 16] = groups[:, _G]
    f[:, 17] = elder[:, _G] > 0
    f[:, 18:26] = elder_tags
    at = 26
    f[:, at : at + _G] = np.minimum(groups[:, :_G], 2)
    f[:, at + _G : at + 2 * _G] = np.minimum(elder[:, :_G], 2)
    f[:, at + 2 * _G : at + 3 * _G] = np.minimum(groups[parent][:, :_G], 2)
    f[np.arange(n), at + 3 * _G + code] = 1
    f[:, -2] = np.where(never, -1, np.log1p(text))
    f[:, -1] = parent
    return f


class BoostedTrees:
    """Logistic gradient boosting of depth-limited trees on feature histograms."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 10.0, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, threshold of inner nodes; leaf values

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin <= k: x <= edge k
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        total = np.full(n, self.base)
        b, inner = self.bins, 2**self.depth - 1
        offsets = np.arange(d) * b
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut, where = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                flat = ((where - first) * (d * b))[:, None] + offsets + binned
                gs = np.bincount(flat.ravel(), np.repeat(g, d), width * d * b).reshape(width, d, b).cumsum(2)
                hs = np.bincount(flat.ravel(), np.repeat(h, d), width * d * b).reshape(width, d, b).cumsum(2)
                ga, ha = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + self.l2) + (ga - gs) ** 2 / (ha - hs + self.l2) - ga**2 / (ha + self.l2)
                gain[(hs < self.least / 10) | (ha - hs < self.least / 10)] = -1
                best = gain.reshape(width, -1).argmax(1)
                for k in range(width):
                    j, c = divmod(int(best[k]), b)
                    if gain[k, j, c] > 1e-6 and c < len(edges[j]):
                        feature[first + k], cut[first + k] = j, edges[j][c]
                where = 2 * where + 1 + (x[np.arange(n), feature[where]] > cut[where])
            leaf = where - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.l2)
            total += value[leaf]
            self.model.append((feature, cut, value))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.model:
            where = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                where = 2 * where + 1 + (x[rows, feature[where]] > cut[where])
            out += value[where - len(feature)]
        return out


def decode(scores: np.ndarray, weight: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Which elements are open: the ancestor-closed set of largest weighted score. weight < 0: never open."""
    n = len(scores)
    value = scores * np.maximum(weight, 0.1)
    value[weight < 0] = -np.inf
    below = np.zeros(n)
    for i in range(n - 1, 0, -1):
        v = value[i] + below[i]
        if v > 0:
            below[parent[i]] += v
    best = value + below
    is_open = np.zeros(n, bool)
    is_open[0] = True
    for i in range(1, n):
        is_open[i] = is_open[parent[i]] and best[i] > 0
    return is_open


def page_text(nodes: list[Node], is_open: np.ndarray) -> str:
    """Texts of open elements: blocks joined by one space."""
    out: list[str] = []

    def walk(top: Node) -> None:
        stack: list[tuple[Node, int]] = [(top, 0)]
        while stack:
            v, k = stack.pop()
            block = v.tag in BLOCK
            if k == 0 and block:
                out.append(" ")
            while k < len(v.children):
                c = v.children[k]
                k += 1
                if type(c) is str:
                    out.append(c)
                elif c.index < 0 or c.tag in ("br", "hr"):
                    out.append(" ")
                elif is_open[c.index]:
                    stack.append((v, k))
                    stack.append((c, 0))
                    break
                elif c.tag in BLOCK:
                    out.append(" ")
            else:
                if block:
                    out.append(" ")

    walk(nodes[0])
    return " ".join("".join(out).split())


# --- labelled pages -------------------------------------------------------------------------------------------------


class PageWriter:
    """Writes pages whose main text is known: its elements carry the attribute data-main."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.styled = self.r.random() < 0.6  # whether elements tell their part by class or id

    def words(self, low: int, high: int) -> str:
        r = self.r
        parts = ["".join(r.choice("aeioust nrldm".replace(" ", "")) for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high))]
        for i in range(len(parts)):
            if r.random() < 0.1:
                parts[i] += r.choice(".,,.!")
        return " ".join(parts).capitalize() + r.choice([".", ".", "", "?"])

    def name(self, *choices: str) -> str:
        if not self.styled or not choices:
            return ""
        token = self.r.choice(choices)
        extra = self.r.choice(["", "", " box", " x1", " wide", " col-2"])
        return f' {self.r.choice(["class", "class", "id"])}="{token}{extra}"'

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n)]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" if self.r.random() < 0.9 else f"<li>{x}" for x in items) + "</ul>"
        return " | ".join(items)

    def nav(self) -> str:
        tag = self.r.choice(["nav", "nav", "div", "ul"])
        return f"<{tag}{self.name('nav', 'menu', 'navbar', 'breadcrumb', 'topbar')}>{self.links(self.r.randint(3, 12))}</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(["header", "header", "div"])
        inside = self.r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 8)}</p>", f"<div>{self.words(1, 5)}</div>"])
        return f"<{tag}{self.name('header', 'masthead', 'site-header', 'topbar')}>{inside}{self.nav() if self.r.random() < 0.5 else ''}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(["footer", "footer", "footer", "div"])
        attr = self.name("footer", "site-footer", "colophon") if tag == "footer" else ' class="footer"'
        inside = self.r.choice([f"&copy; {self.words(1, 4)} &middot; {self.words(4, 30)}", f"<p>{self.words(3, 20)}</p>{self.links(4)}", f"<div>{self.words(2, 10)}</div><p>{self.words(10, 40)}</p>"])
        return f"<{tag}{attr}>{inside}</{tag}>"

    def side(self) -> str:
        tag = self.r.choice(["aside", "aside", "div", "section"])
        attr = self.name("sidebar", "side", "widget", "related", "rail") if tag == "aside" else f' class="{self.r.choice(["sidebar", "widget", "related", "side-bar", "popular", "more-stories"])}"'
        inside = self.r.choice([self.links(self.r.randint(3, 8)), f"<h3>{self.words(1, 3)}</h3><p>{self.words(5, 60)}</p>", f"<h4>{self.words(1, 4)}</h4>{self.links(5)}<p>{self.words(3, 30)}</p>"])
        return f"<{tag}{attr}>{inside}</{tag}>"

    def ad(self) -> str:
        tag = self.r.choice(["div", "div", "div", "section", "p", "aside", "span"])
        attr = f' {self.r.choice(["class", "id", "class"])}="{self.r.choice(["ad", "ads", "advert", "ad-banner", "sponsored", "promo", "adslot", "banner ad", "advertisement"])}"'
        text = self.words(3, 40)
        return f"<{tag}{attr}>{text if self.r.random() < 0.6 else f'<p>{text}</p>' if tag != 'p' else text}</{tag}>"

    def note(self) -> str:
        tag = self.r.choice(["div", "div", "section", "p", "dialog"])
        attr = f' {self.r.choice(["class", "id"])}="{self.r.choice(["cookie-notice", "notice", "consent", "newsletter", "subscribe", "alert", "gdpr", "popup", "cookies", "disclaimer"])}"'
        return f"<{tag}{attr}>{self.words(6, 50)}</{tag}>"

    def form(self) -> str:
        inside = f"<label>{self.words(1, 3)}</label><input name=a><button>{self.words(1, 2)}</button>" + (f"<p>{self.words(4, 30)}</p>" if self.r.random() < 0.5 else "")
        form = f"<form{self.name('form', 'search', 'login', 'signup')}>{inside}</form>"
        return form if self.r.random() < 0.7 else f'<div class="{self.r.choice(["search", "newsletter", "contact"])}">{form}</div>'

    def comments(self) -> str:
        tag = self.r.choice(["div", "section", "ol", "ul", "aside"])
        attr = f' {self.r.choice(["class", "id"])}="{self.r.choice(["comments", "comment-list", "commentlist", "discussion", "reader-comments", "responses", "disqus"])}"'
        kind = "li" if tag in ("ol", "ul") else self.r.choice(["div", "article", "p", "section"])
        own = self.name("comment", "reply", "comment-body")
        rows = []
        for _ in range(self.r.randint(1, 6)):
            text = self.words(4, 90)
            rows.append(f"<{kind}{own}>{text if kind == 'p' or self.r.random() < 0.4 else f'<p>{text}</p>'}</{kind}>")
        head = f"<h{self.r.choice('234')}>{self.words(1, 3)}</h3>" if tag not in ("ol", "ul") and self.r.random() < 0.5 else ""
        return f"<{tag}{attr}>{head}{''.join(rows)}</{tag}>"

    def paragraph(self) -> str:
        r = self.r
        text = self.words(1, 4) if r.random() < 0.15 else self.words(8, 160)
        if r.random() < 0.2:
            half = len(text) // 2
            text = f'{text[:half]}<{(t := r.choice(["b", "em", "a href=/x", "span", "i"]))} data-main>{text[half:]}</{t.split()[0]}>'
        kind = r.random()
        if kind < 0.08:
            return f"<ul data-main><li data-main>{text}</li><li data-main>{self.words(3, 20)}</li></ul>"
        if kind < 0.12:
            return f"<blockquote data-main>{text}</blockquote>"
        if kind < 0.16:
            return f"<table data-main><tr data-main><td data-main>{self.words(1, 5)}</td><td data-main>{text}</td></tr></table>"
        if kind < 0.22:
            return f"<h{(k := r.choice('234'))} data-main>{self.words(1, 8)}</h{k}>"
        if kind < 0.25:
            return f"<pre data-main>{text}</pre>"
        return f"<p data-main>{text}" + ("</p>" if r.random() < 0.9 else "<br data-main>")

    def page(self) -> str:
        r = self.r
        body = [self.paragraph() for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14]))]
        if r.random() < 0.6:
            body[0] = f"<p data-main><b data-main>{self.words(5, 120)}"
        inner = [self.ad, self.note, self.side, self.form]
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            body.insert(r.randint(0, len(body)), r.choice(inner)())
        if r.random() < 0.15:
            body.append(self.comments())
        title = f"<h1 data-main>{self.words(2, 12)}</h1>" if r.random() < 0.85 else ""
        if title and r.random() < 0.1:
            title = f"<header data-main>{title}</header>"
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        attr = "" if tag in ("article", "main") and r.random() < 0.6 else f' {r.choice(["class", "id"])}="{r.choice(["content", "article-body", "post", "entry-content", "story", "main", "text", "article"])}"'
        if tag in ("div", "section") and r.random() < 0.15:
            attr = ""
        main = f"<{tag}{attr} data-main>{title}{''.join(body)}</{tag}>"
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            name = self.name("wrap", "container", "page", "content", "layout", "row")
            mates = [self.side() if r.random() < 0.3 else "", self.comments() if r.random() < 0.2 else ""]
            w = r.choice(["div", "div", "main", "section"])
            main = f"<{w}{name} data-main>{mates[0]}{main}{mates[1]}</{w}>"
        before = [f() for f in r.sample([self.nav, self.header, self.ad, self.note, self.form, self.nav, self.ad], r.randint(1, 5))]
        after = [f() for f in r.sample([self.side, self.ad, self.comments, self.form, self.note, self.nav], r.randint(0, 3))]
        if r.random() < 0.92:
            after.append(self.footer())
        head = f"<head><meta charset=utf-8><title>{self.words(2, 10)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>"
        end = "</body></html>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html data-main>{head}<body data-main>{''.join(before)}{main}{''.join(after)}{end}"


_DATA_MAIN = " data-main"


@lru_cache(maxsize=1)
def model(pages: int = 700, seed: int = 9) -> BoostedTrees:
    """Trees fitted on written pages. An element's label: whether it holds main text."""
    xs, ys = [], []
    for k in range(pages):
        nodes = parse(PageWriter(seed * 1_000_003 + k).page())
        ys.append(np.array([_DATA_MAIN in f" {v.attrs}" or v.index == 0 for v in nodes], float))
        for v in nodes:
            v.attrs = f" {v.attrs}".replace(_DATA_MAIN, "")
        f = node_features(nodes)
        fine = f[:, -2] > 0
        xs.append(f[fine, :N_FEATURES])
        ys[-1] = ys[-1][fine]
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def extract(pages: list[str], trees: BoostedTrees) -> list[str]:
    parsed = [parse(p) if p else [] for p in pages]
    features = [node_features(n) if n else np.zeros((0, N_FEATURES + 2)) for n in parsed]
    if not features:
        return []
    scores = trees.log_odds(np.concatenate(features))
    out, at = [], 0
    for nodes, f in zip(parsed, features, strict=True):
        s = scores[at : at + len(f)]
        at += len(f)
        out.append(page_text(nodes, decode(s, f[:, -2], f[:, -1].astype(np.int64))) if nodes else "")
    return out


def main_text(pages: DataFrame, trees: BoostedTrees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""
    trees = trees or model()

    def run(batches):
        for b in batches:
            raw = [h or "" for h in b.column("html").to_pylist()]
            texts = [t for k in range(0, len(raw), 200) for t in extract(raw[k : k + 200], trees)]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
