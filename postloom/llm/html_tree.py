"""A forgiving HTML tree for feature extraction: tags, attributes, text, and the places where they stood."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul br".split()
)
_CLOSES_P = BLOCK - {"br", "body", "html"}
#: A start tag that ends an open element, up to the boundary that stops the search.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()),
}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s=/\"'<>]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")


class Node:
    __slots__ = ("tag", "attrs", "parent", "depth", "children", "index")

    def __init__(self, tag: str, attrs: str, parent: "Node | None", index: int):
        self.tag, self.attrs, self.parent, self.index = tag, attrs, parent, index
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []  # in page order; texts are decoded


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw and not raw.isspace() else {}


class _Open:
    """The open elements by tag, so that the nearest one of a tag is found without a climb over all others."""

    def __init__(self, root: Node):
        self.top = root
        self.by_tag: dict[str, list[Node]] = {}

    def push(self, node: Node) -> None:
        self.by_tag.setdefault(node.tag, []).append(node)
        self.top = node

    def nearest(self, tags) -> Node | None:
        return max((own[-1] for t in tags if (own := self.by_tag.get(t))), key=lambda x: x.depth, default=None)

    def close(self, node: Node) -> None:
        """Closes node and all that is open in it; each element is closed once."""
        while True:
            last = self.by_tag[self.top.tag].pop()
            self.top = last.parent
            if last is node:
                return


def parse(page: str) -> list[Node]:
    """All element nodes in page order; the first is a root that stands for the page. Time is linear in the page, also where end
    tags have no partners."""
    root = Node("#page", "", None, 0)
    nodes, held, at, n = [root], _Open(root), 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            break
        if m.start() > at:
            held.top.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, attrs = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            own = held.by_tag.get(tag)
            if own:
                held.close(own[-1])
            elif tag == "br":
                held.top.children.append(Node("br", "", held.top, -1))
            continue
        if tag in _CLOSES_P and held.by_tag.get("p"):
            up = held.nearest(BLOCK)
            if up.tag == "p":
                held.close(up)
        if tag in _ENDS:
            ends, stop = _ENDS[tag]
            edge = held.nearest(stop)
            while (up := held.nearest(ends)) is not None and (edge is None or up.depth > edge.depth):
                held.close(up)
                if tag != "tr":
                    break
        node = Node(tag, attrs, held.top, len(nodes))
        nodes.append(node)
        held.top.children.append(node)
        if tag in VOID or attrs.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if end is None:
                at = n
            else:
                close = page.find(">", end.start())
                at = n if close < 0 else close + 1
            continue
        held.push(node)
    if at < n:
        held.top.children.append(html.unescape(page[at:]))
    return nodes
