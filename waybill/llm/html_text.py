"""Main-text extraction by composite text density.

A tolerant reader builds the element tree of a page.  Furniture (menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts, styles) goes first: elements of such a name, and elements
whose class, id or role says so, unless they hold an article, or on a page without one most of the
text.  For each
remaining node the composite density is its characters per tag, adjusted for link characters and link
tags against those of the body; a node's density sum is that of its children.  The node with the
largest sum is the core.  The least density on its path to the body is the threshold: subtrees beside
the path that reach it belong to the text too, and so do those with half the core's sum.  The text is then the smallest subtree that holds all
of these, with the paragraphs, headings, lists and the like beside it and with other parts that add at
most a fifth, unless they are mostly links; an article or main element ends that widening, and inside
one it goes as far as its edge.

Edge cases: null or empty html, and a page without text, give an empty text; unclosed, misnested and
unknown tags are tolerated, and the time is linear in the page for any depth of nesting; a header
inside an article, by element or by name, is the article's own and stays; ties go to the outermost, then first node; very long
pages are read whole; repeated rows each give a row; an empty table gives an empty table; extra
columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame

from waybill.llm.common import map_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|([^<]+)|<", re.S)
CLOSE_RAW = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
MARKS = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

# Element names and class words of page furniture, void elements, block elements.
FURNITURE_TAGS = frozenset("head nav header footer aside form script style noscript template iframe button select textarea input svg canvas object embed menu dialog title".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sponsoring nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead topbar footer sidebar aside widget widgets related recommended share sharing social cookie cookies consent gdpr notice notices notification popup modal overlay alert "
    "newsletter subscribe subscription signup login paywall comment comments commentlist reply replies disqus respond discussion search form pagination pager copyright legal disclaimer complementary contentinfo".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A class such as no-header or has-sidebar tells of a wrapper, not of furniture.
NOT_NAMES = frozenset("no not non has have with without hide hidden show is".split())
#: Elements whose text is never part of a page's: what they hold is not read at all.
UNREAD = frozenset("script style".split())
#: An opening tag closes an open element of these names, unless one of the fences is nearer.
CLOSES = {"p": ({"p"}, {"td", "th", "button", "table"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_PARAGRAPH = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "summary"}


class Node:
    __slots__ = ("tag", "children", "parent", "first", "last", "named", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, first: int, named: str) -> None:
        self.tag, self.parent, self.first, self.last, self.named = tag, parent, first, first, named
        self.children: list[Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def named_furniture(tag: str, attributes: str) -> str:
    """The word of furniture that a class, id or role is, or that such a name begins or ends with; empty if there is none."""
    if not attributes or tag in ("html", "body", "article", "main"):
        return ""
    for m in MARKS.finditer(attributes):
        for mark in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [x for x in re.split(r"[-_:]+", mark) if x]
            ends = [mark, *parts[-1:], *parts[:1]] if NOT_NAMES.isdisjoint(parts) else [mark]
            for word in ends:
                if word in FURNITURE_WORDS:
                    return word
    return ""


def parse(page: str) -> tuple[Node, list[str | None]]:
    """The tree under one root, and its events: strings of text, and None at block edges.  A node covers events[first:last]."""
    events: list[str | None] = []
    root = Node("#root", None, 0, "")
    here, at, end = root, 0, len(page)
    open_tags: dict[str, int] = {}  # how many of a tag are open, so that no search goes up in vain

    def shut(to: Node) -> Node:
        """Close elements from ``here`` up to and with ``to``."""
        node = here
        while True:
            if node.tag in BLOCK:
                events.append(None)
            node.last = len(events)
            if node is not root:
                open_tags[node.tag] -= 1
            if node is to:
                return node.parent or root
            node = node.parent

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        if m[4] is not None or (m[2] is None and m[0] == "<"):
            events.append(m[0])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags.get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                here = shut(node)
            elif tag == "p":
                events.append(None)
            continue
        attributes = m[3] or ""
        names, fences = CLOSES.get(tag, (None, None))
        if names is None and tag in ENDS_PARAGRAPH:
            names, fences = CLOSES["p"]
        if names and any(open_tags.get(x) for x in names):
            node = here
            while node is not root and node.tag not in names and node.tag not in fences:
                node = node.parent
            if node is not root and node.tag in names:
                here = shut(node)
        if tag in BLOCK:
            events.append(None)
        if tag == "br":
            events.append(" ")
        node = Node(tag, here, len(events), named_furniture(tag, attributes))
        here.children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag != "a":
            continue
        if tag in CLOSE_RAW:
            raw = CLOSE_RAW[tag].search(page, at)
            if raw or tag in UNREAD:  # of the others, one that is never closed holds nothing
                at = raw.end() if raw else end
            continue
        open_tags[tag] = open_tags.get(tag, 0) + 1
        here = node
    while here is not root:
        here = shut(here)
    root.last = len(events)
    return root, events


def top_down(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += reversed(node.children)
    return order


def drop_furniture(root: Node, events: list[str | None]) -> None:
    """Take furniture out of the tree, and its text out of the events."""

    def clear(node: Node) -> None:
        events[node.first : node.last] = [""] * (node.last - node.first)

    def prune(keep) -> None:
        for node in top_down(root):
            gone = [c for c in node.children if not keep(c)]
            for c in gone:
                clear(c)
            if gone:
                node.children = [c for c in node.children if keep(c)]

    inside: set[int] = {id(root)} if root.tag in ("article", "main") else set()
    for node in top_down(root):  # nodes that lie in an article
        if node.tag in ("article", "main") or (node.parent is not None and id(node.parent) in inside):
            inside.add(id(node))
    prune(lambda c: c.tag not in FURNITURE_TAGS or (c.tag == "header" and id(c) in inside))
    sizes = [0]
    for e in events:
        sizes.append(sizes[-1] + (len(e) if e else 0))
    holds: set[int] = set()  # nodes with an article below them that has text
    for node in reversed(top_down(root)):
        if node.parent is not None and (id(node) in holds or node.tag in ("article", "main")) and sizes[node.last] > sizes[node.first]:
            holds.add(id(node.parent))
    prune(lambda c: not c.named or (c.named == "header" and id(c) in inside) or id(c) in holds or (id(root) not in holds and 2 * (sizes[c.last] - sizes[c.first]) > sizes[-1]))


def measure(root: Node, events: list[str | None]) -> list[Node]:
    """Fill the counts and densities of all nodes; the nodes from the leaves up."""
    sizes = [0]
    for e in events:
        sizes.append(sizes[-1] + (len("".join(e.split())) if e else 0))
    order = top_down(root)
    order.reverse()
    for node in order:
        node.chars = sizes[node.last] - sizes[node.first]
        node.tags = sum(c.tags + 1 for c in node.children)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, sum(c.tags + 1 for c in node.children)
        else:
            node.link_chars = sum(c.link_chars for c in node.children)
            node.link_tags = sum(c.link_tags + (c.tag == "a") for c in node.children)
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        if node.chars:
            c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e)
            ratio = max(c / lc * t / lt, 1.0)
            node.density = c / t * (math.log(ratio) / math.log(base) if base > 1 else math.log(ratio))
        node.sum = sum(c.density for c in node.children)
    return order


#: Share of a subtree's characters that parts around it, other than text blocks, may add.
AROUND = 0.2
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr b i em strong a span br img time".split())


def select(root: Node, events: list[str | None]) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    order = measure(root, events)
    body = next((n for n in reversed(order) if n.tag == "body"), root)
    core = body
    for node in reversed(order):
        if node.sum > core.sum and node.chars:
            core = node
    path, node = [core], core
    while node is not body and node.parent is not None:
        node = node.parent
        path.append(node)
    on_path = {id(n) for n in path}
    threshold = min(n.density for n in path)
    chosen, stack = [], [body]
    while stack:  # from the body down: whole subtrees beside the path when dense enough, the core itself on it
        node = stack.pop()
        if node is core:
            chosen.append(node)
        elif id(node) in on_path:
            stack += reversed(node.children)
        elif node.chars and (node.density >= threshold or 2 * node.sum >= core.sum > 0):
            chosen.append(node)
    # the smallest subtree that holds them all lies on the path
    whole = next(n for n in path if n.first <= chosen[0].first and chosen[-1].last <= n.last)
    if whole is body and core is not body:
        # the page's own parts: each is widened by itself
        return [widened(core, body) if n is core else n for n in chosen]
    return [widened(whole, body)]


def widened(node: Node, body: Node) -> Node:
    """The subtree with what stands around it: all of its article, else text blocks and small parts, unless they are links."""
    up, edge = node, None
    while up is not body and up.parent is not None:
        if up.tag in ("article", "main"):
            edge = up
            break
        up = up.parent
    if edge is not None:
        return edge
    while node is not body and node.parent not in (None, body):
        more, links = node.parent.chars - node.chars, node.parent.link_chars - node.link_chars
        parts = sum(c.chars for c in node.parent.children if c is not node and c.tag not in TEXT_BLOCKS)
        if parts > AROUND * node.chars or 2 * links > more:
            break
        node = node.parent
    return node


def main_text(page: str | None) -> str:
    """Blocks of the main text, white space inside a block as one space, joined by two line ends."""
    if not page:
        return ""
    root, events = parse(page)
    drop_furniture(root, events)
    blocks: list[str] = []
    for node in select(root, events):
        held: list[str] = []
        for e in [*events[node.first : node.last], None]:
            if e is not None:
                held.append(e)
            elif held:
                block = " ".join(html.unescape("".join(held)).split())
                if block:
                    blocks.append(block)
                held = []
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""

    def make():
        def work(page_id, url, page):
            text = [main_text(p) for p in page]
            return {"page_id": page_id, "url": url, "text": text, "n_chars": [len(t) for t in text]}

        return work

    return map_batches(pages.select("page_id", "url", "html"), make, "page_id bigint, url string, text string, n_chars bigint")
