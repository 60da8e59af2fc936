"""Main text of web pages by composite text density.

A page is scanned once by tags into a tree, as browsers would: raw-text elements
end at their end tag only, paragraphs and list items close themselves, stray end
tags are ignored, what is left open ends with the page.  For every node

    density = C / T * log_b(C / LC * T / LT),
    b = ln(C / NL * LC + LC_body / C_body * C + e)

with C characters, T tags, LC and LT those within links, NL = C - LC (counts of 0
become 1).  A node's *sum* is that of its children's densities.  The node of the
greatest sum holds the article; the least density on its path from the body is
the threshold.  Then, from the body down, every node that reaches the threshold
gives the node of the greatest sum at or under it, and what these nodes hold is
the article, but for blocks under the threshold that are mostly links and stand in
no ``article``.

Tags and names enter as weights of the characters.  What can never hold an
article's text (scripts, styles, forms, menus, headers and footers of the page,
sidebars) weighs nothing.  What is called like an advert, a notice, reader
comments and the like weighs ``NAMED``, so that it falls under any threshold a
page's other text sets, yet is found where a page has nothing else.  Inside an
``article`` names that its parts have as well (a discussion, an alert, related work)
do not count.  The sum of an ``article`` is no less than that of any node in it.

Text is decoded, white space in a block becomes one space, blocks are joined by
an empty line in page order.

Defined cases: a null or empty html, or one without text, gives the empty text.
Markup that never closes, unknown tags and deep nesting are handled without
recursion, in time linear in the page.  A page without a body is all body.
Repeated rows are extracted one by one.  Other columns of ``pages`` are not read,
so none can clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

#: One attribute, as the HTML standard scans it: a name, then a quoted or a bare value.
ATTRIBUTE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|{ATTRIBUTE}|=)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
MARKS = re.compile(r"""(?:^|\s)(class|id|role|aria-hidden|hidden|style)(?=[\s=/>]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
SPACE = re.compile(r"\s+")

# Element names of the HTML standard, by how they are treated here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen frame".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "caption", "legend", "option", "optgroup", "tbody", "tfoot", "thead", "tr"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What never holds an article's text.
NEVER = frozenset("head script style noscript template iframe object applet canvas svg math audio video map nav aside form button input select textarea datalist footer menu dialog title xmp noembed noframes search".split())
#: Which open elements an opening tag ends, looking no further up than the stop.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Words in a class, id or role that name what is not the article.
NOT_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adbox|adslot|adverts?|advertisements?|advertising|banner|breadcrumbs?|byline-share|captcha|comments?|commentlist|consent|contentinfo|cookies?|cookiebar|complementary|disqus|discussion|footer|gdpr|hidden|login|masthead|menu|menubar|modal|nav|navbar|navigation|navigations|newsletter|notices?|overlay|pagination|pager|paywall|popup|promos?|promoted|promotions?|related|replies|reply|respond|responses|search|share|sharing|sidebar|sidebars|signup|site-header|page-header|skip|social|sponsors?|sponsored|subscribe|subscription|taglist|toolbar|widgets?|alert|alertdialog|warning-box)(?:$|[\s_-]|\d)",
    re.I,
)
#: Of these the ones that parts of an article are called, too: inside an ``article`` they mean nothing.
ALSO_ARTICLE = re.compile(r"(?:^|[\s_-])(?:alert|banner|discussion|menu|notices?|overlay|promotions?|related|replies|reply|respond|responses|search|skip|social|warning-box|widgets?)(?=$|[\s_-]|\d)", re.I)
KEPT_BY_NAME = frozenset("body html main".split())
ARTICLE_NAME = re.compile(r"(?:^|[\s_-])(?:article|articlebody|entry|entry-content|main|main-content|post|post-content|post-body|story|story-body|articletext)(?:$|[\s_-])", re.I)
#: Weight of the characters in what is named like no part of an article.
NAMED = 1e-6
SCOPES = ("td", "th", "table")


class Node:
    __slots__ = ("name", "children", "weight", "inside", "raw", "chars", "tags", "link_chars", "link_tags", "density", "total", "best")

    def __init__(self, name: str, weight: float, inside: bool = False):
        self.name, self.weight, self.inside = name, weight, inside  # inside an ``article``
        self.children: list = []  # nodes and texts, in page order
        self.raw = self.tags = self.link_tags = 0
        self.chars = self.link_chars = 0.0  # weighted
        self.density = self.total = 0.0
        self.best: Node = self  # of the greatest sum at or under this node


def camel(text: str) -> str:
    """A class or id in words; what only says that something is there (``has-sidebar``) goes."""
    return re.sub(r"\b(?:has|with|no|without)[-_]\w+(?:-\w+)*", "", re.sub(r"([a-z])([A-Z])", r"\1-\2", text))


def weight_of(name: str, marks: str, in_article: bool, in_main: bool) -> float:
    """What the characters of an element count, by its tag and names."""
    if name in NEVER or name == "header" and not in_main:
        return 0.0
    if name in KEPT_BY_NAME or not marks:
        return 1.0
    named = article = False
    for m in MARKS.finditer(marks):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return 0.0
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return 0.0
        elif key != "aria-hidden":
            words = camel(value)
            article = article or ARTICLE_NAME.search(words) is not None
            named = named or NOT_ARTICLE.search(ALSO_ARTICLE.sub(" ", words) if in_article and key != "role" else words) is not None
    return NAMED if named and not article else 1.0


class Open:
    """The open elements, and where in the stack those of each name are."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.where: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.where.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def nearest(self, names) -> int:
        """Place of the innermost open element of one of ``names``; -1 without one."""
        return max([w[-1] for n in names if (w := self.where.get(n))], default=-1)

    def close(self, place: int) -> None:
        """End all elements from ``place`` on."""
        while len(self.stack) > place:
            self.where[self.stack.pop().name].pop()


def parse(page: str) -> Node:
    """The page's tree; texts stay undecoded."""
    root = Node("#root", 1.0)
    open_ = Open(root)
    unclosed: set[str] = set()  # raw-text elements without an end tag in the rest of the page
    pos, n = 0, len(page)
    while pos < n:
        m = TOKEN.search(page, pos)
        text_end = m.start() if m else n
        if text_end > pos:
            open_.stack[-1].children.append(page[pos:text_end])
        if m is None:
            break
        pos = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                open_.stack[-1].children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        if m[1]:  # an end tag
            place = open_.nearest((name,))
            if place > 0 and (name in BLOCK or name in SCOPES or place > open_.nearest(SCOPES)):
                open_.close(place)
            continue
        if name in CLOSES_P:
            place = open_.nearest(("p",))
            if place > 0 and place > open_.nearest((*SCOPES, "button", "object")):
                open_.close(place)
        ended = ENDED_BY.get(name)
        if ended:
            stop = open_.nearest(ended[1])
            places = [w[i] for e in ended[0] if (w := open_.where.get(e)) and (i := bisect_right(w, stop)) < len(w)]
            if places:
                open_.close(min(places))
        up = open_.stack[-1]
        inside = bool(open_.where.get("article"))
        weight = min(up.weight, weight_of(name, m[3], inside, inside or bool(open_.where.get("main"))))
        node = Node(name, weight, inside)
        up.children.append(node)
        if name in VOID or m[3].endswith("/") and name not in BLOCK and name not in RAW and name not in ("a", "b", "i", "em", "strong", "span", "td", "th"):
            continue
        if name in RAW:
            close = None
            if name not in unclosed:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, pos)
                if close is None:
                    unclosed.add(name)
            if name in ("script", "style", "title", "textarea", "xmp", "noembed", "noframes", "iframe") or close:
                pos = close.end() if close else n
                continue
        open_.push(node)
    return root


def measure(root: Node) -> list[Node]:
    """Sets each node's counts, its density, its sum and the best node under it; the nodes, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str)]
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                if not c.isspace():
                    node.raw += len(c)
                    node.chars += len(c) * node.weight
            else:
                node.raw += c.raw
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.name == "a")
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
    body = next((x for x in order if x.name == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(order):
        if node.chars:
            part = node.chars / node.raw  # mean weight: counts are taken unweighted, and the density weighted
            c, lc = node.raw, max(1.0, node.link_chars / part)
            t, lt = max(1, node.tags), max(1, node.link_tags)
            base = math.log(c / max(1.0, c - lc) * lc + share * c + math.e)
            node.density = part * max(0.0, c / t * math.log(max(1.0, c / lc) * t / lt + 1e-9) / math.log(base + 1.0))
        inside = [x for x in node.children if not isinstance(x, str)]
        node.total = sum(x.density for x in inside)
        for x in inside:
            if x.best.total > node.best.total or x.best.total == node.best.total and node.name in ("#root", "html"):
                node.best = x.best
        if node.name == "article" and node.best is not node:
            node.total = node.best.total
            node.best = node
    return order


def article_nodes(root: Node) -> tuple[set[Node], float]:
    """The nodes that hold the article, and the threshold.

    A node's best has all its text where the node itself has none of its own, so the
    nodes are found in one walk down from the body.
    """
    order = measure(root)
    up: dict[Node, Node] = {c: x for x in order for c in x.children if not isinstance(c, str)}
    best = root.best
    floor, at = best.density, best
    while at in up:
        at = up[at]
        if at.name not in ("#root", "html") and at.density > 0:
            floor = min(floor, at.density)
    found: set[Node] = set()
    start = next((x for x in order if x.name == "body"), root)
    todo = [root] if start is not root and root.chars > start.chars else [start]
    while todo:
        node = todo.pop()
        if node.density >= floor and node.weight > 0 or node is root:
            if node.best.chars:
                found.add(node.best)
            if node.best is not node:
                todo += [c for c in node.children if not isinstance(c, str)]
    if not found and best.chars:
        found.add(best)
    return found, floor


def blocks(root: Node, chosen: set[Node], floor: float) -> list[str]:
    """Texts of the blocks inside the ``chosen`` nodes, in page order."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        if line:
            text = SPACE.sub(" ", entities.unescape("".join(line))).strip()
            if text:
                out.append(text)
            line.clear()

    todo: list = [(root, None)]
    while todo:
        x, within = todo.pop()  # a node or a text, and the chosen node it lies in
        if x is None:
            close()
        elif isinstance(x, str):
            if within is not None:
                line.append(x)
        elif within is not None and under(x, within, floor):
            if x.name in BLOCK:
                close()
        else:
            if within is None and x in chosen:
                within = x
            if x.name in BLOCK:
                close()
                todo.append((None, within))
            elif x.name in ("br", "td", "th", "img"):
                line.append(" ")
            todo.extend((c, within) for c in reversed(x.children))
    close()
    return out


def under(node: Node, within: Node, floor: float) -> bool:
    """Whether a node in the article is no part of it: by its weight, or as a block of links, under the threshold."""
    if node.weight == 0:
        return True
    if node.density >= floor:
        return False
    linked = not node.inside and node.name in ("ul", "ol", "div", "section", "table", "dl", "p") and node.link_tags > 1 and node.link_chars > 0.5 * node.chars
    return linked or node.weight < within.weight and node.raw > 0


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page.replace("\x00", ""))
    return "\n\n".join(blocks(root, *article_nodes(root)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages`` (page_id, url, html)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(kernel, f"page_id {id_type}, url string, text string, n_chars long")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
