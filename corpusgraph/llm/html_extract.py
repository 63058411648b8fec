"""Main text of HTML pages by composite text density.

A page is parsed into a tree (tolerant of missing and stray end tags). Scripts, styles, navigation, headers and
footers of the page, asides, forms and hidden elements are no content. Class, id and role remove nothing by themselves:
where they say advert, sidebar, comment, notice and the like, they lower the density of the element and all in it, the
more the larger the share of such words in the name, and the density decides. An element with an article or main element
in it or, on a page without those, with most of the page's unlinked characters is not lowered.

Every node gets its composite density: characters per tag, corrected by the share of linked characters and tags.
Elements within a line (b, em, span, br and all that are neither blocks nor links) are no tags of their own: what is in
them counts as standing where they stand. The block whose children's densities add up to most holds the text. The
smallest density on the path from it to the body is the threshold. The text goes on in all subtrees beside the path that
are dense too, each by its own such block: those of at least half the threshold or, where that is less, half the density
that the block's children have (a mean weighted by itself; the densities of small subtrees are below those of large ones
of the same kind). Of what is kept, lists of `MENU_LINKS` links or more that are thinner than the threshold and hardly
anything but links are left out, and so is an element with a lowered density below half the threshold. Headings before
what is kept are kept, an h1 anywhere before it, others right before it.

The text is the node's blocks in page order, one a line: character references decoded, white space inside a block
(also a br) one space, trimmed; nothing else is dropped or cut.

Edge cases. A null or empty page, or one without content, has an empty text. Markup without an end (comment, tag,
script) runs to the end of the page. Depth is bounded by the page only: nothing here recurses. Repeated rows, ties and
null ids are rows like others; an empty table gives an empty result. Columns other than the id, URL and HTML are not read. Ids are
whole numbers, or texts of such; others are an error.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import portions

# Element names by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
NEVER = frozenset("head script style noscript iframe template nav aside footer form button select textarea input svg canvas object dialog menu title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "li", "dd", "dt"}
# An element is closed by the start of one of these while the first of the stops lies between.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Words of class, id and role that mark what is no content.
NO_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar aside rail widget widgets related recommended recommendations share sharing social "
    "comment comments commentlist disqus replies reply "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc masthead topbar footer footnav copyright complementary contentinfo search toolbar skip".split()
)
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
MENU_LINKS = 4
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("chars", "content", "density", "factor", "heading", "kids", "link_chars", "link_tags", "mains", "name", "own", "parts", "tag", "tags", "up")

    def __init__(self, name: str, up: Node | None, content: bool):
        self.name, self.up, self.content = name, up, content
        self.parts: list[str | Node] = []
        self.factor = 1.0
        self.tag = name in BLOCK or name == "a"


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kinds text, start and end, in page order."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif m := _TAG.match(page, lt):
            name = m[2].lower()
            at = m.end()
            yield ("end" if m[1] else "start"), name, m[3]
            if not m[1] and name in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                stop = end.start() if end else n
                yield "text", page[at:stop], ""
                at = stop
        elif lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] == "/"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        else:
            yield "text", "<", ""
            at = lt + 1


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by lower-case name, the first of each; quoted values are whole, whatever is in them."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text) if text else ():
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def unwanted(name: str, attributes: dict[str, str], inside_main: bool) -> bool:
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    return hidden or name in NEVER or (name == "header" and not inside_main)


def by_name(name: str, attributes: dict[str, str]) -> float:
    """What class, id and role leave of an element's density: 1 less the largest share of words that mark what is no content
    in one of their names, and a fiftieth at least."""
    names = [n for key in ("class", "id", "role") for n in attributes.get(key, "").split()]
    if not names or name in ("html", "body", "article", "main", "h1"):
        return 1.0
    words = [_NAME.findall(_CAMEL.sub("-", n).lower()) for n in names]
    return max(0.02, 1 - max(sum(w in NO_CONTENT for w in ws) / max(1, len(ws)) for ws in words))


def parse(page: str) -> Node:
    """The tree of a page; its root is the body or what stands for it."""
    root = Node("body", None, True)
    here, opened = root, {"body": 1}
    mains = 0

    def close_to(node: Node) -> None:
        nonlocal here, mains
        while here is not node:
            opened[here.name] -= 1
            mains -= here.name in MAIN
            here = here.up or root

    for kind, name, attributes in events(page):
        if kind == "text":
            here.parts.append(name)
        elif kind == "start":
            if name in ("html", "body"):
                continue
            if name in CLOSES_P and opened.get("p"):
                x = here
                while x.name != "p" and x.name not in ("td", "th", "button", "object"):
                    x = x.up or root
                    if x is root:
                        break
                if x.name == "p":
                    close_to(x.up or root)
            if name in IMPLIED and any(opened.get(c) for c in IMPLIED[name][0]):
                closes, stops = IMPLIED[name]
                x, found = here, None
                while x is not root and x.name not in stops:
                    if x.name in closes:
                        found = x
                    x = x.up or root
                if found:
                    close_to(found.up or root)
            named = attributes_of(attributes)
            node = Node(name, here, here.content and not unwanted(name, named, mains > 0))
            node.factor = by_name(name, named)
            here.parts.append(node)
            if name not in VOID and not attributes.endswith("/"):
                here = node
                opened[name] = opened.get(name, 0) + 1
                mains += name in MAIN
        elif name not in ("html", "body") and opened.get(name):
            x = here
            while x.name != name:
                x = x.up or root
            close_to(x.up or root)
    return root


def in_order(root: Node) -> list[Node]:
    """Content nodes, parents before children."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        x.kids = [k for k in x.parts if isinstance(k, Node) and k.content]
        stack.extend(reversed(x.kids))
    return out


def measure(nodes: list[Node]) -> None:
    """Characters, tags, linked characters and tags, and composite density of every node."""
    for x in reversed(nodes):
        own = sum(len("".join(p.split())) for p in x.parts if isinstance(p, str))
        x.own = own
        x.chars = own + sum(k.chars for k in x.kids)
        x.tags = sum(k.tags + k.tag for k in x.kids)
        linked = x.name == "a"
        x.link_chars = x.chars if linked else sum(k.link_chars for k in x.kids)
        x.mains = x.name in MAIN or any(k.mains for k in x.kids)
        x.link_tags = x.tags if linked else sum(k.link_tags + (k.name == "a") for k in x.kids)
        x.heading = x.name if x.name in HEADINGS else next((k.heading for k in x.kids if k.chars and k.chars == x.chars), "")
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    most = (body.chars - body.link_chars) / 2
    for x in nodes:
        plain = x.chars - x.link_chars
        if x.mains or (not body.mains and plain > most):
            x.factor = 1.0
        if x.up:
            x.factor *= x.up.factor
        base = math.log(x.chars / max(1, plain) * x.link_chars + share * x.chars + math.e)
        ratio = max(x.chars, 1) / max(1, x.link_chars) * max(1, x.tags) / max(1, x.link_tags)
        x.density = x.chars / max(1, x.tags) * math.log(max(ratio, 1)) / math.log(max(base, math.e)) if ratio > 1 else 0.0
        x.density *= x.factor


def choose(nodes: list[Node]) -> tuple[list[Node], float, float]:
    """The nodes that hold the text, in page order; the threshold; and the density from which a subtree is text."""
    total: dict[Node, float] = {}
    most: dict[Node, Node] = {}  # of every subtree, the block with the largest sum
    for x in reversed(nodes):
        total[x] = sum(k.density if k.tag else total[k] for k in x.kids)
        below = [most[k] for k in x.kids]
        most[x] = max([x, *below] if x.name in BLOCK or not below else below, key=total.__getitem__)
    best = most[nodes[0]]
    path = []
    x: Node | None = best
    while x is not None:
        path.append(x)
        x = x.up
    threshold = min(p.density for p in path)
    usual = sum(k.density * k.density for k in best.kids) / total[best] if total[best] else 0.0
    limit = min(threshold, usual) / 2
    tops, above, todo = set(), set(), [nodes[0]]
    while todo:
        x = todo.pop()
        if x is not nodes[0] and (x.density < limit or not x.chars or 2 * x.link_chars > x.chars):
            todo.extend(x.kids)
            continue
        top = most[x]
        tops.add(top)
        while top is not x:
            todo.extend(k for k in top.up.kids if k is not top)
            top = top.up
    for x in tops:
        up = x.up
        while up is not None and up not in above:
            above.add(up)
            up = up.up
    share = nodes[0].link_chars / max(1, nodes[0].chars)
    for x in above:  # text of its own, beside the subtrees, counts as a leaf; then the node is taken whole
        if x.own and x.own * math.log(x.own) / math.log(share * x.own + math.e) >= limit:
            tops.add(x)
    for x in above - tops:
        follows = near = False
        for k in reversed(x.kids):
            if k in tops or k in above:
                follows = near = True
            elif k.heading and 2 * k.link_chars < k.chars:
                if near or (follows and k.heading == "h1"):
                    tops.add(k)
            elif k.chars:
                near = False
    out, inside = [], set()
    for x in nodes:
        if x.up in inside:
            inside.add(x)
        elif x in tops:
            out.append(x)
            inside.add(x)
    return out, threshold, limit


def blocks(top: Node, threshold: float, limit: float) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif not x.content:
            continue
        elif x is not top and x.up and x.factor < x.up.factor and x.density < limit:
            continue
        elif x is not top and x.name in ("ul", "ol", "div", "section", "table") and x.density < threshold and x.link_tags >= MENU_LINKS and 10 * x.link_chars >= 9 * x.chars:
            continue
        elif x.name in ("br", "wbr", "img"):
            line.append(" " if x.name == "br" else "")
        elif x.name in BLOCK:
            flush()
            stack.append(None)
            stack.extend(reversed(x.parts))
        else:
            stack.extend(reversed(x.parts))
    flush()
    return out


def main_text(page: str | None) -> str:
    nodes = in_order(parse(page or ""))
    measure(nodes)
    tops, threshold, limit = choose(nodes)
    return "\n".join(line for top in tops for line in blocks(top, threshold, limit))


SCHEMA = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "html"):
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """One row for each page: id, url, text, n_chars (code points)."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(body).alias("html"))
    out = own.mapInArrow(_extract, SCHEMA)
    return out.withColumnsRenamed({"page_id": id_col, "url": url})
