"""Main text of web pages by composite text density.

A page is read once into a tree: comments, declarations, scripts, styles and the like carry no text, unclosed and stray tags are mended
as browsers do (a block closes an open paragraph, an item the item before it, whatever can't stand in the head closes an open head).
Elements whose tag, role or hiding says that they aren't the article (nav, header, footer, aside, form and the like) are cut off; a header
inside an article, section or main element belongs to it.

Every element has a density, its characters per tag, adjusted by the share of characters and tags in links:

    C / T * log(C / LC * T / LT) to the base ln(C / (C - LC) * LC + LCb / Cb * C + e)

with C, T characters and tags of the subtree, LC, LT those in links (each 1 at least), Cb, LCb those of the body. Tags are those that make
blocks, and links; the marks of a line (b, i, span, br) are no structure. A density sum adds up the densities of an element's blocks and
of its own lines. Class and id values weigh: characters in an element that is named as an advert, notice, menu of the site, sidebar or
reader comments count 1/WEIGHT, whatever holds it.

The element of the largest density sum is where the text is. From there the selection grows towards the body: a parent takes its place
as long as what the parent adds has at least SHARE of the threshold, the least density on the path from the body to that element; an
article element is not left. In the selected subtree an element named as above goes if its weighed density is below the threshold, and so
does a group of several links without other text; all other blocks are returned, however short.

Defined cases: a null or empty page, a page without tags (its text is one block) and one that ends inside a tag, comment or script;
character references of any form; a page that is all boilerplate has an empty text; nesting of any depth; repeated rows are extracted
separately; columns of other names are ignored. Reading takes time in proportion to the page (times the logarithm of its depth).
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.arrow import map_arrow, texts_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page; the content of the first ones is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
SILENT = RAW | frozenset("head noscript template svg math canvas audio video object applet map datalist select option button input".split())
#: Elements that may stand in a head; every other one closes it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title script style noscript noframes template".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog fieldset label".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Elements whose header is their own.
SECTIONS = frozenset("article main section".split())
#: Words of class and id values that name what isn't the article. A value counts if all its words are among these and LAYOUT.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation breadcrumb breadcrumbs masthead topbar footer bottombar sidebar sidebars related recommended "
    "comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login sharing social pagination pager".split()
)
#: Words beside them that name nothing.
LAYOUT = frozenset("area bar block bottom box btn button banner center container content fixed hidden inner item items left links list main menu mobile module outer panel posts primary right row secondary section site slot small sticky thread top unit wide widget wrap wrapper large page skyscraper".split())
#: Elements that are menus if all their text is in links.
GROUPS = frozenset("ul ol dl div section table".split())
#: Characters in an element so named count this part, and growing takes this share of the threshold.
WEIGHT, SHARE = 50.0, 0.3
#: Elements that are parts of a line; every other one starts and ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag closes these if one is open, looking no further up than the bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"})}
P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
BUTTON_SCOPE = frozenset("button caption html table td th object template".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "parts", "cut", "named", "chars", "link_chars", "tags", "link_tags", "weight", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, named: bool = False):
        self.tag, self.parent, self.cut = tag, parent, cut
        #: Whether its class or id names something else than the article.
        self.named = named
        self.parts: list[Node | str] = []


def names_boilerplate(value: str) -> bool:
    """Whether one of the names in a class or id value consists of words of boilerplate and of layout, the first kind at least once."""
    for part in value.split():
        words = [w.lower() for w in _WORD.findall(_CAMEL.sub(" ", part))]
        if not BOILERPLATE_WORDS.isdisjoint(words) and all(w in BOILERPLATE_WORDS or w in LAYOUT for w in words):
            return True
    return False


def boilerplate(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is cut for its tag, role or hiding, and whether its class or id names it as something else than the article."""
    if tag in BOILERPLATE_TAGS:
        return True, False
    named = False
    if not attributes:
        return False, False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name == "role" and value.lower() in BOILERPLATE_ROLES:
            return True, False
        named = named or name in ("class", "id") and tag not in ("html", "body", "main", "article") and names_boilerplate(value)
    return False, named


class Open:
    """The open elements from the root to the one that is being read, with the places of each tag among them."""

    def __init__(self, root: Node):
        self.path, self.places = [root], {}

    @property
    def node(self) -> Node:
        return self.path[-1]

    def last(self, tags) -> int:
        """The innermost place of any of some tags; -1 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)

    def close(self, place: int) -> None:
        """Closes the element at a place and all inside it."""
        while len(self.path) > place:
            self.places[self.path.pop().tag].pop()

    def leave_head(self) -> None:
        """Closes an open head, if nothing but a noscript is open in it."""
        depth = len(self.path) - (self.node.tag == "noscript")
        if depth > 1 and self.path[depth - 1].tag == "head":
            self.close(depth - 1)


def parse(page: str) -> Node:
    """The tree of a page; a root node stands above all."""
    root = Node("#root", None)
    open_ = Open(root)
    at, n = 0, len(page)
    no_more: dict[str, bool] = {}  # quotes and marks that don't come again

    def text(piece: str) -> None:
        if open_.node.tag == "head" and piece.strip():
            open_.leave_head()
        open_.node.parts.append(piece)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        c = page[lt + 1 : lt + 2]
        if c == "!" or c == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = c == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            if closing and lt + 2 < n:  # a bogus comment
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                open_.node.parts.append("<")
                at = lt + 1
            continue
        tag, end = m[0].lower(), m.end()
        while True:
            stop = _STOP.search(page, end)
            if stop is None:
                end = n
                break
            q = stop[0]
            if q == ">":
                end = stop.start()
                break
            # a quote opens a value only after an equals sign
            opens = page[max(0, stop.start() - 8) : stop.start()].rstrip().endswith("=")
            close = -1 if not opens or no_more.get(q) else page.find(q, stop.end())
            if close < 0:
                no_more[q] = no_more.get(q, False) or opens
                end = stop.end()
            else:
                end = close + 1
        at = min(n, end + 1)
        if end >= n:  # the page ends inside a tag
            break
        if closing:
            if tag == "br":
                open_.node.parts.append(Node("br", open_.node))
            elif (place := open_.last((tag,))) >= 0:
                open_.close(place)
            elif tag == "p":
                open_.node.parts.append(Node("p", open_.node))
            continue
        attributes = page[m.end() : end]
        if tag not in IN_HEAD:
            open_.leave_head()
        if tag in P_CLOSERS and (place := open_.last(("p",))) > open_.last(BUTTON_SCOPE):
            open_.close(place)
        if tag in CLOSES:
            closes, bounds = CLOSES[tag]
            bound = open_.last(bounds)
            first = [p[i] for t in closes if (p := open_.places.get(t)) and (i := bisect_right(p, bound)) < len(p)]
            if first:
                open_.close(min(first))
        if tag in ("html", "body") and open_.last((tag,)) >= 0:
            continue
        node = open_.node
        sure, named = (True, False) if tag in SILENT else boilerplate(tag, attributes)
        if tag == "header" and open_.last(SECTIONS) >= 0:
            sure = False
        child = Node(tag, node, sure, named)
        node.parts.append(child)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at) if not no_more.get(tag) else None
            no_more[tag] = end is None
            if end is None:
                break
            close = page.find(">", end.end())
            at = n if close < 0 else close + 1
            continue
        if not attributes.endswith("/") or tag not in ("svg", "math", "path"):
            open_.push(child)
    return root


def above(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def in_order(root: Node) -> list[Node]:
    """Elements that aren't cut, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [p for p in reversed(node.parts) if type(p) is Node and not p.cut]
    return out


def density(chars: float, tags: int, link_chars: float, link_tags: int, share: float) -> float:
    """Composite text density; share is the body's characters in links over all of them."""
    if chars <= 0:
        return 0.0
    c, t, lc, lt = chars, max(1, tags), max(1.0, link_chars), max(1, link_tags)
    base = math.log(c / max(1.0, c - link_chars) * link_chars + share * c + math.e)
    # the base is 1 where there are no links at all: then density is characters per tag
    return c / t * (math.log(max(1.0, c / lc * t / lt)) / math.log(base) if base > 1.0001 else 1.0)


def measure(root: Node) -> tuple[list[Node], Node, float]:
    """Elements that aren't cut with their density and density sum; the body; its share of characters in links."""
    nodes = in_order(root)
    for node in nodes:
        node.weight = 1 / WEIGHT if node.named else 1.0 if node.parent is None else node.parent.weight
    for node in reversed(nodes):
        chars = link_chars = 0.0
        tags = link_tags = 0
        for p in node.parts:
            if type(p) is str:
                chars += (len(p) - p.count(" ") - p.count("\n")) * node.weight
            elif not p.cut:
                chars, link_chars, link_tags = chars + p.chars, link_chars + p.link_chars, link_tags + p.link_tags + (p.tag == "a")
                tags += p.tags + (p.tag == "a" or not (p.tag in INLINE or p.tag in VOID))
        if node.tag == "a":
            link_chars, link_tags = chars, tags
        node.chars, node.link_chars, node.tags, node.link_tags = chars, link_chars, tags, link_tags
    body = next((x for x in nodes if x.tag == "body"), root)
    share = body.link_chars / max(1.0, body.chars)
    for node in reversed(nodes):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        # the densities of blocks and, together, of lines beside them; a mark of a line passes on the blocks in it
        total, chars, link_chars, tags, link_tags = 0.0, 0.0, 0.0, 0, 0
        for p in node.parts:
            if type(p) is str:
                chars += (len(p) - p.count(" ") - p.count("\n")) * node.weight
            elif not p.cut and p.tag in INLINE:
                chars, link_chars, tags, link_tags = chars + p.chars, link_chars + p.link_chars, tags + p.tags + (p.tag == "a"), link_tags + p.link_tags + (p.tag == "a")
            elif not p.cut:
                total += p.density
        node.sum = total + density(chars, tags, link_chars, link_tags, share)
    return nodes, body, share


def select(root: Node) -> tuple[Node, float] | None:
    """The element of the main text and the threshold of its page, or None if no text is left."""
    _, body, share = measure(root)
    inside = [x for x in in_order(body) if x.chars and x.tag not in INLINE]
    if not inside:
        return None
    best = max(inside, key=lambda x: x.sum)  # of equal ones the outermost
    threshold = min(x.density for x in above(best) if x is body or x.parent is not None)
    while best is not body and best.parent is not None and best.tag != "article":
        up = best.parent
        more = density(up.chars - best.chars, up.tags - best.tags - 1, up.link_chars - best.link_chars, up.link_tags - best.link_tags, share)
        if more and more < SHARE * threshold:
            break
        best = up
    return best, threshold


def blocks(node: Node, threshold: float) -> list[str]:
    """The blocks of a subtree, without what is cut, menus, and what is named as something else and less dense than the threshold."""
    out, line = [], []

    def flush() -> None:
        if line and (text := " ".join(html.unescape("".join(line)).split())):
            out.append(text)
        line.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif type(x) is str:
            line.append(x)
        elif x is not node and (x.cut or x.named and x.density < threshold or x.tag in GROUPS and x.link_tags > 1 and x.link_chars >= x.chars):
            if x.tag not in INLINE:
                flush()
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in INLINE:
            stack += reversed(x.parts)
        else:
            flush()
            stack.append(None)
            stack += reversed(x.parts)
    flush()
    return out


def main_text(page: str) -> str:
    found = select(parse(page)) if page else None
    return "\n".join(blocks(*found)) if found is not None else ""


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(own.dtypes)
    return map_arrow(own, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
