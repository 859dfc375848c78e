"""Main text of web pages by composite text density.

A page is parsed into a tree. Elements that are never part of an article by
their tag, role or class (menus, sidebars, notices, adverts, forms, scripts,
reader comments ...) are cut. Every node that is left has C characters, T tags
below it, and LC characters and LT tags of links; its composite density is

    C / T * log(C / LC * T / LT),  to the base  ln(C * LC / (C - LC) + C * LCb / Cb + e)

(b: the body; counts of zero are one where they divide): characters per tag,
lowered by links. The sum of a node's children's densities tells the container
of many dense children, however little text each has. The node of the largest
sum is selected; the smallest density on its path to the body is the threshold.
Outside of that subtree, every node that reaches the threshold gives the
subtree of its own largest sum. If the selected node lies in an article or main
element, or holds the only one, that element's whole rest is the text: there
the threshold drops lists of links alone.

Text comes in blocks: text between the starts and ends of block elements.
References are decoded, white space (a line break element too) becomes one
blank, blocks are trimmed, empty ones left out, and the others joined by \\n.

Pages are parsed where they lie: one pass without a shuffle, a page at a time.

Defined results: a null or empty page, or one without text, gives the empty
string; broken markup is read as far as it goes (an unclosed tag ends with its
parent, a stray end tag is ignored, unfinished markup at the end is not text);
rows are judged one by one, so repeated ids give repeated rows; texts and pages
have no length limit, nesting beyond ``DEPTH`` is flattened; only page_id, url
and html are read, so extra columns cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values of HTML: elements without content, elements that end an open paragraph, and what a start tag closes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul""".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# what is no article, by tag, role and words of class or id
CUT_TAGS = frozenset("""head script style noscript template nav aside footer form button select textarea iframe object svg canvas audio video
    dialog menu""".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar tablist toolbar".split())
CUT_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner
    cookie cookies consent gdpr notice notices notification alert popup modal overlay disclaimer newsletter subscribe subscription signup paywall
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc masthead header footer sidebar aside rail widget widgets
    related recommended recommendations share sharing social comment comments commentlist disqus reply replies respond discussion feedback
    login search hidden skip""".split())
QUALIFIERS = frozenset("has with no without is".split())
# nesting is followed so far; deeper elements count as their ancestor's text
DEPTH = 400
# share of a list's characters inside links from which it is a list of links
LINKED = 0.5

_WORDS = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNFINISHED = re.compile(r"<[A-Za-z!/?]")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


class Node:
    """An element: its tag, whether its attributes name it as no article, and its children (nodes and texts)."""

    __slots__ = ("chars", "cut", "density", "kids", "link_chars", "link_tags", "sum", "tag", "tags", "up")

    def __init__(self, tag: str, up: Node | None, cut: bool = False):
        self.tag, self.up, self.cut, self.kids = tag, up, cut, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0

    def nodes(self) -> Iterator[Node]:
        return (k for k in self.kids if isinstance(k, Node))


def named_out(tag: str, attrs: Iterable[tuple[str, str | None]]) -> bool:
    """Whether the attributes tell that the element is no article."""
    if tag in ("html", "body", "main"):
        return False
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _UNSEEN.search(value or "")):
            return True
        if name == "role" and (value or "").strip().lower() in CUT_ROLES:
            return True
        if name in ("class", "id"):
            for each in (value or "").split():
                words = _WORDS.findall(_HUMP.sub("-", each).lower())
                if words and words[0] not in QUALIFIERS and not CUT_NAMES.isdisjoint(words):
                    return True
    return False


class Tree(HTMLParser):
    """Builds the tree of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and self.at is self.root and tag == "html":
            return
        if tag in BLOCK and tag != "body":
            self._close({"p"}, {"button", "td", "th", "table", "div", "article", "section", "li"})
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPE.get(tag, {"table"}))
        if tag in HEADINGS and self.at.tag in HEADINGS:
            self._up()
        node = Node(tag, self.at, named_out(tag, attrs))
        if tag in VOID or self.depth < DEPTH:
            self.at.kids.append(node)
        if tag not in VOID and self.depth < DEPTH:
            self.at = node
            self.depth += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root and node.tag != tag:
            # an inline end tag does not close the blocks that it stands in
            if tag not in BLOCK and node.tag in BLOCK:
                return
            node = node.up
        if node is not self.root:
            while self.at is not node:
                self._up()
            self._up()

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)

    def close(self) -> None:
        # what is left to read begins with unfinished markup, which the parser would hand out as text
        if _UNFINISHED.match(self.rawdata):
            self.rawdata = ""
        super().close()

    def _up(self) -> None:
        self.at = self.at.up
        self.depth -= 1

    def _close(self, tags: set[str], scope: set[str]) -> None:
        """End the outermost open element of ``tags`` below the nearest one of ``scope``, and what is open in it."""
        node, last = self.at, None
        while node is not self.root and node.tag not in scope:
            if node.tag in tags:
                last = node
            node = node.up
        while last is not None and self.at is not last.up:
            self._up()


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def inside(node: Node | None, tags: frozenset[str] | set[str]) -> Node | None:
    """The nearest of the node and its ancestors with one of the tags."""
    while node is not None and node.tag not in tags:
        node = node.up
    return node


ARTICLE = frozenset(("article", "main"))


def prune(node: Node, by_name: bool, own: bool = False) -> None:
    """Cut what is no article by tag and, if ``by_name``, by role and name.

    A page's header goes, an article's own stays (``own``: inside an article);
    a name does not cut an element that holds an article (unless one of
    comments) or a main element.
    """
    own = own or node.tag in ARTICLE
    kept = []
    for kid in node.kids:
        if isinstance(kid, Node):
            if kid.tag in CUT_TAGS or (kid.tag == "header" and not own):
                continue
            if by_name and kid.cut and not (own and (kid.tag in HEADINGS or kid.tag == "header")) and not holds_article(kid):
                continue
            prune(kid, by_name, own)
        kept.append(kid)
    node.kids = kept


def holds_article(node: Node) -> bool:
    if node.tag == "article":
        return False
    return any(k.tag == "main" or (k.tag == "article" and not k.cut and not comment_like(node)) or holds_article(k) for k in node.nodes())


def comment_like(node: Node) -> bool:
    """An element that its name cuts and whose articles stand in a list, as comments do."""
    return sum(k.tag == "article" for k in node.nodes()) != 1


def measure(node: Node, linked: bool = False) -> None:
    """Fill in the counts of a subtree."""
    linked = linked or node.tag == "a"
    for kid in node.kids:
        if isinstance(kid, Node):
            measure(kid, linked)
            node.chars += kid.chars
            node.link_chars += kid.link_chars
            node.tags += kid.tags + 1
            node.link_tags += kid.link_tags + (linked or kid.tag == "a")
        else:
            n = len(" ".join(kid.split()))
            node.chars += n
            node.link_chars += n if linked else 0


def weigh(node: Node, body: Node) -> None:
    """Composite density of every node of a subtree, and the sum of its children's."""
    for kid in node.nodes():
        weigh(kid, body)
        node.sum += kid.density
    if node.chars:
        links, plain = max(node.link_chars, 1), max(node.chars - node.link_chars, 1)
        base = math.log(node.chars * node.link_chars / plain + body.link_chars / max(body.chars, 1) * node.chars + math.e)
        ratio = node.chars / links * max(node.tags, 1) / max(node.link_tags, 1)
        # a base of one (a page without links) would divide by zero: e + 1 is the base of a node with one linked character
        node.density = node.chars / max(node.tags, 1) * math.log(max(ratio, 1.0)) / math.log(max(base, math.log(math.e + 1)))


def below(node: Node) -> Iterator[Node]:
    """A node and its descendants in page order."""
    yield node
    for kid in node.nodes():
        yield from below(kid)


def densest(node: Node) -> Node:
    """The node of the largest sum in a subtree; the first of equals, a node without children being its own sum."""
    return max(below(node), key=lambda n: n.sum or (n.density if not any(n.nodes()) else 0.0))


def select(body: Node) -> tuple[list[Node], float]:
    """Subtrees that make up the main text, in page order, and the threshold."""
    top = densest(body)
    path, node = [top], top
    while node is not body:
        node = node.up
        path.append(node)
    floor, above = min(n.density for n in path), set(map(id, path))
    home = inside(top, {"article"}) or inside(top, {"main"})
    if home is None:
        held = [n for n in below(top) if n.tag in ARTICLE and inside(n.up, ARTICLE) is None]
        home = held[0] if len(held) == 1 and top is body else None
    if home is not None:
        return [home], floor
    picked: list[Node] = []

    def mark(node: Node) -> None:
        if node is top:
            picked.append(node)
        elif node.density >= floor and id(node) not in above:
            picked.append(densest(node))
        else:
            for kid in node.nodes():
                mark(kid)

    mark(body)
    if len(picked) > 1:
        return picked, floor
    # the heading that stands right before a lone subtree is its own
    siblings = list(top.up.nodes()) if top.up is not None else [top]
    at = next(i for i, n in enumerate(siblings) if n is top)
    return ([siblings[at - 1]] if at and siblings[at - 1].tag in HEADINGS else []) + [top], floor


def link_list(node: Node, floor: float) -> bool:
    """A list whose text is mostly links and that stays below the threshold."""
    return node.tag in ("ul", "ol", "dl", "menu") and node.density < floor and node.link_tags > 1 and node.link_chars > LINKED * node.chars


def blocks(node: Node, floor: float) -> list[str]:
    """The texts of a subtree's blocks, decoded, in page order."""
    out: list[list[str]] = [[]]

    def walk(node: Node) -> None:
        edge = node.tag in BLOCK
        if edge:
            out.append([])
        elif node.tag == "br":
            out[-1].append(" ")
        for kid in node.kids:
            if isinstance(kid, Node):
                if not link_list(kid, floor):
                    walk(kid)
            else:
                out[-1].append(kid)
        if edge:
            out.append([])

    walk(node)
    return [text for text in (" ".join("".join(parts).split()) for parts in out) if text]


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    # names may lie (a page whose only container is called "header"): where they leave nothing, tags alone decide
    for by_name in (True, False):
        root = parse(html)
        body = next((n for n in below(root) if n.tag == "body"), root)
        prune(root, by_name)
        measure(body)
        if body.chars:
            weigh(body, body)
            found, floor = select(body)
            return "\n".join(text for node in found for text in blocks(node, floor))
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {types['page_id']}, url {types['url']}, text string")


# for pages as given: one article of headings and paragraphs, and no references but these; the general rule is beyond SQL
ORACLE_SQL = r"""
with a as (select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(p|h1)>', chr(10), 'g') as raw from pages),
     b as (select page_id, url, regexp_replace(replace(raw, '<br>', ' '), '<[^>]*>', '', 'g') as raw from a),
     d as (select page_id, url, regexp_replace(replace(raw, '&quot;', '"'), '&amp;?', '&', 'g') as raw from b),
     t as (select page_id, url, array_to_string([y for y in [trim(regexp_replace(x, '\s+', ' ', 'g')) for x in string_split(raw, chr(10))] if y <> ''], chr(10)) as text from d)
select page_id, url, text, length(text)::bigint as n_chars from t
"""


def contract(pages: DataFrame) -> DataFrame:
    """The op13 contract."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
