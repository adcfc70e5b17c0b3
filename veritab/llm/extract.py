"""Main text of HTML pages by composite text density.

For every DOM node: its characters per tag, adjusted for how much of it is links (the
composite text density). The density sum of a node adds up its children's densities. The
node with the largest sum is the heart of the page, and the smallest density on its path to the
body, the body included, is the threshold. Beside the heart, each level of the path is judged:
if all that stands there together reaches the threshold, or has few links in a level denser than
the body, it is content as it is, short lines too; else in every branch that reaches the
threshold the subtree with the largest sum is content.

Page furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments) is known by
tag, role and class: it counts in the densities of what holds it, but is no content. A class or id counts only by whole names;
doubtful names (``widget``, ``related``) count only on containers and where the text is sparse or
mostly links, and no name where it would take the body of the page.

A page is read once from front to back, in time that grows with its length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, strings

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_BEFORE_VALUE, _BLANK, _SEVERAL = re.compile(r"[^>=]*"), re.compile(r"\s*"), re.compile("<+(?=<)")
_ATTRIBUTE = re.compile(r"([^\s/=>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and others whose content is no text of the page.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_SILENT = frozenset("head noscript template svg math canvas object select datalist".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_FURNITURE = frozenset("nav header footer aside form button dialog menu input fieldset".split()) | _RAW | _SILENT
#: Words that name furniture where they make up a whole class, id or role.
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored nav navbar navigation menubar breadcrumb breadcrumbs "
    "masthead footer sidebar aside complementary contentinfo comment comments disqus cookie cookies consent gdpr popup modal newsletter pagination pager".split()
)
#: Words that name furniture or content; the text decides.
_DOUBTFUL = frozenset("promo banner menu header respond replies notice subscribe share sharing social related recommended login search toolbar widget".split())
#: Words that may stand beside those in one name, as in ``site-footer`` or ``related-posts``.
_BESIDE = frozenset("site page global main primary secondary top bottom left right area bar block box container form inner items links list outer policy posts section slot unit wrap wrapper".split())
#: Elements that doubtful names may take out.
_CONTAINERS = frozenset("div section ul ol dl table tr td".split())
#: The share of the page's text outside links that no name of class or id may take away.
_BODY_SHARE = 0.9
_SPLIT = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")
# A start tag ends these open elements if no element of _SCOPES stands between; of those, cells
# do not stand in the way of what ends cells.
_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CELLS = frozenset(("td", "th"))
_SCOPES = frozenset("ul ol dl table article section div main body html nav header footer aside td th blockquote".split())


class Node:
    """An element: ``out`` if it is furniture, ``silent`` if it has no text of the page either."""

    __slots__ = ("tag", "parent", "children", "out", "silent", "mark", "chars", "links", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, out: bool):
        self.tag, self.parent, self.out, self.mark = tag, parent, out, ""
        self.silent = tag in _RAW or tag in _SILENT
        self.children: list[Node | str] = []


def _named(value: str) -> str:
    """Whether a class, id or role names furniture: ``sure``, ``doubtful`` or empty."""
    found = ""
    for name in value.split():
        words = {w for w in _SPLIT.split(name) if w}
        if words <= _WORDS | _DOUBTFUL | _BESIDE:
            if not _WORDS.isdisjoint(words):
                return "sure"
            if not _DOUBTFUL.isdisjoint(words):
                found = "doubtful"
    return found


def _judge(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is furniture for certain, and what its names say."""
    if tag in _FURNITURE:
        return True, ""
    mark = ""
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, mark
    small = attributes.lower()
    if not any(name in small for name in ("class", "id", "role", "hidden")):
        return False, mark
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, ""
        if name in ("class", "id", "role") and mark != "sure":
            mark = _named(value) or mark
    return False, mark if mark == "sure" or tag in _CONTAINERS else ""


class _Reader:
    """Cuts a page into texts, start tags and end tags in one pass.

    What was once not found ahead is not looked for again, so that no input is read twice.
    """

    def __init__(self, html: str):
        self.html, self.absent = html, set()

    def find(self, mark: str, start: int) -> int:
        """Where ``mark`` comes next, -1 for nowhere."""
        if mark in self.absent:
            return -1
        if (at := self.html.find(mark, start)) < 0:
            self.absent.add(mark)
        return at

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, the page's length if there is none.

        A quote after ``=`` lasts to the next one; a quote that is never closed is none.
        """
        html, size = self.html, len(self.html)
        while (at := _BEFORE_VALUE.match(html, at).end()) < size and html[at] == "=":
            at = _BLANK.match(html, at + 1).end()
            if at < size and html[at] in "\"'":
                at = max(at, self.find(html[at], at + 1)) + 1
        return at

    def tokens(self) -> Iterator[tuple[str, str, str]]:
        """(kind, tag or text, attributes): kind is text, open, empty or close."""
        html, at, size = self.html, 0, len(self.html)
        while at < size:
            if run := _SEVERAL.match(html, at):
                yield "text", run[0], ""
                at = run.end()
                continue
            if html[at] != "<":
                end = self.find("<", at)
                end = size if end < 0 else end
                yield "text", html[at:end], ""
                at = end
                continue
            after = html[at + 1 : at + 2]
            if after in ("!", "?") and after:
                comment = html.startswith("<!--", at)
                end = self.find("-->" if comment else ">", at + (4 if comment else 2))
                at = size if end < 0 else end + (3 if comment else 1)
                continue
            name = _NAME.match(html, at + 1 + (after == "/"))
            if name is None:
                if after == "/":  # a comment by mistake
                    end = self.find(">", at)
                    at = size if end < 0 else end + 1
                else:
                    yield "text", "<", ""
                    at += 1
                continue
            end = self.tag_end(name.end())
            if end < size:
                tag, attributes = name[0].lower(), html[name.end() : end]
                kind = "close" if after == "/" else "empty" if tag in _VOID or attributes.endswith("/") and tag not in _RAW else "open"
                yield kind, tag, attributes
                if kind == "open" and tag in _RAW:
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, end)
                    end = self.tag_end(close.end()) if close else size
            at = end + 1


class _Builder:
    """The open elements of a page, with their places by tag, so that no search climbs the tree."""

    def __init__(self):
        self.root = Node("#root", None, False)
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []  # places of open elements of _SCOPES
        self.tables: list[int] = []  # of those, all but cells

    def last(self, places: list[int] | None) -> int:
        return places[-1] if places else 0

    def close_from(self, place: int) -> None:
        """Close the open element at a place and all within it."""
        while len(self.open) > place:
            tag, at = self.open.pop().tag, len(self.open)
            self.places[tag].pop()
            for places in (self.scopes, self.tables):
                if places and places[-1] == at:
                    places.pop()

    def start(self, tag: str, attributes: str, empty: bool) -> None:
        if tag in _CLOSES_P and (place := self.last(self.places.get("p"))) > self.last(self.scopes):
            self.close_from(place)
        for other in _ENDS.get(tag, ()):
            place = self.last(self.places.get(other))
            wall = self.tables if tag in ("tr", "td", "th") else self.scopes
            if place and (place > self.last(wall) or place == self.last(wall) and other in _CELLS):
                self.close_from(place)
        here = self.open[-1]
        furniture, mark = _judge(tag, attributes)
        node = Node(tag, here, here.out or furniture)
        node.mark = mark
        here.children.append(node)
        if empty or tag in _RAW:
            return
        place = len(self.open)
        self.open.append(node)
        self.places.setdefault(tag, []).append(place)
        if tag in _SCOPES:
            self.scopes.append(place)
            if tag not in _CELLS:
                self.tables.append(place)

    def end(self, tag: str) -> None:
        """Close an element; end tags of inline elements do not reach past an open scope."""
        place = self.last(self.places.get(tag))
        if place and not (tag in _INLINE and place < self.last(self.scopes)):
            self.close_from(place)


def parse(html: str) -> Node:
    """A tree of elements and text; wrong nesting is mended as browsers mostly do.

    A tag that never ends is dropped with what follows it; end tags that end nothing are
    dropped; no markup becomes text.
    """
    builder = _Builder()
    for kind, value, attributes in _Reader(html).tokens():
        if kind == "text":
            builder.open[-1].children.append(unescape(value))
        elif kind == "close":
            builder.end(value)
        else:
            builder.start(value, attributes, kind == "empty")
    return builder.root


def _kept(node: Node) -> list[Node | str]:
    """The children outside the furniture."""
    return [c for c in node.children if isinstance(c, str) or not c.out]


def _walk(root: Node) -> list[Node]:
    """Elements outside the furniture, parents first."""
    order = [root]
    for node in order:
        order += [c for c in node.children if isinstance(c, Node) and not c.out]
    return order


def _chars(text: str) -> int:
    """Characters that are no white space."""
    return len("".join(text.split()))


def composite_density(chars: int, links: int, tags: int, link_tags: int, share: float) -> float:
    """Characters per tag, weighed by links: characters and tags of links, and the body's link share.

    Links weigh a node down: the base of the logarithm grows with its share of links.
    """
    if not chars:
        return 0.0
    tags, link_tags = max(1, tags), max(1, link_tags)
    inner = max(1.0, chars / max(1, links) * tags / link_tags)
    base = math.log(chars / max(1, chars - links) * links + share * chars + math.e)
    if base <= 1:  # no links on the whole page
        return chars / tags * math.log(inner + 1)
    return chars / tags * math.log(inner) / math.log(max(base, 1.0001))


def _counts(children: list[Node | str]) -> tuple[int, int, int, int]:
    """Characters, characters of links, tags and tags of links of some siblings."""
    chars = links = tags = link_tags = 0
    for child in children:
        if isinstance(child, str):
            chars += _chars(child)
        else:
            chars += child.chars
            links += child.links
            tags += child.tags + 1
            link_tags += child.link_tags + (child.tag == "a")
    return chars, links, tags, link_tags


def measure(root: Node) -> float:
    """Set the counts, density and density sum of every element; returns the body's share of links."""
    order = [root]
    for node in order:
        order += [c for c in node.children if isinstance(c, Node) and not c.silent]
    body = next((n for n in order if n.tag == "body"), root)
    for node in reversed(order):
        node.chars, node.links, node.tags, node.link_tags = _counts([c for c in node.children if isinstance(c, str) or not c.silent])
        if node.tag == "a":
            node.links, node.link_tags = node.chars, node.tags
    share = body.links / max(1, body.chars)
    for node in reversed(order):
        node.density = composite_density(node.chars, node.links, node.tags, node.link_tags, share)
        node.total = sum(_chars(c) if isinstance(c, str) else c.density for c in _kept(node))
    return share


def _drop_named(root: Node) -> None:
    """Take out the elements that are furniture by name."""
    order = _walk(root)
    if not any(n.mark for n in order):
        return
    body = next((n for n in order if n.tag == "body"), root)
    structured = set()  # elements with a paragraph, heading or article below them
    for node in reversed(order):
        if node.tag in ("p", "h1", "article", "main") or id(node) in structured:
            structured.add(id(node.parent))
    for node in order:
        if not node.mark:
            continue
        whole = id(node) in structured and node.chars - node.links >= _BODY_SHARE * max(1, body.chars - body.links)
        prose = node.mark == "doubtful" and 2 * node.links < node.chars and node.density >= body.density
        node.out = not whole and not prose
    for node in order:  # parents first
        node.out = node.out or node.parent is not None and node.parent.out


def _heart(order: list[Node]) -> Node:
    return max(order, key=lambda n: n.total)


def _content(root: Node) -> tuple[set[int], set[int]]:
    """The ids of the nodes whose subtrees are the main text, and of those whose own text is."""
    share = measure(root)
    _drop_named(root)
    order = _walk(root)
    for node in order:
        node.total = sum(_chars(c) if isinstance(c, str) else c.density for c in _kept(node))
    body = next((n for n in order if n.tag == "body"), root)
    heart = _heart([n for n in order if body is root or n.tag not in ("#root", "html")])
    path, node = [heart], heart
    while node is not body and node.parent is not None:
        node = node.parent
        path.append(node)
    threshold = min(n.density for n in path)
    chosen, own = {id(heart)}, set()
    for below, node in zip(path, path[1:]):
        beside = [c for c in _kept(node) if c is not below]
        chars, links, *tags = _counts(beside)
        if composite_density(chars, links, *tags, share) >= threshold or (node.density > body.density and 2 * links < chars):
            own.add(id(node))
            chosen.update(id(c) for c in beside if isinstance(c, Node))
        else:
            chosen.update(id(_heart(_walk(c))) for c in beside if isinstance(c, Node) and c.chars and c.density >= threshold)
    return chosen, own


def extract_text(html: str) -> str:
    """The main text of a page, empty if it has none."""
    root = parse(html)
    chosen, own = _content(root)
    parts: list[str] = []
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if isinstance(node, str):
            if inside:
                parts.append(node)
            continue
        if node.out:
            continue
        inside = inside or id(node) in chosen
        if node.tag not in _INLINE:
            parts.append(" ")
            stack.append((" ", inside))
        stack += [(c, inside or isinstance(c, str) and id(node) in own) for c in reversed(node.children)]
    return _SPACE.sub(" ", "".join(parts)).strip()


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Extract every page: id, url, text (empty if none), n_chars in code points.

    A null or empty page has empty text. White space is one space, blocks are joined by one
    space, nothing of the content is dropped or capped. One row per input row, null and
    repeated ids too; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [extract_text(h) if h else "" for h in strings(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html")).mapInArrow(
        run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long"
    )
