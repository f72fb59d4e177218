"""HTML text to rows of nodes: the one step that needs a parser.  Everything built on nodes is DataFrame work.

A node knows its place in document order and the place where its subtree ends, so "inside of" is a test of ranges, and of
each tag that is open around it the innermost place.  Both are bounded by the page's tags, however deep it is.
Where a start tag implies the end of an open element, that is closed.  Formatting that is open when its paragraph closes
is opened again in the next one, as browsers do it by their list of active formatting: at most three equal entries, none
across the border of a cell, and ``MOST_ACTIVE`` in all, so there are at most so many nodes a tag.  What stands in a table
but in no cell is moved before it.  Work and nodes grow with the page, whatever is left open in it.

Pages of plain markup only (``PLAIN``: closed quotes, no stray signs) are cut up by one expression; all others by the
standard parser, which says the same of plain ones but takes several times as long.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FORMATTING = frozenset(("b", "strong", "i", "em", "u", "s", "strike", "del", "code", "small"))
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th")}
SCOPES = frozenset(("table", "ul", "ol", "dl", "select", "body"))
MARKERS = frozenset(("td", "th", "caption", "object"))
#: Elements of a table that hold no content themselves, and what may stand in them.
STRUCTURE = frozenset(("table", "thead", "tbody", "tfoot", "tr"))
IN_TABLE = frozenset("caption col colgroup thead tbody tfoot tr td th script style template form".split())
EQUAL_ENTRIES, MOST_ACTIVE = 3, 32

#: Markup that can be read in one way only: a start tag with its attributes, an end tag, text, a comment, a document type.
PLAIN = re.compile(
    r"""(<([a-zA-Z][a-zA-Z0-9-]*)((?:[ \t\n\r\f]+[a-zA-Z_][\w:.-]*(?:=(?:"[^"]*"|'[^']*'|[\w.:#%+-]+(?!/)))?)*)[ \t\n\r\f]*(/?)>|</([a-zA-Z][a-zA-Z0-9-]*)[ \t\n\r\f]*>|([^<]+)|<!--((?:(?!--)[^<>])*)-->|<!(?i:doctype)[^<>]*>)""",
    re.ASCII,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_][\w:.-]*)(?:=(?:"([^"]*)"|'([^']*)'|([\w.:#%+-]+)))?""", re.ASCII)
#: Elements in which parsers may read text in a way of its own, and references that all read alike.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext svg math".split())
REFERENCE = re.compile(r"&(?!#?[a-zA-Z0-9]+;)")

NODE = "page_id long, pos int, parent int, last int, within map<string,int>, tag string, attrs map<string,string>, text string"
_FIELDS = ("pos", "parent", "last", "within", "tag", "attrs", "text")


class _Node:
    __slots__ = ("attrs", "children", "pos", "tag", "text", "within")

    def __init__(self, tag: str, attrs: dict[str, str], text: str | None, within: dict[str, _Node]) -> None:
        self.tag, self.attrs, self.text, self.within = tag, attrs, text, within
        self.children: list[_Node] | tuple = [] if text is None else ()
        self.pos = -1


class _Open:
    """An open element: ``around`` has the innermost element by tag, itself included, ``depth`` the innermost place on the
    stack by tag that no scope separates from it."""

    __slots__ = ("around", "depth", "node")

    def __init__(self, node: _Node, around: dict[str, _Node], depth: dict[str, int]) -> None:
        self.node, self.around, self.depth = node, around, depth


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {}, None, {})
        self.open = [_Open(self.root, {}, {})]
        self.active: list[tuple[str, dict[str, str], _Node | None] | None] = []  # formatting by age, None being a marker
        self.live: set[int] = set()  # open formatting

    def _add(self, tag: str, attrs: dict, text: str | None) -> tuple[_Node, dict[str, _Node]]:
        """A new node below the innermost open element, or before its table; and what is around it."""
        above = self.open[-1]
        if above.node.tag in STRUCTURE and tag not in IN_TABLE and (text is None or text.strip()) and not tag.startswith("#comment"):
            at = above.depth.get("table", 0)
            if at:
                holder = self.open[at - 1]
                node = _Node(tag, attrs, text, holder.around)
                holder.node.children.insert(len(holder.node.children) - 1, node)
                return node, holder.around
        node = _Node(tag, attrs, text, above.around)
        above.node.children.append(node)
        return node, above.around

    def _push(self, node: _Node, around: dict[str, _Node]) -> None:
        tag, at = node.tag, len(self.open)
        self.open.append(_Open(node, around | {tag: node}, {tag: at} if tag in SCOPES else self.open[-1].depth | {tag: at}))
        if tag in FORMATTING:
            self.live.add(id(node))
        if tag in MARKERS:
            self.active.append(None)

    def _pop_to(self, depth: int) -> None:
        for x in self.open[depth:]:
            tag = x.node.tag
            if tag in FORMATTING:
                self.live.discard(id(x.node))
            if tag in MARKERS:
                while self.active and self.active.pop() is not None:
                    pass
        del self.open[depth:]

    def _close(self, tags: tuple[str, ...]) -> None:
        """Close the innermost open element of these tags, unless a scope lies in between."""
        depth = self.open[-1].depth
        at = depth.get(tags[0], 0) if len(tags) == 1 else max([depth.get(t, 0) for t in tags])
        if at:
            self._pop_to(at)

    def _since_marker(self) -> int:
        n = len(self.active)
        while n and self.active[n - 1] is not None:
            n -= 1
        return n

    def _note(self, tag: str, attrs: dict, node: _Node) -> None:
        """Enter formatting into the list; of three equal entries the oldest goes."""
        first = self._since_marker()
        equal = [i for i in range(first, len(self.active)) if self.active[i][:2] == (tag, attrs)]
        if len(equal) >= EQUAL_ENTRIES:
            del self.active[equal[0]]
        elif len(self.active) - first >= MOST_ACTIVE:
            del self.active[first]
        self.active.append((tag, attrs, node))

    def _reopen(self) -> None:
        """Open again what is in the list but not open, up to the newest marker."""
        if not self.active:
            return
        for i in range(self._since_marker(), len(self.active)):
            tag, attrs, node = self.active[i]
            if id(node) not in self.live:
                node, around = self._add(tag, attrs, None)
                self._push(node, around)
                self.active[i] = (tag, attrs, node)

    def updatepos(self, i: int, j: int) -> int:
        """Lines are not counted, as nothing asks for them."""
        return j

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._close(("p",))
        if tag in IMPLIED:
            if tag in IN_TABLE:
                inner = max((self.open[-1].depth.get(t, 0), t in STRUCTURE) for t in (*STRUCTURE, "td", "th", "caption"))
                if inner[0] and inner[1]:  # what was moved out of the table ends where the table goes on
                    self._pop_to(inner[0] + 1)
            for _ in range(2):
                self._close(IMPLIED[tag])
        formatting, void = tag in FORMATTING, tag in VOID
        if formatting or void:
            self._reopen()
        values = {k: v or "" for k, v in attrs}
        node, around = self._add(tag, values, None)
        if not void:
            self._push(node, around)
            if formatting:
                self._note(tag, values, node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in FORMATTING:
            for i in range(len(self.active) - 1, self._since_marker() - 1, -1):
                if self.active[i][0] == tag:
                    waiting = id(self.active[i][2]) not in self.live
                    del self.active[i]
                    if waiting:  # closed already, with its paragraph
                        return
                    break
        self._close((tag,))

    def handle_data(self, data: str) -> None:
        if self.active and data.strip():
            self._reopen()
        self._add("#text", {}, data)

    def handle_comment(self, data: str) -> None:
        self._add("#comment", {}, data)


def _attributes(source: str) -> list[tuple[str, str]] | None:
    """Attributes of a plain start tag; null if parsers may read a reference differently."""
    found = [(k.lower(), a or b or c) for k, a, b, c in ATTRIBUTE.findall(source)]
    if "&" in source:
        if any(REFERENCE.search(v) for _, v in found):
            return None
        found = [(k, unescape(v)) for k, v in found]
    return found


def _events(html: str) -> list[tuple] | None:
    """What a page of plain markup consists of: handlers' names and arguments; null for any other page."""
    tokens = PLAIN.findall(html)
    if sum([len(t[0]) for t in tokens]) != len(html):
        return None
    events: list[tuple] = []
    raw = ""  # the element whose text is being read, where that is special
    for whole, start, attrs, slash, end, data, comment in tokens:
        if data:
            if "&" in data:
                if raw:
                    return None
                data = unescape(data)
            events.append(("text", data, None))
        elif raw and end.lower() != raw:
            return None
        elif start:
            start = start.lower()
            found = _attributes(attrs) if attrs else []
            if found is None:
                return None
            events.append(("start", start, found))
            if start in RAW:
                if slash:
                    return None
                raw = start
        elif end:
            raw = ""
            events.append(("end", end.lower(), None))
        elif whole[2] == "-":
            events.append(("comment", comment, None))
    return None if raw else events


def _built(html: str) -> _Builder:
    b = _Builder()
    events = _events(html)
    if events is None:
        b.feed(html)
        b.close()
        return b
    start, end, text, comment = b.handle_starttag, b.handle_endtag, b.handle_data, b.handle_comment
    for kind, value, attrs in events:
        if kind == "text":
            text(value)
        elif kind == "start":
            start(value, attrs)
        elif kind == "end":
            end(value)
        else:
            comment(value)
    return b


def nodes_of(html: str | None) -> list[list]:
    """Nodes of a document in order: ``pos, parent, last, within, tag, attrs, text``."""
    rows: list[list] = []
    waiting = [(x, -1, []) for x in reversed(_built(html or "").root.children)]
    while waiting:
        node, parent, within = waiting.pop()
        pos = node.pos = len(rows)
        rows.append([pos, parent, pos, within, node.tag, list(node.attrs.items()), node.text])
        if node.children:
            around = [(t, x.pos) for t, x in node.children[0].within.items()]  # the same for all of them
            waiting += [(x, pos, around) for x in reversed(node.children)]
            node.children = []  # no circle is left for the collector
    for row in reversed(rows):
        if row[1] >= 0:
            above = rows[row[1]]
            if above[2] < row[2]:
                above[2] = row[2]
    return rows


def node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``page_id, html`` to rows of nodes; a document's nodes go out before the next is parsed."""
    yield from _batches(batches, None)


def batches_of(tags: tuple[str, ...], within: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """:func:`node_batches` for what reads nodes of some tags only (all without any): the others are parsed, but not
    written; nor is ``within`` (null then), for what does not read it."""
    return functools.partial(_batches, tags=frozenset(tags) or None, within=within)


def _batches(batches: Iterator[pa.RecordBatch], tags: frozenset[str] | None, within: bool = True) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held: list[list] = []
        pages: list[int | None] = []
        for page, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows = nodes_of(html.as_py())
            if tags is not None:
                rows = [row for row in rows if row[4] in tags]
            if not within:
                for row in rows:
                    row[3] = None
            held += rows
            pages += [page] * len(rows)
            if len(held) > 20_000:
                yield _batch(pages, held)
                held, pages = [], []
        if held:
            yield _batch(pages, held)


_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.int32()), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())


def _batch(pages: list, rows: list[list]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), *columns], names=["page_id", *_FIELDS])
