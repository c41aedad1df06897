"""Visible text of HTML pages, laid out.

A *tokenizer* cuts the page into tags, text and comments by the rules browsers
use for broken markup: raw text elements, attributes in any quoting, a stray
``<`` is text. A *tree builder* keeps a stack of open elements and implies what
authors leave out: end tags of paragraphs, list items, options, table parts and
definition terms, the closing of everything inside a closed block, rows and
sections of tables. *Visibility rules* leave out the head but for nothing else
visible, scripts, styles, templates, elements with ``hidden``
or a style of ``display:none``, hidden inputs and closed dialogs; what a style of
``visibility:hidden`` hides takes no room either, but for elements in it that a
``visibility:visible`` shows again. A *renderer* lays the rest out:

* white space is collapsed, but kept in ``pre`` and ``textarea``;
* blocks begin on lines of their own; paragraphs, headings, lists, tables and
  the like are set apart by one blank line;
* list items carry ``-`` or their number (``start``, ``value`` and ``reversed``
  are honoured), and nested lists and quotations are indented;
* table cells are aligned in columns, with ``colspan`` and ``rowspan``, and cells
  of several lines are aligned line by line; a table in a cell is laid out first;
* images give their ``alt`` text, inputs their value, ``br`` and ``hr`` breaks.

All visible text is emitted, in order; nothing is judged to be boilerplate.

Defined results: a null page gives null text and no blocks; an empty page gives
an empty text; unclosed or stray tags never fail; elements nest to any depth, on
explicit stacks (indents show up to ``MAX_INDENT`` columns); repeated rows give equal rows. Pages are
handled one at a time on the map side, without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathloom.llm.common import batched, rows

#: Deeper indents are shown as this one, so that what they add stays in proportion to the lines.
MAX_INDENT = 800

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|[!?](?P<odd>[^>]*)(?:>|\Z)|/(?P<end>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|(?P<start>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible|initial)\b", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW = frozenset("textarea title".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes audio video canvas datalist map meta link base param source track".split())
#: Set apart by a blank line, and merely on lines of their own.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset hr details".split())
LINES = frozenset("html body div section article header footer main nav aside address form li dt dd tr caption figcaption legend option optgroup summary center dir menu search hgroup dialog select thead tbody tfoot".split())
BLOCKS = APART | LINES
#: What may stand in the head; anything else, and text, ends it.
IN_HEAD = frozenset("head base basefont bgsound link meta title style script noscript noframes template".split())
#: Elements of drawings and formulas that browsers don't show, those whose content is HTML again, and tags that end drawing and formula.
FOREIGN_UNSEEN = {"svg": frozenset("defs symbol clippath mask marker pattern metadata desc".split()), "math": frozenset(["annotation", "annotation-xml"])}
FOREIGN_HTML = {"svg": frozenset(["foreignobject", "desc", "title"]), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
FOREIGN_ENDERS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: A start tag on the left ends an open element on the right, up to the nearest element that scopes it.
ENDS: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
}
P_ENDERS = BLOCKS - frozenset("li dt dd tr caption option optgroup html body select thead tbody tfoot legend summary".split()) | frozenset("li dt dd".split())
P_SCOPE = frozenset("td th caption table button li dd dt object body html".split())


@dataclass
class Node:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list["Node | str"] = field(default_factory=list)
    kind: str = ""  # svg, math or HTML

    def inside(self) -> str:
        """The kind of what stands in it."""
        return "" if not self.kind or self.name in FOREIGN_HTML[self.kind] else self.kind


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """('text' | 'start' | 'end', name or text, attributes); a tag closed by itself has the attribute ``/``."""
    at, n = 0, len(page)
    lowered = None
    foreign = 0
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            break
        if m.start() > at:
            yield "text", html.unescape(page[at : m.start()]), {}
        at = m.end()
        if m["end"]:
            name = m["end"].lower()
            foreign -= foreign > 0 and name in FOREIGN_HTML
            yield "end", name, {}
        elif m["start"]:
            name = m["start"].lower()
            attributes: dict[str, str] = {}
            for key, a, b, c in _ATTRIBUTE.findall(m["rest"]) if m["rest"] else ():
                attributes.setdefault(key.lower(), html.unescape(a or b or c))
            alone = m["rest"].endswith("/")
            if alone:
                attributes["/"] = ""
            foreign += name in FOREIGN_HTML and not alone
            yield "start", name, attributes
            if (name in RAW or name in ESCAPABLE_RAW) and not (foreign and alone):
                lowered = page.lower() if lowered is None and page.isascii() else lowered
                close = _close(page, lowered, name, at)
                if close > at:
                    raw = page[at:close]
                    yield "text", html.unescape(raw) if name in ESCAPABLE_RAW else raw, {}
                at = close
    if at < n:
        yield "text", html.unescape(page[at:]), {}


def _close(page: str, lowered: str | None, name: str, at: int) -> int:
    """Where the end tag of a raw text element begins, or the end of the page."""
    if lowered is not None:
        while (found := lowered.find(f"</{name}", at)) >= 0:
            if lowered[found + 2 + len(name) : found + 3 + len(name)] in (">", "/", " ", "\t", "\n", "\r", "\f", ""):
                return found
            at = found + 2
        return len(page)
    m = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
    return m.start() if m else len(page)


def tree(page: str) -> Node:
    """The element tree, with implied tags."""
    root = Node("html")
    stack = [root]
    places: dict[str, list[int]] = {}  # where elements of a name are open

    def cut(k: int) -> None:
        for node in stack[k:]:
            places[node.name].pop()
        del stack[k:]

    def nearest(names: frozenset) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(names: frozenset, scope: frozenset) -> bool:
        """Close the nearest open element of ``names`` and all in it, unless one of ``scope`` lies between."""
        k = nearest(names)
        if not k or nearest(scope) > k:
            return False
        cut(k)
        return True

    def open_(name: str, attributes: dict[str, str]) -> None:
        kind = name if name in FOREIGN_HTML else stack[-1].inside()
        node = Node(name, attributes, kind=kind)
        stack[-1].children.append(node)
        if name not in VOID and not (kind and "/" in attributes):
            places.setdefault(name, []).append(len(stack))
            stack.append(node)

    for kind, name, attributes in tokens(page):
        if stack[-1].name == "head" and (name.strip(" \t\n\r\f") if kind == "text" else name not in IN_HEAD if kind == "start" else name in ("br", "body", "html")):
            cut(len(stack) - 1)
        if kind == "text":
            stack[-1].children.append(name)
        elif kind == "start":
            if name in ("html", "body"):
                root.attributes |= attributes
                if name == "body":
                    close(frozenset(["head"]), frozenset())
                continue
            if name in FOREIGN_ENDERS:
                while stack[-1].inside():
                    cut(len(stack) - 1)
            if name in P_ENDERS:
                close(frozenset(["p"]), P_SCOPE)
            if name in ENDS:
                names, scope = ENDS[name]
                while close(names, scope):
                    pass
                if name in ("td", "th") and stack[-1].name in ("table", "thead", "tbody", "tfoot"):
                    open_("tr", {})
            if name == "head" and len(stack) > 1:
                continue
            open_(name, attributes)
        elif name == "br":
            open_("br", {})
        elif name == "p":
            if not close(frozenset(["p"]), P_SCOPE):
                open_("p", {})
                cut(len(stack) - 1)
        elif name not in ("html", "body"):
            scope = frozenset(["td", "th", "caption"]) if name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption") else frozenset()
            close(frozenset([name]), scope | (frozenset(["table"]) if name != "table" else frozenset()))
    return root


def visible(node: Node) -> bool:
    a = node.attributes
    if node.name in UNSEEN or node.kind and node.name in FOREIGN_UNSEEN[node.kind] or "hidden" in a:
        return False
    if node.name == "object" and "data" in a:  # what it names stands in for its content
        return False
    if "style" in a and _GONE.search(a["style"]):
        return False
    if node.name == "dialog" and "open" not in a:
        return False
    return not (node.name == "input" and a.get("type", "").lower() in ("hidden", "password", "checkbox", "radio", "file", "color", "range", "image"))


def seen(node: Node, before: bool) -> bool:
    """Whether the text of a node shows, by its style or as that of its parent."""
    found = _VISIBILITY.findall(node.attributes["style"]) if "style" in node.attributes else ()
    return found[-1].lower() in ("visible", "initial") if found else before


class Lines:
    """Lines of laid-out text: collapsed inline text, breaks between blocks, indents."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0  # blank lines wanted before the next text
        self.indent = 0
        self.marker = ""
        self.blocks = 0
        self.fresh = True

    def text(self, data: str) -> None:
        if not data:
            return
        words = _SPACE.split(data)
        if len(words) == 1:
            self.word(data)
            return
        for k, w in enumerate(words):
            if k:
                self.space = True
            if w:
                self.word(w)

    def word(self, w: str) -> None:
        if self.parts and self.space:
            self.parts.append(" ")
        self.parts.append(w)
        self.space = False

    def kept(self, data: str) -> None:
        """Text whose white space counts."""
        pieces = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for k, line in enumerate(pieces):
            if k:
                self.line(keep=True)
            if line:
                self.parts.append(line.replace("\t", "    "))

    def line(self, keep: bool = False) -> None:
        """End the current line; an empty one is only kept inside preformatted text."""
        if self.parts or self.marker and keep:
            self._flush("".join(self.parts))
        elif keep:
            self._flush("")
        self.parts, self.space = [], False

    def _flush(self, text: str) -> None:
        if self.gap and self.done:
            self.done += [""] * self.gap
        if self.fresh:
            self.blocks += 1
        self.gap, self.fresh = 0, False
        lead = " " * min(self.indent, MAX_INDENT)
        if self.marker:
            lead = lead[: max(0, len(lead) - len(self.marker))] + self.marker
            self.marker = ""
        self.done.append((lead + text).rstrip())

    def block(self, apart: bool) -> None:
        self.line()
        self.fresh = True
        if apart:
            self.gap = 1

    def finish(self) -> list[str]:
        self.line()
        return self.done


def _number(value: str | None, default: int, low: int = -(10**9), high: int = 10**9) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return min(high, max(low, int(m[1]))) if m else default


#: A step of the layout: yields the steps it waits for, and is sent what they return.
Step = Generator["Step", object, object]


def _run(step: Step) -> object:
    """The result of a step, on a stack of its own in place of Python's."""
    stack, result = [step], None
    while stack:
        try:
            inner = stack[-1].send(result)
        except StopIteration as end:
            stack.pop()
            result = end.value
        else:
            stack.append(inner)
            result = None
    return result


def _render(node: Node, out: Lines, kept: bool, seen_: bool, shown: bool = True) -> Step:
    """Lay out what is in a node; texts, marks and rules only where they are ``seen_``, in a drawing only texts that are ``shown``."""
    for child in node.children:
        if isinstance(child, str):
            if shown and seen_:
                out.kept(child) if kept else out.text(child)
            continue
        if not visible(child):
            continue
        name, own = child.name, seen(child, seen_)
        if child.kind == "svg":
            apart = name in ("svg", "text", "foreignobject")
            out.space |= apart
            yield _render(child, out, kept and not apart, own, name in ("text", "foreignobject") or shown and name != "svg")
            out.space |= apart
        elif name == "br":
            out.line(keep=True) if own and (out.parts or kept) else None
        elif name == "hr":
            out.block(True)
            out.text("---" if own else "")
            out.block(True)
        elif name == "img":
            if own and (alt := child.attributes.get("alt", "")):
                out.text(alt)
        elif name == "input":
            out.text((child.attributes.get("value") or child.attributes.get("placeholder", "")) if own else "")
        elif name == "wbr":
            pass
        elif name == "details" and "open" not in child.attributes:
            out.block(True)
            yield _render(Node("details", {}, [c for c in child.children if isinstance(c, Node) and c.name == "summary"]), out, kept, own)
            out.block(True)
        elif name == "table":
            out.block(True)
            for line in (yield _table(child, own)):
                out.parts = [line]
                out.line()
            out.block(True)
        elif name in ("ul", "ol", "menu", "dir"):
            nested = node.name == "li"
            out.block(not nested)
            yield _list(child, out, kept, own)
            out.block(not nested)
        elif name in ("blockquote", "dd", "figure"):
            out.block(name in APART)
            out.indent += 4
            yield _render(child, out, kept, own)
            out.block(name in APART)
            out.indent -= 4
        elif name in ("pre", "textarea", "listing"):
            out.block(name == "pre")
            if child.children and isinstance(child.children[0], str) and child.children[0].startswith("\n"):
                child.children[0] = child.children[0][1:]
            yield _render(child, out, True, own)
            out.block(name == "pre")
        elif name in BLOCKS:
            out.block(name in APART)
            yield _render(child, out, kept, own)
            out.block(name in APART)
        elif name == "q":
            out.text("\"" if own else "")
            yield _render(child, out, kept, own)
            out.text("\"" if own else "")
        else:
            if name in ("td", "th"):  # a cell outside of a table
                out.space = True
            yield _render(child, out, kept, own)


def _list(node: Node, out: Lines, kept: bool, seen_: bool) -> Step:
    items = [c for c in node.children if isinstance(c, Node) and c.name == "li" and visible(c)]
    down = "reversed" in node.attributes
    at = _number(node.attributes.get("start"), len(items) if down else 1)
    for child in node.children:
        if isinstance(child, Node) and child.name == "li":
            if not visible(child):
                continue
            own = seen(child, seen_)
            at = _number(child.attributes.get("value"), at)
            marker = f"{at}. " if node.name == "ol" else "- "
            at += -1 if down else 1
            before = out.indent
            out.block(False)
            out.indent += len(marker)
            out.marker = marker if own else ""
            yield _render(child, out, kept, own)
            out.block(False)
            out.indent, out.marker = before, ""
        else:
            yield _render(Node(node.name, {}, [child]), out, kept, seen_)


def _lay(node: Node, seen_: bool) -> Step:
    own = Lines()
    yield _render(node, own, False, seen_)
    return own.finish()


def _table(node: Node, seen_: bool) -> Step:
    """The lines of a table: captions, then rows with cells in aligned columns."""
    captions: list[str] = []
    grid: list[list[tuple[int, list[str]]]] = []
    spans: dict[int, int] = {}  # columns that cells above still fill, and for how many rows

    def row(node: Node, seen_: bool) -> Step:
        column, cells = 0, []
        filled = {c: n for c, n in spans.items() if n > 0}
        for c in filled:
            spans[c] -= 1
        for cell in node.children:
            if not isinstance(cell, Node) or not visible(cell):
                if isinstance(cell, str) and seen_ and cell.strip():
                    captions.append(_SPACE.sub(" ", cell).strip())
                continue
            if cell.name not in ("td", "th"):
                captions.extend((yield _lay(Node("div", {}, [cell]), seen_)))
                continue
            while column in filled:
                column += 1
            cells.append((column, (yield _lay(cell, seen(cell, seen_)))))
            wide = _number(cell.attributes.get("colspan"), 1, 1, 1000)
            tall = _number(cell.attributes.get("rowspan"), 1, 0, 65534)
            for c in range(column, column + wide):
                if tall != 1:
                    spans[c] = (tall - 1) if tall else 65534
            column += wide
        grid.append(cells)

    def walk(node: Node, seen_: bool) -> Step:
        for child in node.children:
            if isinstance(child, str):
                if seen_ and child.strip(" \t\n\r\f"):
                    captions.append(_SPACE.sub(" ", child).strip())
            elif not visible(child):
                continue
            elif child.name == "tr":
                yield row(child, seen(child, seen_))
            elif child.name in ("thead", "tbody", "tfoot"):
                spans.clear()
                yield walk(child, seen(child, seen_))
            elif child.name not in ("col", "colgroup"):
                captions.extend((yield _lay(Node("div", {}, [child]), seen_)))

    yield walk(node, seen_)
    # Columns in which no cell begins take no room.
    place = {c: k for k, c in enumerate(sorted({c for cells in grid for c, _ in cells}))}
    width = [0] * len(place)
    for cells in grid:
        for k, (c, lines) in enumerate(cells[:-1]):
            if place[cells[k + 1][0]] - place[c] == 1:
                width[place[c]] = max(width[place[c]], *map(len, lines), 0) if lines else width[place[c]]
    begins = list(accumulate((w + 2 for w in width), initial=0))
    out = list(captions)
    for cells in grid:
        for at in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for c, lines in cells:
                begin = begins[place[c]]
                here = lines[at] if at < len(lines) else ""
                if here:
                    line = (line.ljust(begin) if len(line) + 2 <= begin or not line else line + "  ") + here
            if line:
                out.append(line.rstrip())
    return out


def visible_text(page: str | None) -> tuple[str | None, int]:
    """The laid-out text of a page and its number of blocks."""
    if page is None:
        return None, 0
    out = Lines()
    root = tree(page)
    if visible(root):
        _run(_render(root, out, False, seen(root, True)))
    lines = out.finish()
    return "\n".join(lines), out.blocks


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """One row per page: page_id, text, n_blocks, n_chars."""
    schema = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_blocks", pa.int64()), ("n_chars", pa.int64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for page_id, page in rows(batches, "page_id", "html"):
            text, blocks = visible_text(page)
            yield page_id, text, blocks, None if text is None else len(text)

    chosen = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(html_column).cast("string").alias("html"))
    return chosen.mapInArrow(lambda it: batched(make(it), schema, 256), "page_id long, text string, n_blocks long, n_chars long")
