"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder with the usual implied tags turn a page into a tree; rendering walks it and emits all
visible text. Blocks start on lines of their own, paragraphs, headings, lists and tables are set off by a blank line,
list items carry a marker, table cells are aligned in columns, pre keeps its white space, and what a page hides
(scripts, styles, templates, head matter, the hidden attribute, display:none and the like) is left out.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style template head title noscript iframe noembed noframes object audio video canvas datalist".split())
#: Not shown within svg or math.
UNSEEN = {"svg": frozenset("desc metadata defs symbol".split()), "math": frozenset("annotation annotation-xml".split())}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
#: An open element that a start tag closes, if no element of the second set is opened between them.
_LISTS, _TABLES = frozenset("ul ol menu dir table td th".split()), frozenset(["table"])
IMPLIED_END = {
    "li": (frozenset(["li"]), _LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), _TABLES),
    "th": (frozenset(["td", "th"]), _TABLES),
    "tr": (frozenset(["td", "th", "tr", "caption", "colgroup"]), _TABLES),
    "tbody": (frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"]), _TABLES),
    "body": (frozenset(["head"]), frozenset()),
}
IMPLIED_END["thead"] = IMPLIED_END["tfoot"] = IMPLIED_END["tbody"]
CLOSES_P = BLOCK - frozenset("body html li td th tr tbody thead tfoot caption option optgroup dd dt legend summary".split())
FENCE = frozenset("table td th button object html body".split())
#: Nesting beyond this is flattened: what deeper elements show joins their ancestor of this depth.
MAX_DEPTH = 400

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|(?![\"'\s])|(?=>)))*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_MAY_HIDE = re.compile(r"hidden|none|collapse", re.I)
_START = re.compile(r"\bstart\s*=\s*[\"']?\s*(-?\d{1,9})", re.I)
_BLANKS = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("children", "hidden", "start", "tag")

    def __init__(self, tag: str, hidden: bool = False, start: int = 1):
        self.tag, self.hidden, self.start, self.children = tag, hidden, start, []


@lru_cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


def _hides(attributes: str) -> bool:
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "style" and _NOT_SHOWN.search(value):
            return True
    return False


def parse(page: str) -> Node:
    """The tree of a page. Children are nodes and strings, whose character references are resolved."""
    root = Node("html")
    stack = [root]
    opened: defaultdict[str, list[int]] = defaultdict(list)  # by tag, the places in stack of its open elements
    at, size, last = 0, len(page), page.rfind(">")

    def text(part: str) -> None:
        if part:
            stack[-1].children.append(html.unescape(part) if "&" in part else part)

    def push(node: Node) -> None:
        opened[node.tag].append(len(stack))
        stack.append(node)

    def cut(place: int) -> None:
        while len(stack) > place:
            opened[stack.pop().tag].pop()

    def shield(fence: frozenset) -> int:
        return max((opened[tag][-1] for tag in fence if opened.get(tag)), default=0)

    def close(tags: frozenset, fence: frozenset) -> None:
        """Closes the outermost open element of tags that no element of fence shields."""
        inside = [own for tag in tags if (own := opened.get(tag))]
        if inside:
            low = shield(fence)
            cut(min((own[k] for own in inside if (k := bisect_right(own, low)) < len(own)), default=len(stack)))

    def attach(node: Node) -> None:
        """Beyond MAX_DEPTH an element that is shown shares its parent's children, a hidden one is not in the tree."""
        if len(stack) < MAX_DEPTH or node.tag in VOID or node.tag in RAW:
            stack[-1].children.append(node)
        elif not node.hidden:
            stack[-1].children.append(Node(node.tag))  # where its lines begin
            node.children = stack[-1].children

    while at < size:
        opening = page.find("<", at)
        if opening < 0 or opening + 1 == size:
            text(page[at:])
            break
        text(page[at:opening])
        if page[opening + 1] in "!?":
            comment = page.startswith("<!--", opening)
            end = page.find("-->" if comment else ">", opening + 2)
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        m = _TAG.match(page, opening) if opening < last else None
        if m is None:
            text("<")
            at = opening + 1
            continue
        at = m.end()
        closing, tag, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        tag = tag.lower()
        if closing:
            if tag in ("br", "p") and not opened.get(tag):
                stack[-1].children.append(Node(tag))  # </br> and a stray </p> stand for empty elements
                continue
            fence = frozenset() if tag in ("table", "body", "html") else FENCE - {tag}
            if opened.get(tag) and opened[tag][-1] > shield(fence):
                cut(opened[tag][-1])
            continue
        if tag == "html":
            continue
        if tag in IMPLIED_END:
            close(*IMPLIED_END[tag])
        if tag in CLOSES_P or tag in ("li", "dd", "dt"):
            close(frozenset(["p"]), FENCE | {"li", "dd", "dt", "div"} if tag in CLOSES_P else FENCE | {"div"})
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            attach(row)
            push(row)
        hidden = tag in HIDDEN or bool(attributes and _MAY_HIDE.search(attributes) and _hides(attributes))
        foreign = max((x for x in UNSEEN if opened.get(x)), key=lambda x: opened[x][-1], default=None)
        hidden = hidden or foreign is not None and tag in UNSEEN[foreign]
        start = int(s.group(1)) if tag == "ol" and attributes and (s := _START.search(attributes)) else 1
        node = Node(tag, hidden, start)
        attach(node)
        if tag in VOID or (foreign or tag in UNSEEN) and attributes and attributes.rstrip().endswith("/"):
            continue
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            if tag == "textarea":
                node.children.append(html.unescape(page[at : end.start() if end else size]))
            elif tag == "xmp":
                node.children.append(page[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        if tag == "plaintext":
            node.children.append(page[at:])
            break
        push(node)
    return root


def width(text: str) -> int:
    """Columns that a text takes: two for wide East Asian characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Canvas:
    """Lines of output with collapsed white space."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False  # a blank is due before the next text of this line
        self.gap = False  # a blank line is due before the next text
        self.marker = ""

    def put(self, text: str, pre: bool = False) -> None:
        if pre:
            first, *more = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self._piece(first)
            for line in more:
                self._end(keep=True)
                self._piece(line)
            return
        words = _BLANKS.split(text)
        if words == [""]:
            return
        if words[0] == "":
            self.blank = True
        body = " ".join(w for w in words if w)
        if body:
            if self.blank and self.now:
                self.now.append(" ")
            self.blank = False
            self._piece(body)
        if words[-1] == "" and self.now:
            self.blank = True

    def _piece(self, text: str) -> None:
        if not text:
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        if self.marker:
            self.now.append(self.marker)
            self.marker = ""
        self.now.append(text)

    def _end(self, keep: bool = False) -> None:
        line = "".join(self.now)
        if line.strip() or keep and self.lines:
            self.lines.append(line.rstrip())
        self.now, self.blank = [], False

    def line(self) -> None:
        if self.now:
            self._end()
        self.blank = False

    def space(self) -> None:
        self.line()
        self.gap = True

    def block(self, lines: list[str]) -> None:
        self.line()
        for i, line in enumerate(lines):
            if line:
                self._piece(line)
                self._end()
            elif i:
                self._end(keep=True)

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _render(node: Node, out: Canvas, pre: bool = False) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.put(child, pre)
            continue
        tag = child.tag
        if child.hidden:
            continue
        if tag == "br":
            if out.now:
                out._end()
            else:
                out.gap = True
        elif tag == "hr":
            out.space()
        elif tag == "table":
            out.space()
            out.block(_table(child))
            out.space()
        elif tag in ("ul", "ol", "menu", "dir"):
            _list(child, out, tag == "ol")
        elif tag in BLOCK:
            (out.space if tag in SPACED else out.line)()
            _render(child, out, pre or tag in ("pre", "xmp"))
            (out.space if tag in SPACED else out.line)()
        else:
            _render(child, out, pre or tag == "textarea")


def _list(node: Node, out: Canvas, numbered: bool) -> None:
    out.space()
    number = node.start
    for child in node.children:
        if isinstance(child, str):
            out.put(child)
        elif child.hidden:
            continue
        elif child.tag == "li":
            inner = Canvas()
            _render(child, inner)
            lines = inner.done()
            mark = f"{number}. " if numbered else "- "
            number += 1
            if lines:
                out.block([mark + lines[0], *((" " * len(mark) + x if x else "") for x in lines[1:])])
        else:
            inner = Canvas()
            _render(_only(child), inner)
            out.block(["  " + x if x else "" for x in inner.done()])
    out.space()


def _only(node: Node) -> Node:
    holder = Node("div")
    holder.children.append(node)
    return holder


def _rows(node: Node, rows: list[list[list[str]]], titles: list[str]) -> None:
    for child in node.children:
        if isinstance(child, str) or child.hidden:
            if isinstance(child, str) and child.strip():
                titles.append(" ".join(child.split()))
        elif child.tag == "tr":
            cells = []
            for cell in child.children:
                if isinstance(cell, str):
                    if cell.strip():
                        cells.append([" ".join(cell.split())])
                elif not cell.hidden:
                    inner = Canvas()
                    _render(cell if cell.tag in ("td", "th") else _only(cell), inner)
                    cells.append(inner.done())
            if any(cells):
                rows.append(cells)
        elif child.tag in ("tbody", "thead", "tfoot"):
            _rows(child, rows, titles)
        else:
            inner = Canvas()
            _render(child if child.tag == "caption" else _only(child), inner)
            titles += inner.done()


def _table(node: Node) -> list[str]:
    """Lines of a table: captions and stray text first, then rows with their cells padded to the columns' widths."""
    rows: list[list[list[str]]] = []
    titles: list[str] = []
    _rows(node, rows, titles)
    if not rows:
        return titles
    wide = [0] * max(map(len, rows))
    if len(wide) > 1:
        for row in rows:
            for i, cell in enumerate(row):
                wide[i] = max([wide[i], *map(width, cell)])
    out = titles
    for row in rows:
        for k in range(max(map(len, row))):
            line = ""
            for i, cell in enumerate(row):
                part = cell[k] if k < len(cell) else ""
                line += part + (" " * (wide[i] - width(part) + 2) if i + 1 < len(row) else "")
            out.append(line.rstrip())
    return out


def extract(page: str | None) -> str:
    """All visible text of a page; empty for null."""
    if not page:
        return ""
    out = Canvas()
    _render(parse(page.replace("\0", "")), out)
    return "\n".join(out.done())


def title(page: str | None) -> str | None:
    """The text of a page's first title element, or null."""
    m = re.search(r"<title(?:\s[^>]*)?>(.*?)</title\s*>", page or "", re.I | re.S)
    return " ".join(html.unescape(m.group(1)).split()) if m else None


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [x.as_py() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([title(p) for p in pages], pa.string()), pa.array([extract(p) for p in pages], pa.string())], names=["page_id", "title", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, text of each row of pages (page_id, html).

    A null or empty page has an empty text and no title. Repeated rows stay; other columns are ignored. Malformed
    markup is read as browsers do where that matters for text: a `<` that opens no tag is text, an unclosed comment,
    script or style runs to the end.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, title string, text string")
