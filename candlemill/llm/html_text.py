"""HTML extraction: the visible text of a page, laid out as it would be read.

A tree is built with the end tags that HTML lets authors leave out, elements that are not shown are left aside,
and the rest is rendered: blocks on lines of their own with blank lines where they have margins, lists with
bullets and numbers, tables with their cells aligned in columns, preformatted text as it is. All text that
a reader would see comes out, navigation and footers included; which of it is worth keeping is another step's business.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from candlemill.llm.common import extended, texts, with_columns

# ---- fixed values of HTML -----------------------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NOT_SHOWN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas svg math datalist title meta link base area param source track col colgroup".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset form menu dir".split())
BLOCK = MARGIN | frozenset("html body address article aside center dd details dialog div dt fieldset figcaption footer header hgroup legend li main nav section summary tbody td tfoot th thead tr caption optgroup option search".split())
FORMATTING = frozenset("a b big code em font i nobr s small span strike strong tt u".split())
CLOSES_P = BLOCK - frozenset("html body caption dd dt li tbody td tfoot th thead tr option optgroup".split()) | frozenset(["li", "dd", "dt"])
# What an opening tag ends first, and the elements beyond which it ends nothing.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
# An end tag ends nothing beyond these.
SCOPE = frozenset("table td th caption button html body".split())
IN_HEAD = frozenset("meta link title style script base noscript template head html".split())

DEEPEST_INDENT = 120  # lists and quotations further inside are not indented more, as lines would grow with the depth
WIDEST = 60  # a table column with a longer line is not padded to its length
MOST_COLUMNS_SPANNED = 50
SPACES = re.compile(r"[ \t\n\r\f]+")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def shown(node: Node) -> bool:
    if node.tag in NOT_SHOWN or "hidden" in node.attrs:
        return False
    if node.tag == "input" and node.attrs.get("type", "").lower() in ("hidden", "password", "checkbox", "radio", "image", "file"):
        return False
    return not HIDING.search(node.attrs.get("style", ""))


# ---- the tree -----------------------------------------------------------------------------------

def build(html: str) -> tuple[Node, int]:
    """The tree of a page, and its depth. Any input gives one; tags that make no sense where they are, are passed over."""
    root = Node("html", {})
    open_: list[Node] = [root]
    count, deepest = Counter(), 1  # open elements by tag, so that deep pages are searched only for what is there

    def leave(i: int) -> None:
        count.subtract(n.tag for n in open_[i:])
        del open_[i:]

    def close_through(names: set[str] | frozenset[str], barriers) -> None:
        """End the innermost open element of these names, and all in it, unless a barrier is met first."""
        if not any(count[n] for n in names):
            return
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in names:
                leave(i)
                return
            if open_[i].tag in barriers:
                return

    def text(source: str, keep: bool = False) -> None:
        if source:
            if open_[-1].tag == "head" and not source.isspace():
                leave(len(open_) - 1)  # text cannot be in a head
            open_[-1].children.append(source if keep else unescape(source))

    at, size = 0, len(html)
    while at < size:
        found = TOKEN.search(html, at)
        if not found:
            text(html[at:])
            break
        text(html[at:found.start()])
        at = found.end()
        tag = found["tag"] or found["tag2"]
        if not tag:
            if found[0].startswith("<![CDATA["):
                text(found[0][9:].removesuffix("]]>"), keep=True)
            continue
        tag = tag.lower()
        if found["end"] or found["end2"]:
            if tag == "p" and not count["p"]:
                open_[-1].children.append(Node("p", {}))
            elif tag == "br":
                open_[-1].children.append(Node("br", {}))
            elif tag not in ("html", "body"):  # what follows them still belongs to the page
                if tag in FORMATTING:  # an end tag of text does not end the blocks begun since
                    close_through({tag}, SCOPE | BLOCK)
                    continue
                close_through({tag}, SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"html", "body"} | ({"table"} - {tag}))
            continue
        attrs = _attributes(found["attrs"] or found["attrs2"] or "")
        if tag == "html" or tag == "body" and count["body"]:
            open_[0].attrs.update({k: v for k, v in attrs.items() if k not in open_[0].attrs})
            continue
        if open_[-1].tag == "head" and tag not in IN_HEAD:
            leave(len(open_) - 1)
        if tag == "a":
            close_through({"a"}, SCOPE | BLOCK)
        if tag in CLOSES_P:
            close_through({"p"}, SCOPE)
        while tag in IMPLIED and open_[-1].tag != "html":
            before = len(open_)
            close_through(*IMPLIED[tag])
            if len(open_) == before:
                break
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", open_[-1].tag):
            leave(len(open_) - 1)
        node = Node(tag, attrs)
        open_[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            inside = html[at:end.start() if end else size]
            node.children.append(unescape(inside) if tag in ("textarea", "title") else inside)
            at = end.end() if end else size
        elif tag not in VOID:
            open_.append(node)
            count[tag] += 1
            deepest = max(deepest, len(open_))
    return root, deepest


# ---- the layout ---------------------------------------------------------------------------------

class Lines:
    """Lines of text, and the margin that has to come before the next one."""

    def __init__(self, boxes: int = 0):
        self.boxes = boxes  # how many lists and quotations this is in
        self.out: list[str] = []
        self.margin = 0
        self.line: list[str] = []

    def write(self, text: str) -> None:
        """Text in the flow: runs of white space are one space, and none begins a line."""
        text = SPACES.sub(" ", text)
        if text.startswith(" ") and (not self.line or self.line[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.line.append(text)

    def end_line(self, margin: int = 0) -> None:
        line = "".join(self.line).strip(" ")
        self.line = []
        if line:
            self.put([line])
        self.margin = max(self.margin, margin)

    def put(self, lines: list[str]) -> None:
        if lines:
            if self.out:
                self.out += [""] * self.margin
            self.out += lines
            self.margin = 0

    def line_break(self) -> None:
        if self.line:
            self.end_line()
        elif self.out:
            self.margin = max(self.margin, 1)


def _flow(node: Node, lines: Lines, pre: bool = False) -> None:
    for child in node.children:
        if isinstance(child, str):
            if pre:
                first, *rest = child.replace("\r\n", "\n").split("\n")
                if first:
                    lines.line.append(first)
                for more in rest:
                    lines.out.append("".join(lines.line).rstrip())
                    lines.line = [more] if more else []
            else:
                lines.write(child)
        elif shown(child):
            _element(child, lines, pre)


def _element(node: Node, lines: Lines, pre: bool) -> None:
    tag = node.tag
    if tag == "br":
        lines.line_break()
    elif tag == "hr":
        lines.end_line(1)
        lines.put(["---"])
        lines.margin = 1
    elif tag == "input":
        lines.write(" " + node.attrs.get("value", "") + " ")
    elif tag not in BLOCK:
        if tag in ("select", "button", "textarea"):
            lines.write(" ")
        _flow(node, lines, pre)
    else:
        margin = 1 if tag in MARGIN else 0
        lines.end_line(margin)
        if tag == "pre" or tag == "table" or tag in ("ul", "ol", "menu", "dir", "blockquote", "dd") and lines.boxes < DEEPEST_INDENT:
            lines.put(_box(node, pre, lines.boxes + 1))
        else:
            _flow(node, lines, pre)
            lines.end_line()
        lines.margin = max(lines.margin, margin)


def _inner(node: Node, pre: bool = False, boxes: int = 0) -> list[str]:
    lines = Lines(boxes)
    _flow(node, lines, pre)
    if pre and lines.line:
        lines.out.append("".join(lines.line).rstrip())
    elif not pre:
        lines.end_line()
    return lines.out


def _box(node: Node, pre: bool, boxes: int) -> list[str]:
    if node.tag == "pre":
        found = _inner(node, True, boxes)
        while found and not found[0].strip():
            found.pop(0)
        while found and not found[-1].strip():
            found.pop()
        return found
    if node.tag == "table":
        return _table(node, boxes)
    if node.tag in ("blockquote", "dd"):
        return ["  " + x if x else "" for x in _inner(node, pre, boxes)]
    return _list(node, pre, boxes)


def _whole(text: str | None, otherwise: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*-?\d{1,9}\s*", text) else otherwise


def _list(node: Node, pre: bool, boxes: int) -> list[str]:
    """Items with a bullet or number, their further lines indented; what is in a list without an item as it is."""
    out: list[str] = []
    number = _whole(node.attrs.get("start"), 1)
    loose = Node("div", {})

    def put_loose() -> None:
        if loose.children:
            out.extend("  " + x if x else "" for x in _inner(loose, pre, boxes))
            loose.children = []

    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            put_loose()
            if not shown(child):
                continue
            if node.tag == "ol":
                number = _whole(child.attrs.get("value"), number)
                mark, number = f"{number}. ", number + 1
            else:
                mark = "- "
            found = _inner(child, pre, boxes)
            if found:
                out.append(mark + found[0])
                out.extend(" " * len(mark) + x if x else "" for x in found[1:])
        else:
            loose.children.append(child)
    put_loose()
    return out


def _table(node: Node, boxes: int) -> list[str]:
    """Rows of cells, each column as wide as its longest line up to WIDEST; captions and stray text come first."""
    before, rows = Node("div", {}), []

    def collect(part: Node) -> None:
        for child in part.children:
            if isinstance(child, str):
                before.children.append(child)
            elif not shown(child):
                continue
            elif child.tag == "tr":
                rows.append(child)
            elif child.tag in ("thead", "tbody", "tfoot"):
                collect(child)
            elif child.tag in ("td", "th"):  # a row without its tag
                if not rows or rows[-1].attrs.get("made") != "here":
                    rows.append(Node("tr", {"made": "here"}))
                rows[-1].children.append(child)
            else:
                before.children.append(child)

    collect(node)
    grid: list[list[tuple[list[str], int]]] = []
    for row in rows:
        cells, stray = [], Node("td", {})
        for child in row.children:
            if isinstance(child, Node) and child.tag in ("td", "th"):
                if shown(child):
                    cells.append((_inner(child, boxes=boxes), min(max(1, _whole(child.attrs.get("colspan"), 1)), MOST_COLUMNS_SPANNED)))
            else:
                stray.children.append(child)
        extra = _inner(stray, boxes=boxes)
        grid.append(cells + ([(extra, 1)] if extra else []))
    widths: dict[int, int] = {}
    for cells in grid:
        column = 0
        for found, span in cells:
            width = max(map(len, found), default=0)
            if span == 1 and width <= WIDEST:
                widths[column] = max(widths.get(column, 0), width)
            column += span
    out = _inner(before, boxes=boxes)
    for cells in grid:
        for i in range(max((len(found) for found, _ in cells), default=0)):
            line, column = "", 0
            for found, span in cells:
                width = sum(widths.get(c, 0) + 2 for c in range(column, column + span))
                line += (found[i] if i < len(found) else "").ljust(width - 2) + "  "
                column += span
            out.append(line.rstrip())
    return out


def render(html: str) -> str:
    """The visible text of a page."""
    root, deepest = build(html)
    lines = Lines()
    if shown(root):
        limit = sys.getrecursionlimit()
        # calls from Python to Python need no C stack; an element takes four at most
        sys.setrecursionlimit(limit + 5 * deepest)
        try:
            _flow(root, lines)
            lines.end_line()
        finally:
            sys.setrecursionlimit(limit)
    return "\n".join(lines.out).replace("\xa0", " ").strip("\n")


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the rendered text of each page in the column named by ``text``, which is replaced if it is there.

    A null or empty page has an empty text. Broken markup gives what can be made of it; no text is cut off.
    Other columns come through and rows stay where they are; repeated rows are rendered alike. An empty table
    gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [render(x.decode("utf-8", "replace")) for x in texts(batch, html)]
            yield with_columns(batch, {text: pa.array(found, pa.string())})

    return pages.mapInArrow(run, extended(pages.schema, f"`{text}` string"))
