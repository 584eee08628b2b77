"""HTML extraction by layout-aware rendering.

A tree builder supplies implied tags (open paragraphs, list items, rows and cells end where HTML lets them), visibility rules drop what a browser would not show, and
a renderer walks the tree: blocks are set apart, lists keep markers and depth, and table cells are aligned in columns.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import returning, small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript iframe object audio video canvas datalist noembed noframes".split())
#: What svg and math hold and do not show in place.
FOREIGN_HIDDEN = {"svg": frozenset("title desc metadata defs symbol clippath mask marker pattern".split()), "math": frozenset("annotation annotation-xml".split())}
#: Blocks with a blank line around them, and those that only begin a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset form details".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address li dt dd tr caption center figcaption legend summary menu dir hgroup search option optgroup textarea".split())
_LISTS = frozenset("ul ol menu dir".split())
_GROUPS = frozenset("thead tbody tfoot".split())
#: start tag -> (open elements that it ends, elements that the search does not pass)
_CELL_STOP = frozenset(["table"])
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), _LISTS | _CELL_STOP),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _CELL_STOP),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _CELL_STOP),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), _CELL_STOP),
    "th": (frozenset(["td", "th"]), _CELL_STOP),
    "tr": (frozenset(["tr", "caption"]), _CELL_STOP),
    **dict.fromkeys(_GROUPS, (_GROUPS | {"caption"}, _CELL_STOP)),
}
_P_STOP = frozenset("td th caption table button li dd".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
INSIDE = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+")
#: Tags whose quotes do not close that a page may have; after these a tag ends at its first ``>``, so that reading stays linear.
LOOSE_TAGS = 16
#: Longest line of a table cell that is aligned, and most lines of such a cell; levels of lists that are indented. They bound the text that padding adds.
CELL_WIDTH, CELL_LINES, LIST_LEVELS = 80, 3, 16
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
UNSEEN = re.compile(r"display\s*:\s*none|content-visibility\s*:\s*hidden", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)
BODY = frozenset("body frameset".split())
HEAD = frozenset("base link meta title style script noscript template head html".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class Open:
    """The open elements; where the last of each tag is, so that ending one costs no walk."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.at: dict[str, list[int]] = {}

    def last(self, tags: Iterable[str]) -> int:
        return max((p[-1] for t in tags if (p := self.at.get(t))), default=0)

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        """End the last open element of these tags and all in it, if none of ``stop`` opened after it."""
        i = self.last(tags)
        if i and i >= self.last(stop):
            while len(self.stack) > i:
                self.at[self.stack.pop().tag].pop()


def parse(page: str) -> Node:
    """The page's tree. Unknown end tags are ignored, elements left open end with the page, and so do a comment and a tag that do not end."""
    root = Node("#root")
    nodes = Open(root)
    stack, close = nodes.stack, nodes.close
    at, loose = 0, 0

    def add(text: str) -> None:
        if text:
            if stack[-1].tag == "head" and text.strip():
                close(frozenset(["head"]), frozenset())
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    size, begun = len(page), 0  # text from ``begun`` on is not added yet
    while 0 <= (at := page.find("<", at)) < size - 1:
        mark = page[at + 1]
        if not (mark in "!?/" or mark.isascii() and mark.isalpha()):
            at += 1
            continue
        if mark in "!?":
            add(page[begun:at])
            end = page.find("-->" if page.startswith("<!--", at) else ">", at + (4 if page.startswith("<!--", at) else 2))
            at = begun = size if end < 0 else end + (3 if page.startswith("<!--", at) else 1)
            continue
        m = NAME.match(page, at + (2 if mark == "/" else 1))
        if not m:
            at += 1
            continue
        add(page[begun:at])
        tag, inside = m.group().lower(), ""
        if mark == "/":
            end = page.find(">", m.end())
        else:
            end = -1
            if loose < LOOSE_TAGS:
                found = INSIDE.match(page, m.end())
                if found.end() < size and page[found.end()] == ">":
                    end, inside = found.end(), found.group()
                else:
                    loose += 1
            if end < 0:
                end = page.find(">", m.end())
        if end < 0:
            return root
        slash = page[end - 1] == "/"
        at = begun = end + 1
        if mark == "/":
            if tag == "br":
                stack[-1].children.append(Node("br"))
            else:
                close(frozenset([tag]), _CELL_STOP if tag not in ("table", "body", "html", "thead", "tbody", "tfoot") else frozenset())
            continue
        if tag not in HEAD and stack[-1].tag == "head" or tag in BODY:
            close(frozenset(["head"]), frozenset())
        if tag in ("html", "body") and nodes.at.get(tag):
            continue
        if tag in BLOCK and tag not in ("li", "dt", "dd", "tr", "caption", "option", "optgroup"):
            close(frozenset(["p"]), _P_STOP)
        if tag in ENDS:
            ends, stop = ENDS[tag]
            if tag == "tr":
                close(frozenset(["td", "th"]), _CELL_STOP)
            elif tag in _GROUPS:
                close(frozenset(["tr"]), _CELL_STOP)
            close(ends, stop)
        attrs = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in ATTR.finditer(inside)} if inside.strip(" /\n\t") else {}
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if slash and nodes.last(FOREIGN_HIDDEN):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            raw = page[at : end.start() if end else size]
            node.children.append(html.unescape(raw) if tag in ("title", "textarea") else raw)
            last = page.find(">", end.end()) if end else -1
            at = begun = size if last < 0 else last + 1
        elif tag not in VOID:
            nodes.push(node)
    add(page[begun:])
    return root


def hidden(node: Node, within: str = "") -> bool:
    if node.tag in FOREIGN_HIDDEN.get(within, ()) or node.tag in HIDDEN or "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs:
        return True
    return bool(UNSEEN.search(node.attrs.get("style", "")))


def context(node: Node, seen: bool, within: str) -> tuple[bool, str]:
    """Whether the node's own text is visible (inherited unless its style says), and whether it is in svg or math."""
    said = VISIBILITY.findall(node.attrs.get("style", ""))
    within = node.tag if node.tag in FOREIGN_HIDDEN else "" if node.tag == "foreignobject" else within
    return said[-1].lower() == "visible" if said else seen, within


class Writer:
    """Text of one flow: collapses white space, keeps the widest gap asked for between blocks."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.gap = 0
        self.space = False
        self.fresh = True
        self.marks: list[str] = []  # list markers waiting for text
        self.depth = 0

    def block(self, blank: bool) -> None:
        self.space = False
        if self.parts:
            self.gap = max(self.gap, 2 if blank else 1)

    def _begin(self) -> None:
        if self.gap:
            self.parts.append("\n" * self.gap)
            self.gap, self.fresh = 0, True
        if self.fresh:
            self.parts.append("  " * min(LIST_LEVELS, max(0, self.depth - 1)))
            self.parts.extend(self.marks)
            self.marks = []
            self.fresh = False

    def text(self, s: str) -> None:
        words = SPACE.sub(" ", s)
        if words.strip(" "):
            lead = words[0] == " " or self.space
            if lead and not (self.fresh or self.gap):
                self.parts.append(" ")
            self._begin()
            self.parts.append(words.strip(" "))
            self.space = words[-1] == " "
        elif words:
            self.space = True

    def pre(self, s: str) -> None:
        if s:
            self._begin()
            self.parts.append(s)
            self.space = False

    def line(self) -> None:
        self._begin()
        self.parts.append("\n")
        self.fresh, self.space = True, False

    def result(self) -> str:
        lines = [x.rstrip(" ") for x in "".join(self.parts).strip("\n").split("\n")]
        return "\n".join(lines)


#: A table cell: its lines, and the columns and rows it spans.
Cell = tuple[list[str], int, int]


def _grid(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table. Cells stand in columns as wide as their widest cell (those over several columns, or too long to be aligned, do not widen them).

    A cell over several rows leaves its place in the rows below empty. A row with a cell of more than CELL_LINES lines or one longer than
    CELL_WIDTH, as pages laid out by tables have, is written cell by cell.
    """
    aligned = [all(len(lines) <= CELL_LINES and all(len(x) <= CELL_WIDTH for x in lines) for lines, _, _ in row) for row in rows]
    placed: list[list[tuple[int, int, list[str]]]] = []  # first column, past column, lines
    widths: dict[int, int] = {}
    below: dict[int, int] = {}  # column -> rows for which a cell above still takes it
    for row, even in zip(rows, aligned, strict=True):
        col, now = 0, []
        taken, below = below, {c: n - 1 for c, n in below.items() if n > 1}
        for lines, span, deep in row:
            while col in taken:
                col += 1
            now.append((col, col + span, lines))
            if span == 1 and even:
                widths[col] = max(widths.get(col, 0), *map(len, lines), 0)
            if deep > 1:
                below |= dict.fromkeys(range(col, col + span), deep - 1)
            col += span
        placed.append(now)
    # where each column begins, of those that hold text
    begins, x = {}, 0
    for c in sorted(widths):
        begins[c] = x
        x += widths[c] + 2 if widths[c] else 0
    out = []
    for now, even in zip(placed, aligned, strict=True):
        if not even:
            out += [x for _, _, lines in now for x in lines]
            continue
        for k in range(max((len(lines) for _, _, lines in now), default=0)):
            line = ""
            for col, _, lines in now:
                if k < len(lines) and lines[k]:
                    gap = "  " if line else ""
                    line = (line + gap).ljust(min(begins.get(col, 0), len(line) + CELL_WIDTH)) + lines[k]
            out.append(line.rstrip())
    return [x for x in out if x]


def render(root: Node) -> str:
    """All visible text of a tree. Walks without recursion, so depth is no limit."""
    flows = [Writer()]
    lists: list[list] = []  # [kind, number] of open lists
    tables: list[list[list[Cell]]] = []
    pre = 0
    stack: list[tuple[Node | str, bool, bool, str]] = [(root, False, True, "")]
    while stack:
        node, leave, seen, within = stack.pop()
        out = flows[-1]
        if isinstance(node, str):
            if seen:
                out.pre(node) if pre else out.text(node)
            continue
        tag = node.tag
        label = tag == "text" and within == "svg"
        if leave:
            if tag in ("td", "th") and tables:
                lines = [x for x in flows.pop().result().split("\n") if x.strip()]
                span, deep = (max(1, min(100, int(n))) if n.isdecimal() and n.isascii() and len(n) < 10 else 1 for n in (node.attrs.get("colspan", "1"), node.attrs.get("rowspan", "1")))
                (tables[-1] or tables[-1].append([]) or tables[-1])[-1].append((lines, span, deep))
                continue
            if tag == "table":
                for i, row in enumerate(_grid(tables.pop())):
                    if i:
                        out.block(False)
                    out.pre(row)
            if tag in _LISTS:
                lists.pop()
                out.depth -= 1
            elif tag == "li":
                out.marks = out.marks[:-1]
            elif tag == "pre":
                pre -= 1
            if tag in BLOCK or label:
                out.block(tag in SPACED and not (tag in _LISTS and lists))
            continue
        if hidden(node, within) or tag == "input" and node.attrs.get("type", "").lower() == "hidden":
            continue
        seen, within = context(node, seen, within)
        if tag == "br":
            if seen:
                out.line()
            continue
        if tag in ("td", "th") and tables:
            flows.append(Writer())
        elif tag in BLOCK or label:
            out.block(tag in SPACED and not (tag in _LISTS and lists))
        if tag == "table":
            tables.append([])
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in _LISTS:
            lists.append([tag, int(s) if (s := node.attrs.get("start", "1")).isdecimal() and s.isascii() and len(s) < 10 else 1])
            out.depth += 1
        elif tag == "li":
            mark = "- "
            if lists and lists[-1][0] == "ol":
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            out.marks = [*out.marks, mark if seen else ""]
        elif tag == "pre":
            pre += 1
        stack.append((node, True, seen, within))
        stack.extend((c, False, seen, within) for c in reversed(node.children))
    return flows[0].result()


def page_text(page: str | None) -> str:
    """The visible text of a page; empty for null."""
    return render(parse(page.replace("\r\n", "\n").replace("\r", "\n"))) if page else ""


def extract(pages: DataFrame, *, key: str = "page_id", page: str = "html") -> DataFrame:
    """Per row: key, text (all visible text), n_lines (0 for none). Null and empty pages give an empty text. Every row gives a row; other columns are ignored."""
    small_batches(pages.sparkSession, 256)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [page_text(v.as_py()) for v in b.column("page")]
            n = [len(t.split("\n")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(texts, pa.string()), pa.array(n, pa.int64())], ["key", "text", "n_lines"])

    out = pages.select(F.col(key).alias("key"), F.col(page).alias("page")).mapInArrow(returning(run), f"key {kind}, text string, n_lines long")
    return out.withColumnRenamed("key", key)
