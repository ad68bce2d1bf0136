"""Visible text of HTML pages, laid out as a reader sees it."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

TAG = re.compile(
    r"<!--(?:.*?-->|.*+)|<!\[CDATA\[(?:.*?\]\]>|.*+)|<[!?][^>]*+>?|</(?![a-zA-Z])[^>]*+>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?P<attrs>(?:\s++|/|[^\s=>/\"'][^\s=>/]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)?|[\"'=])*+)>?", re.S)
ATTR = re.compile(r"([^\s=>/\"'][^\s=>/]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
SPACES = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())  # their content is text up to the end tag
IN_HEAD = frozenset("base link meta script style template title noscript".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas svg datalist area map".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                     "hgroup hr main menu nav ol p pre section summary table ul xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends these open elements, looked for up to one of the bounds.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "body": ({"head"}, set())}
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table pre blockquote figure fieldset xmp".split())  # a blank line around
BLOCK = PARAGRAPH | frozenset("address article aside body center details dialog dd div dt figcaption footer form header hgroup hr html legend li main nav "
                              "optgroup option section summary textarea tr caption".split())
#: A table is laid out in as wide columns as it needs while that takes at most PAD_TIMES its text (PAD_FREE for small ones);
#: beyond, cells over PAD_WIDTH characters do not count for a column, and where that is not enough cells just follow each other.
PAD_TIMES, PAD_FREE, PAD_WIDTH = 16, 4096, 60
TABLE_DEPTH = 64  # tables nested deeper are laid out as blocks (each level is a recursion)
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534  # fixed values: limits of the HTML standard


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def get(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for m in ATTR.finditer(self.attrs):
            out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        return out


def parse(page: str) -> Node:
    """Element tree; tags that authors leave out are implied, stray end tags ignored, open elements end with the page."""
    root = Node("")
    stack, at, n = [root], 0, len(page)

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and s.strip():
                stack.pop()
            stack[-1].kids.append(html.unescape(s) if "&" in s else s)

    def close(names, bounds) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in bounds:
                return

    while at < n:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "br":
                stack[-1].kids.append(Node("br"))
            elif name in HEADINGS:
                close(HEADINGS, {"table"})
            elif name == "p" and all(x.tag != "p" for x in stack):
                stack[-1].kids.append(Node("p"))
            else:
                close({name}, set() if name in ("table", "body", "html") else {"table"} if name in ("tr", "tbody", "thead", "tfoot") else {"table", "td", "th"} - {name})
            continue
        if stack[-1].tag == "head" and name not in IN_HEAD:
            stack.pop()
        if name in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "caption"})
        if name in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        if name in IMPLIED_END:
            names, bounds = IMPLIED_END[name]
            if name in ("tr", "tbody", "thead", "tfoot"):
                close({"td", "th"}, bounds)
            if name in ("tbody", "thead", "tfoot"):
                close({"tr"}, bounds)
            close(names, bounds)
        node = Node(name, m["attrs"] or "")
        stack[-1].kids.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            body = page[at:end.start()] if end else page[at:]
            if name in ("title", "textarea"):
                body = html.unescape(body)
            if body:
                node.kids.append(body)
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


def hidden(node: Node) -> bool:
    """Whether an element and all in it is not shown."""
    if node.tag in UNSEEN:
        return True
    if node.tag == "dialog":
        return "open" not in node.get()
    if not node.attrs:
        return False
    a = node.attrs.lower()
    if "hidden" not in a and "none" not in a:
        return False
    got = node.get()
    style = got.get("style", "").lower().replace(" ", "")
    return "hidden" in got or "display:none" in style or "visibility:hidden" in style


class Page:
    """Lines under construction: blank lines asked for, collapsed spaces, indents of lists and quotes."""

    def __init__(self):
        self.out: list[str] = []
        self.breaks, self.space, self.start = 0, False, True
        self.indent: list[str] = []
        self.marker = ""

    def need(self, lines: int) -> None:
        """At least so many line breaks before the next text."""
        self.breaks = max(self.breaks, lines)
        self.space = False

    def raw(self, s: str) -> None:
        if self.breaks or self.start:
            if not self.start:
                self.out.append("\n" * self.breaks)
            lead = "".join(self.indent)
            if self.marker:
                lead = lead[:len(lead) - len(self.marker)] + self.marker
                self.marker = ""
            self.out.append(lead)
            self.breaks, self.space, self.start = 0, False, False
        elif self.space:
            self.out.append(" ")
            self.space = False
        self.out.append(s)

    def flow(self, s: str) -> None:
        """Text in normal flow: runs of white space are one space."""
        words = SPACES.sub(" ", s)
        if words[:1] == " " and not (self.breaks or self.start):
            self.space = True
        core = words.strip(" ")
        if core:
            self.raw(core)
            self.space = words[-1] == " "

    def kept(self, s: str) -> None:
        """Preformatted text."""
        for i, line in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.breaks = self.breaks + 1 if self.breaks else 1
            if line:
                self.raw(line)

    def text(self) -> str:
        return "".join(self.out)


def render(root: Node, depth: int = 0) -> str:
    """Visible text below a node; blank lines around paragraphs, markers and indents for lists, tables in columns."""
    page = Page()
    counters: list[list] = []  # [ordered, next number] of open lists
    pre = 0
    work: list = [(root, False)]
    while work:
        node, leave = work.pop()
        if isinstance(node, str):
            (page.kept if pre else page.flow)(node)
            continue
        tag = node.tag
        if leave:
            if tag in ("ul", "ol", "menu", "dir"):
                counters.pop()
            if tag in ("li", "blockquote", "dd"):
                page.indent.pop()
                page.marker = ""
            if tag in ("pre", "xmp", "textarea"):
                pre -= 1
            page.need(1 if len(counters) and tag in ("ul", "ol", "menu", "dir") else 2 if tag in PARAGRAPH else 1)
            continue
        if hidden(node):
            continue
        if tag == "br":
            page.breaks = page.breaks + 1 if not page.start else 0
            page.space = False
            continue
        if tag == "wbr":
            continue
        if tag == "table" and depth < TABLE_DEPTH:
            page.need(2)
            for i, line in enumerate(table_lines(node, depth + 1)):
                if i:
                    page.need(1)
                page.raw(line or " ")
            page.need(2)
            continue
        if tag in ("td", "th") and not page.space:
            page.space = not (page.breaks or page.start)
        block = tag in BLOCK
        if block:
            nested = tag in ("ul", "ol", "menu", "dir") and counters
            page.need(1 if nested or tag not in PARAGRAPH else 2)
            work.append((node, True))
        if tag in ("ul", "ol", "menu", "dir"):
            counters.append([tag == "ol", 1])
        elif tag == "li":
            mark = "- "
            if counters and counters[-1][0]:
                mark = f"{counters[-1][1]}. "
                counters[-1][1] += 1
            page.indent.append(" " * len(mark))
            page.marker = mark
        elif tag == "blockquote":
            page.indent.append("> ")
        elif tag == "dd":
            page.indent.append("  ")
        elif tag in ("pre", "xmp", "textarea"):
            pre += 1
        kids = node.kids
        if tag == "details" and "open" not in node.get():
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"]
        if tag == "select":
            kids = shown_options(node)
        work += [(k, False) for k in reversed(kids)]
    return page.text()


def shown_options(select: Node) -> list[Node]:
    """Options of a select that are seen: all of a list box (``multiple`` or a ``size``), else the selected or first one."""
    options, work = [], list(reversed(select.kids))
    while work:
        node = work.pop()
        if isinstance(node, str) or hidden(node):
            continue
        if node.tag == "optgroup":
            work += reversed(node.kids)
        elif node.tag == "option":
            options.append(node)
    got = select.get()
    if "multiple" in got or span_of(got.get("size", ""), MAX_ROWSPAN) > 1:
        return options
    return [k for k in options if "selected" in k.get()][-1:] or options[:1]


def span_of(value: str, top: int) -> int:
    """A span attribute as a number from 0 to ``top``; 1 if it is none."""
    value = value.strip()
    if not (value.isascii() and value.isdigit()):
        return 1
    return top if len(value) > 6 else min(int(value), top)


def table_rows(table: Node, depth: int) -> tuple[list[str], list[tuple[int, Node]]]:
    """(lines of what is no cell, rows with the number of their row group)."""
    lines, rows, work = [], [], [(k, 0) for k in reversed(table.kids)]
    loose, groups = Node("tr"), 0
    while work:
        node, group = work.pop()
        if isinstance(node, str):
            if node.strip():
                lines.append(SPACES.sub(" ", node).strip())  # text that is no cell stands before the table
        elif hidden(node):
            continue
        elif node.tag in ("thead", "tbody", "tfoot"):
            groups += 1
            work += [(k, groups) for k in reversed(node.kids)]
        elif node.tag == "tr":
            rows.append((group, node))
        elif node.tag in ("td", "th"):
            if not rows or rows[-1][1] is not loose:
                rows.append((group, loose))
            loose.kids.append(node)
        elif node.tag in ("col", "colgroup"):
            continue
        else:
            lines += render_one(node, depth).split("\n")
    return lines, rows


def placed(rows: list[tuple[int, Node]], depth: int) -> list[list[tuple[int, list[str]]]]:
    """Cells of each row as (column, lines); a cell that spans rows keeps its columns in the following rows of its group."""
    grid, held, of = [], [], None  # held: [first column, column behind, rows left] in order of columns
    for group, row in rows:
        if group != of:
            held, of = [], group
        cells, new, at, i = [], [], 0, 0
        for cell in row.kids:
            wide, high = 1, 1
            if isinstance(cell, str):
                if not cell.strip():
                    continue
                shown = [SPACES.sub(" ", cell).strip()]
            elif hidden(cell):
                continue
            else:
                shown = render_one(cell, depth).split("\n")
                if cell.attrs:
                    got = cell.get()
                    wide = max(1, span_of(got.get("colspan", ""), MAX_COLSPAN))
                    high = span_of(got.get("rowspan", ""), MAX_ROWSPAN) or MAX_ROWSPAN  # 0: to the end of the group
            while i < len(held) and held[i][0] <= at:
                at = max(at, held[i][1])
                i += 1
            cells.append((at, shown))
            if high > 1:
                new.append([at, at + wide, high])
            at += wide
        held = sorted([s, e, n - 1] for s, e, n in held + new if n > 1)
        grid.append(cells)
    return grid


def table_lines(table: Node, depth: int) -> list[str]:
    """Lines of a table: cells stand below each other, two spaces between columns."""
    lines, rows = table_rows(table, depth)
    grid = placed(rows, depth)
    number = {c: i for i, c in enumerate(sorted({c for cells in grid for c, _ in cells}))}  # columns in which no cell begins take no place
    grid = [[(number[c], shown) for c, shown in cells] for cells in grid]
    chars = sum(len(x) - x.count(" ") for cells in grid for _, shown in cells for x in shown)
    for limit in (None, PAD_WIDTH):
        width = [0] * len(number)
        for cells in grid:
            for c, shown in cells:
                width[c] = max([width[c], *(len(x) for x in shown if limit is None or len(x) <= limit)])
        begin = [0]
        for w in width:
            begin.append(begin[-1] + w + 2)
        if sum(max(len(shown) for _, shown in cells) * begin[cells[-1][0] + 1] for cells in grid if cells) <= max(PAD_FREE, PAD_TIMES * chars):
            break
    else:
        begin = []
    for cells in grid:
        for i in range(max((len(shown) for _, shown in cells), default=0)):
            line = ""
            for c, shown in cells:
                if i < len(shown) and shown[i]:
                    line = (line and line + "  ") if not begin else line.ljust(begin[c]) if len(line) <= begin[c] - 2 or not c else line + "  "
                    line += shown[i]
            lines.append(line.rstrip())
    return [x for x in lines if x.strip()]


def render_one(node: Node, depth: int) -> str:
    """Text of one element on its own; a cell is laid out like a division."""
    holder = Node("div")
    holder.kids = node.kids if node.tag in ("td", "th", "caption") else [node]
    return render(holder, depth)


def title_of(root: Node) -> str:
    work = [root]
    while work:
        node = work.pop()
        if node.tag == "title":
            return SPACES.sub(" ", "".join(k for k in node.kids if isinstance(k, str))).strip()
        work += [k for k in reversed(node.kids) if isinstance(k, Node) and k.tag not in ("body", "svg")]
    return ""


def extract(page: str | None) -> tuple[str, str]:
    """(title, visible text) of a page; both empty for null or empty pages."""
    root = parse(page or "")
    return title_of(root), render(root)


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, title, text) of every row.

    All visible text in page order: hidden elements (by element, attribute or
    inline style) are left out, and of a drop-down list all but the option it shows; nothing else.
    Cells stand below each other at any width and under cells that span rows or columns, unless a
    table would take more than PAD_TIMES its text so.  Null and empty pages give empty
    texts; broken markup never fails; pages are handled whole, row by row, so
    repeated rows give equal results and an empty table none.
    """
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))

    def one(batch):
        found = [extract(x) for x in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())],
                                          names=["page_id", "title", "text"])
    return map_batches(p, one, f"page_id {p.schema['page_id'].dataType.simpleString()}, title string, text string", rows=500)
