"""Visible text of web pages, laid out as a reader sees it.

A tree builder with the implied end tags of HTML makes a tree of each page; a
renderer walks it without recursion, leaves what a browser hides (of svg and
math: descriptions, definitions, annotations), and writes
all other text: blocks on lines of their own, paragraphs, headings, lists and
tables apart by an empty line, list items with their bullet or number and
indented, preformatted text as it is, and table cells in aligned columns.
Cells that span columns or rows take their places in the grid; running text in
a cell is wrapped, and a line that is wider than any column may be stands
alone, the cells beside it on the next line, so no cell is ever out of line.
Navigation and other boilerplate is visible and stays.

Defined cases: a null or empty page gives an empty text; a tag that never ends
is text; end tags without a start are ignored, open elements end with the
page; repeated rows are each rendered; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.words import slices

_MARKUP = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*>|/([a-zA-Z][^\s/>]*)[^>]*>|([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>"']|["'])*+)>)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_SEEN = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)

#: The element sets of the HTML standard that layout needs.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes object video audio canvas datalist area base link meta param rp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split())
APART = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr listing menu dir ol p pre table ul xmp".split())
PRE = frozenset("pre listing xmp textarea plaintext".split())
ENDS_P = BLOCK - frozenset("body html li dd dt legend optgroup option summary tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
#: What may stand in a head; any other tag, and text, ends a head without an end tag.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Parts of svg and math that are not shown, and those in which HTML may stand.
UNSEEN = {"svg": frozenset("desc metadata defs symbol clippath mask marker pattern".split()), "math": frozenset("annotation annotation-xml".split())}
POINTS = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
#: Start tag: the open elements that it ends, and the elements that the search does not leave.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, set()),
}
SCOPE = frozenset("table td th caption html button object template".split())
#: Running text in a cell is wrapped at so many characters; no column is padded beyond ``WIDEST``.
WRAP = 100
WIDEST = 400


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in "\"'" and len(value) > 1 else value))
    return out


def parse(page: str) -> Node:
    root = Node("#root", {})
    stack = [root]
    n_open: dict[str, int] = {}

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        stack.append(node)
        n_open[node.tag] = n_open.get(node.tag, 0) + 1

    def pop_to(k: int) -> None:
        for node in stack[k:]:
            n_open[node.tag] -= 1
        del stack[k:]

    def end(tags: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> None:
        """Ends the outermost open element of ``tags`` inside the nearest wall."""
        if not any(n_open.get(t) for t in tags):
            return
        found = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                found = k
            elif stack[k].tag in walls:
                break
        if found:
            pop_to(found)

    def say(text: str) -> None:
        if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
            pop_to(len(stack) - 1)
        stack[-1].children.append(html.unescape(text))

    at, size, lower, last = 0, len(page), None, page.rfind(">")
    while at < size:
        m = _MARKUP.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            foreign = [t for t in UNSEEN if n_open.get(t)]
            if foreign and tag in BLOCK and not any(n_open.get(t) for t in POINTS):
                end(set(foreign), frozenset())
                foreign = []
            if tag in ENDS_P and n_open.get("p"):
                end({"p"}, SCOPE)
            if tag in IMPLIED:
                end(*IMPLIED[tag])
            if stack[-1].tag == "head" and tag not in HEAD:
                pop_to(len(stack) - 1)
            if tag in ("td", "th") and n_open.get("table") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push(Node("tr", {}))
            node = Node(tag, attributes(m[3]) if m[3].strip(" /\n\t") else {})
            if foreign:
                if any(tag in UNSEEN[t] for t in foreign):
                    node.attrs["hidden"] = ""
                if tag == "text":
                    stack[-1].children.append(" ")
            if tag in VOID or foreign and m[3].rstrip().endswith("/"):
                stack[-1].children.append(node)
                continue
            if tag == "plaintext":
                push(node)
                node.children.append(page[at:])
                break
            push(node)
            if tag in RAW:
                lower = page.lower() if lower is None and len(page.lower()) == size else lower
                stop = (lower or page).find(f"</{tag}", at)
                stop = size if stop < 0 else stop
                body = page[at:stop]
                node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
                pop_to(len(stack) - 1)
                close = page.find(">", stop)
                at = size if close < 0 else close + 1
        elif m[1]:
            tag = m[1].lower()
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not n_open.get("p"):
                stack[-1].children.append(Node("p", {}))
            elif n_open.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        pop_to(k)
                        break
                    if stack[k].tag in ("td", "th", "caption", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"):
                        break
    return root


def visible(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs:
        return False
    if node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
        return False
    return not ("style" in node.attrs and _HIDE.search(node.attrs["style"]))


def sight(node: Node, inherited: bool) -> bool:
    """Whether text of the node shows: its own visibility, or what it inherits."""
    found = _SEEN.findall(node.attrs["style"]) if "style" in node.attrs else None
    return found[-1].lower() == "visible" if found else inherited


def wrapped(line: str, width: int) -> list[str]:
    """A line in pieces of at most ``width`` characters, parted at blanks; a longer word is a piece of its own."""
    if len(line) <= width:
        return [line]
    lead = line[: len(line) - len(line.lstrip())]
    out, now = [], lead
    for word in line.split():
        if len(now) + len(word) + 1 > width and now.strip():
            out.append(now)
            now = lead
        now += word if not now.strip() else " " + word
    return [*out, now]


class Flow:
    """Lines of text; gap is how many line ends are due before the next text; running text is wrapped at ``width``."""

    def __init__(self, width: int | None = None):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False
        self.gap = 0
        self.indents: list[str] = []
        self.marker: str | None = None
        self.width, self.raw = width, False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            self.raw = True
            for k, part in enumerate(s.expandtabs().split("\n")):
                if k:
                    self.flush(True)
                    self.raw = True
                if part:
                    self.put(part)
            return
        words = s.split()
        if not words:
            self.blank = self.blank or bool(s)
            return
        if (self.blank or s[0].isspace()) and self.line:
            self.line.append(" ")
        self.put(" ".join(words))
        self.blank = s[-1].isspace()

    def put(self, s: str) -> None:
        if not self.line and self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        self.line.append(s)

    def flush(self, always: bool = False) -> None:
        self.blank = False
        if self.line or always:
            lead = "".join(self.indents)
            if self.marker is not None and self.line:
                lead, self.marker = "".join(self.indents[:-1]) + self.marker, None
            line = (lead + "".join(self.line)).rstrip()
            self.lines += [line] if self.raw or not self.width else wrapped(line, self.width)
            self.line = []
        self.raw = False

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def rows(self, lines: list[str]) -> None:
        for x in lines:
            self.raw = True
            if x:
                self.put(x)
            self.flush(True)


class Cell:
    __slots__ = ("lines", "across", "down", "col")

    def __init__(self, lines: list[str], across: int = 1, down: int = 1):
        self.lines, self.across, self.down, self.col = lines, across, down, 0


def place(rows: list[tuple[int, list[Cell]]]) -> None:
    """Gives each cell its column: the first that no cell of the row or of rows above holds; spans end with their row group."""
    until: dict[int, float] = {}
    last = None
    for r, (group, cells) in enumerate(rows):
        if group != last:
            until, last = {}, group
        col = 0
        for cell in cells:
            while until.get(col, 0) > r:
                col += 1
            cell.col = col
            end = r + cell.down if cell.down else float("inf")
            for c in range(col, col + cell.across):
                until[c] = max(until.get(c, 0), end)
            col += cell.across


def aligned(rows: list[tuple[int, list[Cell]]]) -> list[str]:
    """The lines of table rows of (row group, cells), columns aligned."""
    place(rows)
    cells = [c for _, row in rows for c in row]
    widths: dict[int, int] = {}
    wide = lambda c: min(WIDEST, max(map(len, c.lines), default=0))
    for c in cells:
        if c.across == 1:
            widths[c.col] = max(widths.get(c.col, 0), wide(c))
    # Two blanks part columns; those without text take no room.
    room = lambda a, z: sum(w + 2 for w in (widths.get(k, 0) for k in range(a, z)) if w)
    for c in sorted((c for c in cells if c.across > 1), key=lambda c: c.across):
        short = wide(c) + 2 - room(c.col, c.col + c.across)
        if wide(c) and short > 0:
            last = c.col + c.across - 1
            widths[last] = widths.get(last, 0) + (short if widths.get(last) else short - 2)
    starts, at = {}, 0
    for k in sorted(widths):
        starts[k] = at
        at += widths[k] + 2 if widths[k] else 0
    known = sorted(starts)

    def start(col: int) -> int:
        k = bisect.bisect_left(known, col)
        return starts[known[k]] if k < len(known) else at

    out = []
    for _, row in rows:
        places = [start(c.col) for c in row]
        for k in range(max((len(c.lines) for c in row), default=0)):
            line = ""
            for c, left in zip(row, places, strict=True):
                if k < len(c.lines) and c.lines[k]:
                    if line and len(line) > left - 2:
                        out.append(line.rstrip())
                        line = ""
                    line = line.ljust(left) + c.lines[k]
            out.append(line.rstrip())
    return out


def _span(node: Node, name: str, least: int, most: int) -> int:
    value = node.attrs.get(name, "1").strip()
    return min(most, max(least, int(value))) if value.isascii() and value.isdigit() and len(value) < 7 else 1


def render(root: Node) -> str:
    flow = Flow()
    flows: list[Flow] = []
    tables: list[list] = []
    groups: list[int] = []
    lists: list[list] = []
    pre = 0
    seen = [True]
    todo: list[tuple[Node | str, bool]] = [(root, True)]
    while todo:
        node, enter = todo.pop()
        if isinstance(node, str):
            if seen[-1]:
                flow.text(node, pre > 0)
            continue
        tag = node.tag
        if not enter:
            pre -= tag in PRE
            if tag in ("td", "th") and tables:
                flow.flush()
                tables[-1][-1][1].append(Cell([x for x in flow.lines if x], _span(node, "colspan", 1, 1000), _span(node, "rowspan", 0, 65534)))
                flow = flows.pop()
            elif tag == "table":
                groups.pop()
                flow.block(2)
                flow.rows(aligned(tables.pop()))
                flow.block(2)
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                flow.block(2 if not lists else 1)
            elif tag in ("li", "dd", "blockquote"):
                flow.block(2 if tag == "blockquote" else 1)
                flow.indents.pop()
                flow.marker = None
            elif tag in BLOCK:
                flow.block(2 if tag in APART else 1)
            elif tag == "q" and seen[-1]:
                flow.text('"', False)
            seen.pop()
            continue
        if not visible(node):
            continue
        shown = sight(node, seen[-1])
        if tag == "br":
            flow.flush(True)
            continue
        if tag == "wbr" or tag in VOID and tag not in ("hr", "input"):
            continue
        if tag == "input":
            if shown and node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text") and node.attrs.get("value"):
                flow.text(node.attrs["value"], False)
            continue
        if tag == "hr":
            flow.block(2)
            continue
        if tag == "table":
            flow.block(2)
            tables.append([])
            groups.append(0)
        elif tag in ("thead", "tbody", "tfoot") and tables:
            groups[-1] += 1
        elif tag == "tr" and tables:
            tables[-1].append((groups[-1], []))
        elif tag in ("td", "th") and tables:
            if not tables[-1]:
                tables[-1].append((groups[-1], []))
            flows.append(flow)
            flow = Flow(WRAP)
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.block(2 if not lists else 1)
            start = node.attrs.get("start", "1")
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
        elif tag == "li":
            flow.block(1)
            mark = "- "
            if lists and lists[-1][0]:
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            flow.indents.append(" " * len(mark))
            flow.marker = mark if shown else None
        elif tag in ("dd", "blockquote"):
            flow.block(2 if tag == "blockquote" else 1)
            flow.indents.append("  ")
        elif tag in BLOCK:
            flow.block(2 if tag in APART else 1)
        elif tag == "q" and shown:
            flow.text('"', False)
        pre += tag in PRE
        seen.append(shown)
        todo.append((node, False))
        todo.extend((c, True) for c in reversed(node.children))
    flow.flush()
    lines = flow.lines
    a, b = 0, len(lines)
    while a < b and not lines[a]:
        a += 1
    while b > a and not lines[b - 1]:
        b -= 1
    return "\n".join(lines[a:b])


def page_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text), a row for each row of ``pages``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pages in slices(batch, "html"):
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array([page_text(p) for p in pages], pa.string())], ["page_id", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, text string")
