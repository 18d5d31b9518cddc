"""HTML extraction by layout-aware rendering.

A tree builder turns tags into well-nested start and end events (void, implied and forgotten end
tags, raw text), skips what is not shown (scripts, styles, head matter, ``hidden``, inline styles and
simple style-sheet rules with ``display:none`` or ``visibility:hidden``), and a renderer lays the rest
out: blocks apart, lists with markers and indents, table cells in aligned columns, white space
collapsed but in ``pre``. All visible text is kept. Both work through one stack, so nesting depth and
length are limited by memory only, and both take time in proportion to the page, however broken: the
scanner never reads a stretch twice, open elements are found by name, not by search, and a table is kept as a
block of cells, whose text is written once, at the end, however many tables it stands in.

Defined cases: null html gives null text; an empty page or one without visible text gives an empty
text; broken markup is text or ignored, never an error; a quote that never closes is an ordinary sign; a
``<`` without any ``>`` ahead is text; a cell spans ``SPAN`` columns and rows at most; rules inside at-rules hold for plain screen media only, and of two
rules for a selector the later one; repeated rows are rendered each; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from reefline.llm._frames import map_text

#: Element kinds and rules of HTML, fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes datalist audio video canvas object meta link base".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table hr fieldset".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside header footer nav main address form li dt dd tr td th thead tbody tfoot caption figcaption details summary legend center option optgroup select dialog menu".split()
)
#: A start tag of the key closes an open element of the value, up to the nearest of STOPS.
CLOSES = {
    **dict.fromkeys("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul details menu".split(), {"p"}),
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "caption", "p"},
    **dict.fromkeys(("tbody", "thead", "tfoot"), {"td", "th", "tr", "caption", "tbody", "thead", "tfoot", "p"}), "body": {"head"},
}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
_CELL_STOPS, _OTHER_STOPS = {"table"}, {"td", "th", "table", "button", "caption"}
_PARTS, _CELLS, _P = frozenset("table tr tbody thead tfoot td th body html".split()), frozenset(("td", "th", "table")), {"p"}
HEAD_ONLY = frozenset("title meta link base style script".split())

#: Widest aligned cell, deepest indent, rightmost column of a cell, most columns or rows of a span; what is wider or deeper stays whole.
WIDEST, DEEPEST, RIGHTMOST, SPAN = 60, 80, 400, 100
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BRACE = re.compile(r"[{};]")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_GONE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_SHOWN = re.compile(r"display\s*:\s*(?!none)[a-z]|visibility\s*:\s*visible", re.I)
_SEEN = re.compile(r"visibility\s*:\s*visible", re.I)
_SCREEN = re.compile(r"@media\s+(?:only\s+)?(?:screen|all)\s*$", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class _Flow:
    """Lines of one block context."""

    def __init__(self) -> None:
        self.lines: list = []  # lines, and tables with what stands before their first line
        self.line: list[str] = []
        self.gap, self.indent, self.marker = 0, "", ""
        self.open_space = False

    def put(self, text: str, pre: bool) -> None:
        if pre:
            first, *more = text.split("\n")
            self.line.append(first)
            for x in more:
                self.end(True)
                self.line.append(x)
            return
        text = _SPACE.sub(" ", text)
        if text.startswith(" ") and (not self.line or self.open_space):
            text = text[1:]
        if text:
            self.line.append(text)
            self.open_space = text.endswith(" ")

    def end(self, force: bool = False) -> None:
        text = "".join(self.line).rstrip()
        self.line, self.open_space = [], False
        if text or force:
            if self.lines and self.gap:
                self.lines.append("")
            self.lines.append((self.indent + self.marker + text).rstrip())
            self.gap, self.marker = 0, " " * len(self.marker)

    def table(self, block: _Block) -> None:
        if block.height:
            if self.lines and self.gap:
                self.lines.append("")
            self.lines.append((self.indent + self.marker, block))
            self.gap, self.marker = 0, " " * len(self.marker)

    def block(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)


class _Block:
    """A laid-out table: cells with their first line and column. What stands in them is written only once, at the page's end."""

    def __init__(self, rows: list[list[list]]) -> None:
        sizes = [[_size(cell) for cell in row] for row in rows]
        width: dict[int, int] = {}
        for row in sizes:
            for k, (_, right) in enumerate(row):
                width[k] = max(width.get(k, 0), min(WIDEST, right))
        at = [0]
        for k in range(len(width)):
            at.append(min(at[-1] + width[k] + 2, RIGHTMOST))
        self.cells: list[tuple[list, int, int]] = []
        self.height = self.right = 0
        for row, of in zip(rows, sizes, strict=True):
            for k, (cell, (_, right)) in enumerate(zip(row, of, strict=True)):
                if right:
                    self.cells.append((cell, self.height, at[k]))
                    self.right = max(self.right, min(at[k] + right, RIGHTMOST))
            self.height += max((h for h, _ in of), default=0)


def _size(items: list) -> tuple[int, int]:
    """Lines and width of lines and blocks below each other."""
    height = right = 0
    for x in items:
        if isinstance(x, str):
            height, right = height + 1, max(right, len(x))
        else:
            height, right = height + x[1].height, max(right, len(x[0]) + x[1].right)
    return height, right


def _written(items: list) -> list[str]:
    """The lines of a page: every piece of text is put at its line and column once, left cells before right ones."""
    lines: list[list[tuple[int, str]]] = [[] for _ in range(_size(items)[0])]
    todo = [(items, 0, 0)]
    while todo:
        some, line, column = todo.pop()
        for x in some:
            if isinstance(x, str):
                if x:
                    lines[line].append((column, x))
                line += 1
                continue
            lead, block = x
            if mark := lead.rstrip():
                lines[line].append((column, mark))
            inner = min(column + len(lead), RIGHTMOST)
            todo.extend((cell, line + y, min(inner + k, RIGHTMOST)) for cell, y, k in reversed(block.cells))
            line += block.height
    out = []
    for pieces in lines:
        n, parts = 0, []
        for column, text in pieces:
            gap = column - n if n < column else 2 if parts else 0
            parts += (" " * gap, text)
            n += gap + len(text)
        out.append("".join(parts).rstrip())
    return out


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[list]] = []
        self.down: dict[int, int] = {}  # column: rows below that a cell above still covers

    def row(self) -> None:
        self.rows.append([])
        self.fill()

    def fill(self) -> None:
        """Empty cells where one above reaches down to."""
        row = self.rows[-1]
        while self.down.get(len(row), 0) > 0:
            self.down[len(row)] -= 1
            row.append([""])

    def cell(self, items: list, across: int, down: int) -> None:
        if not self.rows:
            self.row()
        for k in range(across):
            if down > 1:
                self.down[len(self.rows[-1])] = down - 1
            self.rows[-1].append([""] if k else items)
        self.fill()


def rules_of(sheet: str) -> Iterator[tuple[str, bool]]:
    """Selectors of a style sheet with whether they hide, in order; at-rules but plain screen media are
    passed over.
    """
    sheet = _COMMENT.sub(" ", sheet)
    at, skip, depth, opened = 0, 0, 0, ""
    for m in _BRACE.finditer(sheet):
        piece = sheet[at : m.start()]
        at = m.end()
        if m[0] == ";":
            if not opened:
                continue
            at = m.start() - len(piece)  # a declaration; the body goes on
            continue
        if m[0] == "{":
            head = piece.strip()
            depth += 1
            if skip:
                continue
            if head.startswith("@"):
                if not _SCREEN.match(head):
                    skip = depth
            else:
                opened = head
            continue
        if skip:
            skip = 0 if depth <= skip else skip
        elif opened:
            gone = bool(_GONE.search(piece))
            if gone or _SHOWN.search(piece):
                for s in opened.split(","):
                    yield s.strip(), gone
        opened, depth = "", max(0, depth - 1)


def _hidden(name: str, attributes: dict[str, str], rules: set[str]) -> bool:
    if name in UNSEEN or "hidden" in attributes or _GONE.search(attributes.get("style", "")):
        return True
    if name == "input" or name == "dialog" and "open" not in attributes:
        return True
    return bool(rules) and (name in rules or "#" + attributes.get("id", "") in rules or any("." + c in rules or f"{name}.{c}" in rules for c in attributes.get("class", "").split()))


class _Page:
    def __init__(self) -> None:
        self.open: list[tuple[str, bool, int]] = []  # element, whether it begins an unseen part, kinds of hiding before
        self.at: dict[str, list[int]] = defaultdict(list)  # places of the open elements of a name
        self.blocks: list[int] = []  # places of the open block elements
        self.unseen = self.veiled = self.pre = 0  # veiled: unseen parts by visibility alone, which parts inside may lift
        self.flows, self.tables, self.lists, self.indents = [_Flow()], [], [], []
        self.rules: set[str] = set()

    def last(self, names: frozenset[str] | set[str]) -> int:
        """Place of the innermost open element of these names, -1 if none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def start(self, name: str, attributes: dict[str, str]) -> None:
        closes = CLOSES.get(name)
        if closes:
            stops = STOPS.get(name) or (_CELL_STOPS if name in ("td", "th", "tr", "tbody", "thead", "tfoot") else _OTHER_STOPS)
            stop = self.last(stops)
            while (k := self.last(closes)) > stop and k >= 0:
                if name not in STOPS and closes == _P and self.blocks and self.blocks[-1] > k:
                    break
                self.close_to(k)
        if name not in HEAD_ONLY and self.open and self.open[-1][0] == "head" and name in BLOCK:
            self.close_to(len(self.open) - 1)
        gone = not self.unseen and _hidden(name, attributes, self.rules)
        if name in VOID:
            if not self.unseen and not gone:
                if name == "br":
                    self.flows[-1].end(True)
                elif name == "hr":
                    self.flows[-1].block(1)
                elif name == "img" and attributes.get("alt"):
                    self.text(attributes["alt"])
            return
        before = self.unseen, self.veiled
        if self.unseen and self.unseen == self.veiled and _SEEN.search(attributes.get("style", "")):
            self.unseen = self.veiled = 0  # shown again inside a part hidden by visibility
        elif gone:
            self.unseen += 1
            self.veiled += name not in UNSEEN and "hidden" not in attributes and "display" not in attributes.get("style", "").lower() and bool(_GONE.search(attributes.get("style", "")))
        self.open.append((name, gone or before != (self.unseen, self.veiled), before))
        self.at[name].append(len(self.open) - 1)
        if name in BLOCK:
            self.blocks.append(len(self.open) - 1)
        flow = self.flows[-1]
        if self.unseen:
            if self.unseen == self.veiled and name in BLOCK and name not in _PARTS:
                flow.block(0)  # hidden by visibility: its place stays
            return
        if name in BLOCK and name not in ("td", "th", "tr", "thead", "tbody", "tfoot"):
            flow.block(1 if name in SPACED and not (name in ("ul", "ol") and self.lists) else 0)
        if name in ("ul", "ol", "menu"):
            first = attributes.get("start", "1")
            self.lists.append([name, int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1, flow.indent])
        elif name == "li":
            kind, number, indent = self.lists[-1] if self.lists else ("ul", 1, flow.indent)
            flow.indent, flow.marker = indent + "  " * (len(self.lists) > 1 and len(indent) < DEEPEST), f"{number}. " if kind == "ol" else "- "
            if self.lists:
                self.lists[-1][1] += 1
        elif name in ("dd", "blockquote"):
            self.indents.append(flow.indent)
            flow.indent += "  " * (len(flow.indent) < DEEPEST)
        elif name in ("pre", "textarea"):
            self.pre += 1
        elif name == "table":
            self.tables.append(_Table())
        elif name == "tr" and self.tables:
            self.tables[-1].row()
        elif name in ("td", "th") and self.tables:
            self.flows.append(_Flow())
            number = lambda key: min(int(n), SPAN) if (n := attributes.get(key, "1")).isdecimal() and n.isascii() and len(n) < 9 else 1
            self.flows[-1].span = max(1, number("colspan")), max(1, number("rowspan"))

    def close_to(self, k: int) -> None:
        while len(self.open) > k:
            name, changed, before = self.open.pop()
            self.at[name].pop()
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()
            shown, veiled = not self.unseen, self.unseen == self.veiled
            if changed:
                self.unseen, self.veiled = before
            if shown:
                self.end(name)
            elif veiled and name in BLOCK and name not in _PARTS:
                self.flows[-1].block(0)

    def close(self, name: str) -> None:
        """An end tag: closes the innermost element of its name, but none outside of a table part for others."""
        places = self.at.get(name)
        k = places[-1] if places else -1
        if k >= 0 and (name in _PARTS or k >= self.last(_CELLS)):
            self.close_to(k)
        elif name == "p":
            self.flows[-1].block(1)

    def end(self, name: str) -> None:
        flow = self.flows[-1]
        if name in ("td", "th") and self.tables and len(self.flows) > 1:
            flow.end()
            self.flows.pop()
            self.tables[-1].cell(flow.lines or [""], *getattr(flow, "span", (1, 1)))
            return
        if name in ("tr", "thead", "tbody", "tfoot"):
            return
        if name == "table" and self.tables:
            flow.block(1)
            flow.table(_Block(self.tables.pop().rows))
            flow.block(1)
            return
        if name in BLOCK:
            flow.block(1 if name in SPACED and not (name in ("ul", "ol") and len(self.lists) > 1) else 0)
        if name in ("ul", "ol", "menu") and self.lists:
            flow.indent, flow.marker = self.lists.pop()[2], ""
        elif name == "li":
            flow.indent, flow.marker = self.lists[-1][2] if self.lists else "", ""
        elif name in ("dd", "blockquote"):
            flow.indent = self.indents.pop()
        elif name in ("pre", "textarea"):
            self.pre -= 1

    def text(self, raw: str) -> None:
        if raw and not self.unseen:
            self.flows[-1].put(html.unescape(raw) if "&" in raw else raw, self.pre > 0)


class _Scanner:
    """Tags of a page from left to right."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def tag_end(self, i: int) -> int:
        """Place of the ``>`` that ends a tag whose attributes begin at i; quoted ones don't count."""
        page, k = self.page, i
        while self.quotes:
            k = _PLAIN.match(page, k).end()
            if k >= len(page):
                self.quotes = False  # read to the end in vain: from here on quotes are ordinary
            elif page[k] == ">":
                return k
            else:
                close = page.find(page[k], k + 1)
                if close < 0:
                    self.quotes = False
                k = close + 1
        return page.find(">", i)

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """Start, end, name (empty for comments), whether it is an end tag, attributes. ``at`` may be moved."""
        page, self.at = self.page, 0
        while (i := page.find("<", self.at)) >= 0:
            if page.startswith("<!--", i):
                stop = page.find("-->", i + 4)
                self.at = stop + 3 if stop >= 0 else len(page)
                yield i, self.at, "", False, ""
                continue
            if page.startswith(("<!", "<?"), i):
                stop = page.find(">", i) if i < self.last else -1
                self.at = stop + 1 if stop >= 0 else len(page)
                yield i, self.at, "", False, ""
                continue
            end = page.startswith("</", i)
            m = _NAME.match(page, i + 1 + end) if i < self.last else None
            if not m or m.end() > self.last:
                at, self.at = self.at, i + 1  # a sign of the text
                yield at, i + 1, "<", False, ""
                continue
            stop = self.tag_end(m.end())
            self.at = stop + 1
            yield i, self.at, m[0].lower(), end, page[m.end() : stop]


def render(page: str) -> str:
    p, at, scan = _Page(), 0, _Scanner(page)
    ends: dict[str, bool] = {}  # raw elements whose end tag may still come
    for start, stop, name, end, rest in scan.tags():
        if name == "<":
            p.text(page[at:stop])
            at = stop
            continue
        p.text(page[at:start])
        at = stop
        if not name:
            continue
        if end:
            p.close(name)
            continue
        p.start(name, {a.lower(): html.unescape(x or y or z) for a, x, y, z in reversed(_ATTRIBUTE.findall(rest))})
        if name in RAW:
            found = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at) if ends.get(name, True) else None
            ends[name] = found is not None
            stop = found.start() if found else len(page)
            if name == "style":
                for selector, gone in rules_of(page[at:stop]):
                    (p.rules.add if gone else p.rules.discard)(selector)
            p.text(page[at:stop])
            at = scan.at = found.end() if found else len(page)
            if p.open and p.open[-1][0] == name:
                p.close_to(len(p.open) - 1)
    p.text(page[at:])
    p.close_to(0)
    p.flows[0].end()
    return "\n".join(_written(p.flows[0].lines)).strip("\n")


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (``page_id, url``) and the page's visible ``text``."""
    run = lambda t: {"text": pa.array([None if x is None else render(x) for x in t.to_pylist()], pa.string())}
    return map_text(pages, run, "text string", ["page_id", "url"] if keep is None else keep, "html")
