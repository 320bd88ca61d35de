"""Layout-aware text of HTML pages.

A small tree builder closes what HTML lets authors leave open, visibility rules drop what a browser would not show, and
the tree is laid out as text: blocks on lines of their own with blank lines where browsers put margins, list items with
markers and indents, table cells in aligned columns, white space collapsed but for preformatted text.

A null or empty page has an empty text. Elements nested deeper than ``DEEPEST`` go on as siblings at that depth, text
included. Rows that repeat come out repeated; a null page_id stays null. Other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEPEST = 200

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
PLAIN_TEXT = frozenset("textarea title".split())
NEVER_SHOWN = frozenset("area base datalist embed head iframe link meta noembed noframes noscript object param script source "
                        "style template title track audio video canvas svg math".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary "
                   "table ul caption tr td th thead tbody tfoot optgroup option".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul dir".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                     "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: An opening tag closes the nearest of these, unless one of the barriers is nearer.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"optgroup", "option"}, {"select"}),
    "tr": ({"tr", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "body": ({"head"}, {"body"}),
}
#: An end tag does not reach beyond these.
_BARRIERS = frozenset({"table", "td", "th", "caption", "button", "template"})
_OF_TABLES = frozenset("table tr td th caption tbody thead tfoot".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*)>|[^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!important\s*)?(?:;|$)")
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|initial|hidden|collapse)\s*(?:!important\s*)?(?=;|$)")


class Element:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []


def parse(page: str) -> Element:
    """The element tree of a page."""
    root = Element("#root", {})
    stack, place = [root], 0

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(unescape(piece) if "&" in piece else piece)

    def close(names, barriers) -> bool:
        for n in range(len(stack) - 1, 0, -1):
            if stack[n].name in names:
                del stack[n:]
                return True
            if stack[n].name in barriers:
                break
        return False

    while (token := _TOKEN.search(page, place)) is not None:
        text(page[place:token.start()])
        place = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if token["close"]:
            if name == "br":
                stack[-1].children.append(Element("br", {}))
            elif not close({name}, {"table"} - {name} if name in _OF_TABLES else _BARRIERS - {name}) and name == "p":
                stack[-1].children.append(Element("p", {}))
            continue
        rest = token["rest"]
        attributes = {}
        if "=" in rest or not rest.startswith(">"):
            for key, one, two, bare in _ATTRIBUTE.findall(rest):
                attributes.setdefault(key.lower(), unescape(one or two or bare))
        if name in CLOSES_P:
            close({"p"}, _BARRIERS)
        if name in CLOSES:
            close(*CLOSES[name])
        element = Element(name, attributes)
        stack[-1].children.append(element)
        if name in VOID:
            continue
        if name in RAW_TEXT or name in PLAIN_TEXT:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, place)
            inner = page[place:end.start() if end else len(page)]
            element.children.append(unescape(inner) if name in PLAIN_TEXT else inner)
            place = end.end() if end else len(page)
        elif len(stack) <= DEEPEST:
            stack.append(element)
    text(page[place:])
    if "visibility" in page.lower():
        settle_visibility(root)
    return root


def settle_visibility(root: Element) -> None:
    """Take out what ``visibility`` hides. Elements inherit it and can take it back; one with nothing visible inside goes."""
    found, at = [(root, True)], 0
    while at < len(found):
        element, seen = found[at]
        at += 1
        for child in element.children:
            if isinstance(child, Element):
                said = _VISIBILITY.findall(child.attributes.get("style", "").lower())
                found.append((child, said[-1] in ("visible", "initial") if said else seen))
    kept = set()
    for element, seen in reversed(found):
        element.children = [c for c in element.children if (id(c) in kept if isinstance(c, Element) else seen)]
        if seen or element.children:
            kept.add(id(element))


def shown(element: Element) -> bool:
    if element.name in NEVER_SHOWN:
        return False
    given = element.attributes
    if not given:
        return element.name != "dialog"
    if "hidden" in given and given["hidden"].lower() != "until-found" or element.name == "dialog" and "open" not in given:
        return False
    style = given.get("style")
    return not (style and _HIDING.search(style.lower()))


class Lines:
    """Lines of text with collapsed white space; a blank line is kept back until something follows it."""

    def __init__(self, in_item: bool = False):
        #: Lists in list items have no margins.
        self.in_item = in_item
        self.lines: list[str] = []
        self._open: list[str] = []
        self._space = self._blank = False

    def text(self, piece: str) -> None:
        piece = _SPACE.sub(" ", piece)
        inner = piece.strip(" ")
        if not inner:
            self._space = self._space or bool(piece)
            return
        if (self._space or piece[0] == " ") and self._open:
            self._open.append(" ")
        self._open.append(inner)
        self._space = piece[-1] == " "

    def preformatted(self, piece: str) -> None:
        for n, line in enumerate(piece.replace("\r\n", "\n").split("\n")):
            if n:
                self.new_line()
            if line:
                self._open.append(line)

    def _emit(self, line: str) -> None:
        if self._blank and self.lines:
            self.lines.append("")
        self._blank = False
        self.lines.append(line)

    def new_line(self) -> None:
        if self._open:
            self.end_line()
        elif self.lines:
            self.lines.append("")

    def end_line(self) -> None:
        if self._open:
            self._emit("".join(self._open).rstrip(" "))
            self._open = []
        self._space = False

    def blank(self) -> None:
        self.end_line()
        self._blank = True

    def extend(self, lines: list[str]) -> None:
        self.end_line()
        for line in lines:
            self._emit(line)

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _inner(element: Element, as_is: bool = False) -> list[str]:
    out = Lines(element.name == "li")
    _flow(element, out, as_is)
    return out.done()


def _number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"-?\d{1,6}", text.strip()) else default


def _list(element: Element, out: Lines) -> None:
    number = _number(element.attributes.get("start"), 1)
    for child in element.children:
        if isinstance(child, Element) and child.name == "li":
            if not shown(child):
                continue
            number = _number(child.attributes.get("value"), number)
            marker = f"{number}. " if element.name == "ol" else "- "
            number += 1
            lines = _inner(child) or [""]
            out.extend([(marker + lines[0]).rstrip()] + [" " * len(marker) + x if x else "" for x in lines[1:]])
        else:
            loose = Lines()
            _node(child, loose, False)
            out.extend(loose.done())


def _rows(element: Element):
    """(caption or row) elements of a table in the order in which they are shown: head, bodies, foot."""
    order = {"thead": 0, "tfoot": 2}
    parts: tuple[list, list, list] = ([], [], [])
    for child in element.children:
        if not isinstance(child, Element):
            if child.strip():
                parts[1].append(child)
        elif child.name in ("thead", "tbody", "tfoot"):
            if shown(child):
                parts[order.get(child.name, 1)].extend(c for c in child.children if isinstance(c, Element) or c.strip())
        else:
            parts[1].append(child)
    return [c for part in parts for c in part]


def _table(element: Element, out: Lines) -> None:
    grid: list[list[tuple[int, list[str]]]] = []
    widths: dict[int, int] = {}
    covered: dict[int, int] = {}
    for row in _rows(element):
        if not isinstance(row, Element) or row.name != "tr":
            loose = Lines()
            _node(row, loose, False)
            out.extend(loose.done())
            continue
        if not shown(row):
            continue
        column, cells = 0, []
        covered = {c: n - 1 for c, n in covered.items() if n > 1}
        below: dict[int, int] = {}
        for cell in row.children:
            if isinstance(cell, str):
                if cell.strip():
                    cells.append((column, [" ".join(cell.split())]))
                continue
            if not shown(cell):
                continue
            while column in covered:
                column += 1
            span = max(1, min(_number(cell.attributes.get("colspan"), 1), 1000)) if cell.name in ("td", "th") else 1
            down = max(1, min(_number(cell.attributes.get("rowspan"), 1), 65534)) if cell.name in ("td", "th") else 1
            lines = _inner(cell)
            cells.append((column, lines))
            if span == 1:
                widths[column] = max(widths.get(column, 0), max(map(len, lines), default=0))
            else:
                widths.setdefault(column, 0)
            if down > 1:
                below.update((c, down) for c in range(column, column + span))
            column += span
        covered.update(below)
        if cells:
            grid.append(cells)
    left, at = {}, 0
    for column in range(max([*widths, *(c for cells in grid for c, _ in cells)], default=-1) + 1):
        left[column] = at
        at += widths[column] + 2 if widths.get(column) else 0
    for cells in grid:
        for n in range(max(len(lines) for _, lines in cells)):
            line = ""
            for column, lines in cells:
                if n < len(lines) and lines[n]:
                    line = line.ljust(left[column]) if len(line) <= left[column] else line + "  "
                    line += lines[n]
            out.extend([line])


def _choice(element: Element) -> Element | None:
    """The option that a closed select shows."""
    options, todo = [], [element]
    while todo:
        now = todo.pop()
        options += [now] if now.name == "option" else []
        todo += [c for c in reversed(now.children) if isinstance(c, Element)]
    return next((o for o in options if "selected" in o.attributes), options[0] if options else None)


def _node(node: Element | str, out: Lines, as_is: bool) -> None:
    if isinstance(node, str):
        (out.preformatted if as_is else out.text)(node)
        return
    if not shown(node):
        return
    name = node.name
    if name == "br":
        out.new_line()
    elif name == "hr":
        out.blank()
    elif name == "wbr" or name in VOID:
        return
    elif name in ("ul", "ol", "menu", "dir"):
        edge = out.end_line if out.in_item else out.blank
        edge()
        _list(node, out)
        edge()
    elif name == "table":
        out.blank()
        _table(node, out)
        out.blank()
    elif name == "select":
        choice = _choice(node)
        if choice is not None:
            out.text(" ")
            _flow(choice, out, False)
            out.text(" ")
    elif name == "details" and "open" not in node.attributes:
        out.end_line()
        for child in node.children:
            if isinstance(child, Element) and child.name == "summary":
                _node(child, out, False)
                break
        out.end_line()
    elif name in BLOCKS:
        edge = out.blank if name in SPACED else out.end_line
        edge()
        if name == "pre":
            if node.children and isinstance(node.children[0], str) and node.children[0].startswith("\n"):
                node.children[0] = node.children[0][1:]
            _flow(node, out, True)
        elif name in ("blockquote", "dd"):
            out.extend(["  " + x if x else "" for x in _inner(node, as_is)])
        else:
            _flow(node, out, as_is)
        edge()
    else:
        _flow(node, out, as_is)


def _flow(element: Element, out: Lines, as_is: bool) -> None:
    for child in element.children:
        _node(child, out, as_is)


def render(page: str | None) -> str:
    """Visible text of a page."""
    return "\n".join(_inner(parse(page))).replace(" ", " ") if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, text, n_lines, n_chars`` of every page."""
    def run(batches):
        for batch in batches:
            texts = [render(page.as_py()) for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "text", "n_lines", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, text string, n_lines long, n_chars long")
