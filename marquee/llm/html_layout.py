"""Visible text of HTML pages, laid out as a reader would see it.

A small tree builder applies implied tags and void elements, and moves what stands between a table's
cells before the table, as browsers do. Visibility rules leave out what is not shown: elements that
never are, hidden attributes, style attributes, and the rules of a page's own style sheets for an
element, class or id. The renderer keeps block spacing, list markers and preformatted text, and pads
table cells to their column's width, with row and column spans. A table that holds a table lays
out a page and not data, so its cells are blocks one below the other.

Any text is read, in time and space that grow with its length: padding that would make a table over
PADDING times as long as its text is left out, and indents end at DEEPEST_INDENT; no text is.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.markup import Scanner, attributes, unescape
from marquee.llm.common import batch, tidy

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
HIDDEN = frozenset("head script style template noscript iframe object embed audio video canvas datalist noembed noframes select title annotation annotation-xml desc metadata defs".split())
BLOCK = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul xmp caption tr".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
LISTS = frozenset("ul ol menu dir".split())
HEAD_ONLY = frozenset("head title meta link base style script noscript template".split())
#: Start tags that end an open element, and the elements beyond which they don't look.
CLOSES = {
    **{t: (frozenset({"p"}), frozenset("button td th table caption object html".split())) for t in BLOCK - {"html", "body", "li", "dd", "dt", "tr", "caption"}},
    "li": (frozenset({"li", "p"}), LISTS | {"table", "td", "th"}),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl", "table", "td", "th"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl", "table", "td", "th"})),
    "tr": (frozenset("tr td th caption p".split()), frozenset({"table"})),
    "td": (frozenset("td th p".split()), frozenset({"table", "tr"})),
    "th": (frozenset("td th p".split()), frozenset({"table", "tr"})),
    **{t: (frozenset("thead tbody tfoot tr td th caption colgroup p".split()), frozenset({"table"})) for t in ("thead", "tbody", "tfoot")},
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Elements that stand in tables alone, and those between whose parts nothing else is laid out.
ROW_GROUPS = frozenset("thead tbody tfoot".split())
TABLE_PARTS = ROW_GROUPS | frozenset("caption colgroup col tr td th".split())
BETWEEN_CELLS = ROW_GROUPS | {"table", "tr"}
NOT_MOVED = TABLE_PARTS | HIDDEN | {"form", "dialog"}
#: An end tag does not reach beyond these.
SCOPE = frozenset("table td th caption html".split())

#: Largest spans that HTML has (fixed values).
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Layout, not text: wider cells don't widen their column, a table's padding, and columns of indent.
WIDEST, PADDING, DEEPEST_INDENT = 60, 16, 64
_UNSEEN = re.compile(r"visibility\s*+:\s*+(?:hidden|collapse)|font-size\s*+:\s*+0(?:px|em|%)?\s*+(?:;|!|$)|opacity\s*+:\s*+0(?:\.0*+)?\s*+(?:;|!|$)", re.I)
_DISPLAY = re.compile(r"(?:^|;)\s*+display\s*+:\s*+([a-z-]++)", re.I)
_COMPOUND = re.compile(r"([A-Za-z][A-Za-z0-9]*+)?(?:([.#])(-?[A-Za-z_][\w-]*+))?")
_NUMBER = re.compile(r"[ \t\r\n\f]*+([-+]?[0-9]++)")
_SPACES = re.compile(r"[ \t\r\n\f]+")


def number(text: str, otherwise: int) -> int:
    """The number that a text begins with, as HTML reads it; of more than 32 bits it is none."""
    m = _NUMBER.match(text)
    if m is None or len(m[1].lstrip("+-0")) > 10:
        return otherwise
    n = int(m[1])
    return n if -(1 << 31) <= n < 1 << 31 else otherwise


def _shown(style: str) -> bool | None:
    """What declarations say of an element: False hides it, True shows it, None says nothing."""
    found = _DISPLAY.findall(style)
    if found and found[-1].lower() == "none" or _UNSEEN.search(style):
        return False
    return True if found else None


class Styles:
    """Rules of style sheets that show or hide elements, classes and ids; an element's name may stand
    before the class or id. Rules with other selectors or for other media than screens say nothing."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[tuple[str, str, str], bool] = {}
        for sheet in sheets:
            self._read(re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S))

    def _read(self, css: str) -> None:
        open_blocks: list[bool] = []  # whether the rules in each open block count
        at, prelude, out = 0, "", 0  # out: open blocks whose rules don't count
        for m in re.finditer(r"[{}]", css):
            piece, at = css[at : m.start()], m.end()
            if m[0] == "{":
                prelude = piece.rpartition(";")[2].strip()
                if prelude.startswith("@"):
                    words = prelude.lower().split()
                    open_blocks.append(words[0] == "@media" and len(words) > 1 and set(words[1:]) <= {"screen", "all", "only"} and not out)
                    out += not open_blocks[-1]
                    prelude = ""
            elif prelude:
                said = _shown(piece)
                if said is not None and not out:
                    for selector in prelude.split(","):
                        c = _COMPOUND.fullmatch(selector.strip())
                        if c and c[0]:
                            key = ((c[1] or "").lower(), c[2] or "", c[3] or "")
                            self.rules.pop(key, None)
                            self.rules[key] = said
                prelude = ""
            elif open_blocks:
                out -= not open_blocks.pop()

    def shown(self, node: Node) -> bool | None:
        """What the most specific rule says of an element; of equals the last class on it."""
        rules = self.rules
        if not rules:
            return None
        own = node.attributes.get("id", "")
        keys = [(node.tag, "#", own), ("", "#", own)] if own else []
        for name in reversed(node.attributes.get("class", "").split()):
            keys += [(node.tag, ".", name), ("", ".", name)]
        return next((rules[k] for k in (*keys, (node.tag, "", "")) if k in rules), None)


class Node:
    __slots__ = ("tag", "attributes", "children", "marker")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children, self.marker = tag, attributes, [], "- "


class Stack:
    """The open elements, and where those of each tag are, so that no step walks down the stack."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], defaultdict(list)

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """Close all elements from place ``k``, 1 or more, on."""
        while len(self.nodes) > k:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags: Iterable[str]) -> int:
        """The highest place of one of ``tags``, 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def table(self) -> int:
        return self.last(("table",))


def build(text: str) -> Node:
    """The tree of a page. What begins no tag, or a tag that never ends, is text."""
    root = Node("html", {})
    stack = Stack(root)

    def add(piece: str) -> None:
        if piece:
            place(unescape(piece))

    def place(child: Node | str) -> None:
        shown = child.strip(" \t\r\n\f") if isinstance(child, str) else child.tag not in NOT_MOVED
        if shown and stack.top.tag == "colgroup":
            stack.cut(len(stack.nodes) - 1)
        table = stack.table() if shown and stack.top.tag in BETWEEN_CELLS else 0
        if table:
            # the open table is its parent's last child
            above = stack.nodes[table - 1].children
            above.insert(len(above) - 1, child)
        else:
            stack.top.children.append(child)

    scanner, at = Scanner(text), 0
    while at < len(text):
        found, start, end = scanner.tokens(at)
        piece = text[at:start]
        if piece.strip() and stack.top.tag == "head" and len(stack.nodes) == 2:
            stack.cut(1)
        add(piece)
        at = end
        if found is None:
            continue
        tag = found.name
        if found.closing:
            _end(stack, tag)
            continue
        own = {k: unescape(v) for k, (v, _) in attributes(found.rest).items()} if found.rest.strip(" /") else {}
        if tag == "html":
            root.attributes.update(own)
            continue
        if stack.top.tag == "head" and tag not in HEAD_ONLY:
            stack.cut(1)
        table = stack.table() if tag in TABLE_PARTS or tag == "table" else 0
        if tag in TABLE_PARTS and table and (tag != "col" or stack.top.tag != "colgroup"):
            _to_context(stack, table, tag)
        elif tag in CLOSES:
            ends, limit = CLOSES[tag]
            open_ends = [p for t in ends if (p := stack.places.get(t))]
            floor = stack.last(limit) if open_ends else 0
            lowest = [p[k] for p in open_ends if (k := bisect_right(p, floor)) < len(p)]
            if lowest:
                stack.cut(min(lowest))
        if tag == "table" and table and (stack.top.tag in BETWEEN_CELLS or stack.top.tag == "colgroup"):
            stack.cut(table)
        if tag == "a" and stack.places.get("a"):
            _end(stack, "a")
        node = Node(tag, own)
        between = stack.top.tag in BETWEEN_CELLS
        place(node)
        if tag in VOID or tag == "form" and between:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(text, at)
            last = text.find(">", close.end()) if close else -1
            raw = text[at : close.start() if last >= 0 else len(text)]
            node.children.append(unescape(raw) if tag in ("textarea", "title") else raw)
            at = last + 1 if last >= 0 else len(text)
            continue
        if tag == "plaintext":
            node.children.append(text[at:])
            break
        stack.push(node)
    return root


def _to_context(stack: Stack, table: int, tag: str) -> None:
    """Close what is open in the table down to what the part ``tag`` belongs in; a cell outside rows
    gets a row."""
    keep, nodes = table, stack.nodes
    if tag in ("tr", "td", "th") and keep + 1 < len(nodes) and nodes[keep + 1].tag in ROW_GROUPS:
        keep += 1
    if tag in ("td", "th") and keep + 1 < len(nodes) and nodes[keep + 1].tag == "tr":
        keep += 1
    stack.cut(keep + 1)
    if tag in ("td", "th") and stack.top.tag != "tr":
        row = Node("tr", {})
        stack.top.children.append(row)
        stack.push(row)


def _end(stack: Stack, tag: str) -> None:
    k = stack.last((tag,))
    if k and (tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or stack.last(SCOPE) <= k):
        stack.cut(k)


def hidden(node: Node, styles: Styles) -> bool:
    """Whether an element is not shown: what its style attribute says counts before style sheets."""
    a = node.attributes
    if node.tag in HIDDEN or node.tag == "dialog" and "open" not in a:
        return True
    if node.tag == "input" and a.get("type", "").lower() == "hidden":
        return True
    said = _shown(a["style"]) if "style" in a else None
    if said is None:
        said = styles.shown(node)
    return not said if said is not None else "hidden" in a


def width(text: str) -> int:
    """Columns that a text takes: wide characters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Writer:
    """Lines of text, the open one in pieces. ``gap`` is how many line feeds must come before the next text."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.parts: list[str] = []
        self.gap, self.space, self.indent, self.marker, self.bare = 0, False, "", "", True

    def block(self, gap: int) -> None:
        # a block that begins an item stays on the item's line
        self.gap, self.space = max(self.gap, min(gap, 1) if self.marker else gap), False

    def text(self, piece: str) -> None:
        flat = _SPACES.sub(" ", piece)
        inner = flat.strip(" ")
        if not inner:
            self.space = self.space or flat == " "
            return
        self._open()
        if (flat[0] == " " or self.space) and not self.bare and not self.parts[-1].endswith((" ", "\t")):
            self.parts.append(" ")
        self.parts.append(inner)
        self.space, self.marker, self.bare = flat[-1] == " ", "", False

    def _open(self) -> None:
        if self.gap and (self.done or self.parts):
            self._feed()
            self.done += [""] * (self.gap - 1)
        self.gap = 0
        if not self.parts and (self.indent or self.marker):
            self.parts.append(self.indent + self.marker)

    def _feed(self) -> None:
        self.done.append("".join(self.parts))
        self.parts, self.bare = [], True

    def feed(self) -> None:
        if self.gap:
            self._open()
        self._feed()
        self.space = False

    def raw(self, lines: list[str]) -> None:
        for k, line in enumerate(lines):
            if k:
                self._feed()
                self.parts = [self.indent] if self.indent else []
            else:
                self._open()
            if line:
                self.parts.append(line)
                self.bare = False
        self.marker = ""

    def result(self) -> str:
        lines = [x.rstrip(" ") for x in (*self.done, "".join(self.parts))]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def _inner_tables(root: Node) -> tuple[list[Node], list[str]]:
    """The tables that hold no other, and the style sheets. Walks with a stack of its own, like
    render(): nesting has no limit."""
    found, sheets, todo = [], [], [(root, None)]
    outer: set[int] = set()
    while todo:
        node, table = todo.pop()
        if node.tag == "style":
            sheets.append("".join(c for c in node.children if isinstance(c, str)))
        if node.tag == "table":
            if table is not None:
                outer.add(id(table))
            found.append(node)
            table = node
        todo.extend((c, table) for c in reversed(node.children) if isinstance(c, Node))
    return [t for t in found if id(t) not in outer], sheets


def page_layout(root: Node) -> str:
    """Visible text below the root of a page."""
    inner, sheets = _inner_tables(root)
    styles = Styles(sheets)
    laid_out = {id(t): table_lines(t, styles) for t in inner}
    return render(root, styles, laid_out)


def render(root: Node, styles: Styles, tables: dict[int, list[str]]) -> str:
    """Visible text below ``root``; ``tables`` has the lines of tables by identity, others are blocks."""
    out = Writer()
    todo: list[tuple] = [("node", root, False)]
    while todo:
        what, node, pre = todo.pop()
        if what == "do":
            node()
            continue
        if isinstance(node, str):
            if pre:
                out.raw(node.split("\n"))
            else:
                out.text(node)
            continue
        tag = node.tag
        if hidden(node, styles):
            continue
        if tag == "br":
            out.feed()
            continue
        if tag == "hr":
            out.block(1)
            out.raw(["---"])
            out.block(1)
            continue
        if tag == "img":
            out.text(f" {node.attributes.get('alt', '')} " if node.attributes.get("alt", "").strip() else "")
            continue
        if tag == "input":
            if node.attributes.get("type", "text").lower() in ("submit", "button", "reset", "text"):
                out.text(f" {node.attributes.get('value', '')} ")
            continue
        if id(node) in tables:
            out.block(2)
            if tables[id(node)]:
                out.raw(tables[id(node)])
            out.block(2)
            continue
        gap = 2 if tag in SPACED else 1 if tag in BLOCK or tag in ("textarea", "td", "th") else 0
        after: list = []
        if gap:
            nested = tag in LISTS and bool(out.indent)
            out.block(1 if nested else gap)
            after.append(lambda gap=1 if nested else gap: out.block(gap))
        indent = out.indent
        if tag in LISTS:
            k = number(node.attributes.get("start", ""), 1) if tag == "ol" else 1
            for child in node.children:
                if isinstance(child, Node) and child.tag == "li" and not hidden(child, styles):
                    k = number(child.attributes.get("value", ""), k) if tag == "ol" else k
                    child.marker = f"{k}. " if tag == "ol" else "- "
                    k += 1
        elif tag == "li":
            out.marker = node.marker
            after.append(lambda indent=indent: (setattr(out, "indent", indent), setattr(out, "marker", "")))
        elif tag in ("blockquote", "dd"):
            out.indent = (indent + "  ")[:DEEPEST_INDENT]
            after.append(lambda indent=indent: setattr(out, "indent", indent))
        todo.extend(("do", f, False) for f in after)
        if tag == "li":
            first = min(len(indent) + len(out.marker), DEEPEST_INDENT)
            rest = node.children
            todo.extend(("node", c, pre) for c in reversed(rest[1:]))
            todo.append(("do", lambda n=first: setattr(out, "indent", " " * n), False))
            todo.extend(("node", c, pre) for c in rest[:1])
        else:
            inner = pre or tag in ("pre", "xmp", "plaintext", "textarea")
            children = node.children
            if tag == "details" and "open" not in node.attributes:
                # Closed: its summary alone is shown.
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if inner and not pre and children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
            todo.extend(("node", c, inner) for c in reversed(children))
    return out.result()


def _rows(table: Node, styles: Styles) -> Iterator[Node]:
    for c in table.children:
        if isinstance(c, Node) and not hidden(c, styles):
            if c.tag == "tr":
                yield c
            elif c.tag in ROW_GROUPS:
                yield from (r for r in c.children if isinstance(r, Node) and r.tag == "tr" and not hidden(r, styles))


def _span(cell: Node, name: str, most: int) -> int:
    n = number(cell.attributes.get(name, ""), 1)
    return min(n, most) if n > 0 else 1


class Spans:
    """Until which row each column is taken by cells that span rows: a tree over the columns whose nodes are made
    where spans are, so that a span and a search take steps that grow with the logarithm of the columns."""

    def __init__(self) -> None:
        # by (level, place) of a node: the row until which all of it is taken at once, and the first row at which
        # some column of it is free
        self.levels, self.whole, self.free = 1, {}, {}

    def take(self, first: int, columns: int, until: int) -> None:
        """Takes ``columns`` from ``first`` on until row ``until``."""
        while first + columns > 1 << self.levels:
            # the root becomes the left half of a larger one
            self.levels += 1
        ends = set()
        level, lo, hi = 0, first, first + columns
        while lo < hi:
            for place, odd in ((lo, lo & 1), (hi - 1, hi & 1)):
                if odd and (node := (level, place)) not in ends:
                    ends.add(node)
                    self.whole[node] = max(self.whole.get(node, 0), until)
                    self.free[node] = max(self.free.get(node, 0), until)
            level, lo, hi = level + 1, (lo + 1) >> 1, hi >> 1
        # nodes above those two runs of nodes, from the leaves up
        left, right = first, first + columns - 1
        for up in range(1, self.levels + 1):
            left, right = left >> 1, right >> 1
            for place in {left, right}:
                below = min(self.free.get((up - 1, 2 * place), 0), self.free.get((up - 1, 2 * place + 1), 0))
                self.free[up, place] = max(self.whole.get((up, place), 0), below)

    def next_free(self, column: int, row: int) -> int:
        """The first column, ``column`` or a later one, that is free in ``row``."""
        if column >= 1 << self.levels:
            return column
        # past the highest node that is taken as a whole, then to the right, by nodes as high as they begin there,
        # and down to the first free column
        level = max((k for k in range(self.levels + 1) if self.whole.get((k, column >> k), 0) > row), default=0)
        place = column >> level
        while place < 1 << (self.levels - level):
            if self.free.get((level, place), 0) > row:
                place += 1
                while not place & 1 and level < self.levels:
                    level, place = level + 1, place >> 1
            elif level == 0:
                return place
            else:
                level, place = level - 1, 2 * place
        return 1 << self.levels


def _grid(table: Node, styles: Styles) -> list[list[tuple[int, int, list[str]]]]:
    """(first column, columns, lines) of the cells of each row. Cells that span rows keep their
    columns from the rows below."""
    grid, spans = [], None
    for r, row in enumerate(_rows(table, styles)):
        cells, column, new = [], 0, []
        for cell in row.children:
            if isinstance(cell, Node) and cell.tag in ("td", "th") and not hidden(cell, styles):
                if spans is not None:
                    column = spans.next_free(column, r)
                body = Node("div", {})
                body.children = cell.children
                across, down = _span(cell, "colspan", MOST_COLUMNS), _span(cell, "rowspan", MOST_ROWS)
                cells.append((column, across, render(body, styles, {}).split("\n")))
                if down > 1:
                    new.append((column, across, r + down))
                column += across
        for taken in new:
            spans = spans or Spans()
            spans.take(*taken)
        if cells:
            grid.append(cells)
    return grid


def table_lines(table: Node, styles: Styles) -> list[str]:
    """A caption's lines, then the rows with each cell padded to its column, lines of a cell below
    one another. Text outside rows comes first, as browsers put it."""
    lead = Node("div", {})
    lead.children = [c for c in table.children if isinstance(c, str) or c.tag not in ("tr", *ROW_GROUPS)]
    lines = [x for x in render(lead, styles, {}).split("\n") if x]
    grid = _grid(table, styles)
    widths: dict[int, int] = defaultdict(int)
    for cells in grid:
        for column, span, text in cells:
            own = max(map(width, text)) if span == 1 else 0
            widths[column] = max(widths[column], own if own <= WIDEST else 0)
    columns = sorted(widths)  # only columns that some cell begins at take room
    edges = [0]
    for c in columns:
        edges.append(edges[-1] + widths[c] + 2)
    place = {c: k for k, c in enumerate(columns)}
    ends = [[place[c] for c, _, _ in cells] for cells in grid]
    most = sum(max(len(t) for _, _, t in cells) * (edges[at[-1]] if at else 0) for cells, at in zip(grid, ends))
    aligned = most <= PADDING * sum(len(x) + 2 for cells in grid for _, _, t in cells for x in t) + 4096
    for cells, at in zip(grid, ends):
        for k in range(max(len(text) for _, _, text in cells)):
            pieces, used = [], 0
            for (column, span, text), first in zip(cells, at):
                piece = text[k] if k < len(text) else ""
                if not aligned:
                    pieces.append(piece)
                    continue
                gap = edges[first] - used
                if piece:
                    if pieces:
                        gap = max(gap, 2)
                    pieces.append(" " * max(0, gap) + piece)
                    used += max(0, gap) + width(piece)
            lines.append(("" if aligned else "  ").join(pieces).rstrip(" "))
    return lines


def page_text(page: str | None) -> str:
    return page_layout(build(page)) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``. A null or empty page has an empty
    text; rows that repeat stay; other columns are not read."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.large_string()), ("n_chars", pa.int64())])

    def laid_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                texts = [page_text(p) for p in part.column(2).to_pylist()]
                yield batch(schema, [part.column(0), part.column(1).cast(pa.string()), texts, list(map(len, texts))])

    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return columns.mapInArrow(tidy(laid_out), "page_id long, url string, text string, n_chars long")
