"""HTML extraction by layout-aware rendering.

A tree builder reads the tags of a page, closing what HTML closes by implication (a
paragraph before a block, a list item before the next, cells and rows of tables) and
dropping nothing but what a browser does not show: scripts, styles, templates, comments,
elements hidden by attribute or inline style. Neither the builder nor the renderer
recurses, so the depth of a page is not bounded. The renderer then lays the visible text
out: blocks on lines of their own, a blank line around paragraphs and headings, list
markers with indentation, table cells padded to the width of their column.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Generator, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript title head datalist iframe object audio video canvas".split())
RAW = frozenset("script style textarea title iframe noscript".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure article section main".split())
BLOCK = SPACED | frozenset(
    "html body div header footer nav aside address form fieldset li dt dd tr hr details summary figcaption caption thead tbody tfoot option".split()
)
#: An opening tag closes the open element of a set, up to the nearest of its limits.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "thead": ({"caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "caption"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: Elements that an end tag for something further out does not look through.
SCOPE = frozenset({"table", "td", "th", "caption"})
#: Inside svg and math, whose elements may close themselves: what is not shown there, and runs of text placed on their own.
FOREIGN = frozenset({"svg", "math"})
FOREIGN_UNSEEN = frozenset(
    "defs symbol desc metadata clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml mphantom".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|<[a-zA-Z][^>]*+>", re.S
)
#: Attributes that decide about visibility have one of these words in their name.
_DECIDES = re.compile(r"hidden|style|display|visibility", re.I)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
#: Comments, strings and arguments of a style, in which nothing is a declaration.
_ASIDE = re.compile(r"/\*.*?(?:\*/|\Z)|\"[^\"]*+\"?|'[^']*+'?|\([^()]*+\)?", re.S)
_COLSPAN = re.compile(r"(?:^|[\s\"'/])colspan\s*+=\s*+[\"']?\s*+(\d{1,4})", re.I)
#: Lists and tables that lie deeper in others than this are shown as running text.
DEEPEST = 20
#: Characters up to which a column is aligned, and up to which a cell over several columns is: longer text runs over.
WIDEST, WIDEST_SPAN = 40, 160
_GAP = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element; hidden ones show nothing, the text right in an unlit one is not shown."""

    __slots__ = ("tag", "hidden", "lit", "foreign", "span", "children")

    def __init__(self, tag: str, hidden: bool = False, lit: bool = True, foreign: bool = False, span: int = 1):
        self.tag, self.hidden, self.lit, self.foreign, self.span, self.children = tag, hidden, lit, foreign, span, []


def _visibility(attributes: str, foreign: bool) -> tuple[bool, str]:
    """Whether an element with these attributes is hidden, and its own visibility, empty if inherited."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), "".join(values))
    style: dict[str, tuple[bool, str]] = {}
    if foreign:
        style = {k: (False, found[k].strip().lower()) for k in ("display", "visibility") if k in found}
    for part in _ASIDE.sub(" ", html.unescape(found.get("style", ""))).split(";"):
        name, _, value = part.partition(":")
        name, (value, _, rest) = name.strip().lower(), value.strip().lower().partition("!")
        strong = rest.strip() == "important"
        if strong or not style.get(name, (False,))[0]:
            style[name] = strong, value.strip()
    return "hidden" in found or style.get("display", (False, ""))[1] == "none", style.get("visibility", (False, ""))[1]


def parse(page: str) -> Node:
    """The tree of a page; text children are strings with entities resolved."""
    root = Node("body")
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # of the open elements of each name, the innermost last

    def innermost(names: set[str] | frozenset[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(names: set[str], limits: set[str] | frozenset[str]) -> None:
        k = innermost(names)
        if k and k >= innermost(limits):
            for node in stack[k:]:
                places[node.tag].pop()
            del stack[k:]

    def add(text: str) -> None:
        if stack[-1].lit:
            stack[-1].children.append(html.unescape(text))

    end_of_raw: dict[str, re.Pattern] = {}
    last = page.rfind(">") + 1  # no tag ends after it; of what follows only a comment that does not end is markup
    open_comment = page.find("<!--", last)
    while m := _TOKEN.search(page, at, last):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            close({tag}, SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else frozenset({"table"} - {tag}))
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        elif tag in BLOCK:
            close({"p"}, SCOPE | {"button"})
        over = stack[-1]
        foreign = tag in FOREIGN or over.foreign and over.tag != "foreignobject"
        hidden, own = _visibility(m[3], foreign) if m[3] and _DECIDES.search(m[3]) else (False, "")
        lit = own not in ("hidden", "collapse") if own not in ("", "inherit") else over.lit
        wide = _COLSPAN.search(m[3]) if tag in ("td", "th") and m[3] else None
        node = Node(tag, hidden or tag in UNSEEN or foreign and tag in FOREIGN_UNSEEN, lit, foreign, max(1, int(wide[1])) if wide else 1)
        over.children.append(node)
        if foreign and m[3].endswith("/"):
            continue
        if tag in RAW:
            ending = end_of_raw.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I))
            stop = ending.search(page, at)
            if not node.hidden and lit:
                node.children.append(html.unescape(page[at : stop.start() if stop else len(page)]))
            at = stop.end() if stop else len(page)
        elif tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    end = open_comment if open_comment >= at and open_comment >= 0 else len(page)
    if at < end:
        add(page[at:end])
    return root


def _run(work: Generator):
    """The result of a generator that yields the generators whose results it needs, by a stack of its own."""
    stack, value = [work], None
    while stack:
        try:
            inner = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(inner)
            value = None
    return value


class _Out:
    """Lines of a block: text flows into the last one until something breaks it."""

    def __init__(self):
        self.lines, self.flow, self.blank = [], [], False

    def text(self, words: str) -> None:
        self.flow.append(words)

    def line(self, keep_empty: bool = False) -> None:
        found = _GAP.sub(" ", "".join(self.flow)).strip(" ")
        self.flow = []
        if found or keep_empty:
            self.add([found])

    def add(self, lines: list[str]) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines += lines

    def space(self) -> None:
        self.line()
        self.blank = True


def _render(node: Node, out: _Out, depth: int) -> Generator:
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
            continue
        tag = child.tag
        if child.hidden:
            continue
        if tag == "br":
            out.line(keep_empty=True)
        elif tag == "pre":
            out.space()
            out.add("".join(_plain(child)).strip("\n").split("\n"))
            out.blank = True
        elif depth >= DEEPEST and tag in ("table", "ul", "ol"):
            out.line()
            for words in _plain(child):
                out.text(f"{words} ")
            out.line()
        elif tag == "table":
            out.space()
            out.add((yield _table(child, depth)))
            out.blank = True
        elif tag in ("ul", "ol"):
            (out.line if depth else out.space)()
            number = 0
            for item in child.children:
                if isinstance(item, str) or item.hidden:
                    if isinstance(item, str) and item.strip():
                        out.text(item)
                        out.line()
                    continue
                inner = _Out()
                yield _render(item if item.tag == "li" else _wrap(item), inner, depth + 1)
                inner.line()
                number += item.tag == "li"
                mark = "" if item.tag != "li" else f"{number}. " if tag == "ol" else "- "
                if inner.lines:
                    out.add([mark + inner.lines[0], *(" " * len(mark) + x if x else x for x in inner.lines[1:])])
            if not depth:
                out.blank = True
        elif tag in BLOCK:
            spaced = tag in SPACED
            (out.space if spaced else out.line)()
            yield _render(child, out, depth)
            (out.space if spaced else out.line)()
        elif child.foreign and tag == "text":
            out.line()
            yield _render(child, out, depth)
            out.line()
        else:
            yield _render(child, out, depth)


def _wrap(node: Node) -> Node:
    holder = Node("div")
    holder.children.append(node)
    return holder


def _plain(node: Node) -> Iterator[str]:
    rest = node.children[::-1]
    while rest:
        child = rest.pop()
        if isinstance(child, str):
            yield child
        elif child.hidden:
            continue
        elif child.tag == "br":
            yield "\n"
        else:
            rest += child.children[::-1]


def _table(table: Node, depth: int) -> Generator:
    """Rows of cells, each column padded to its widest line of at most WIDEST; captions and stray text go before.

    A cell over several columns is as wide as they are and does not widen them. Cells that reach over several rows
    stand in the first of them.
    """
    before, rows = _Out(), []

    def gather(node: Node) -> Generator:
        for child in node.children:
            if isinstance(child, str):
                before.text(child)
            elif child.hidden:
                continue
            elif child.tag == "tr":
                rows.append([c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and not c.hidden])
                yield _render(_only(child, ("td", "th")), before, depth)
            elif child.tag in ("td", "th"):
                rows.append([child])
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield gather(child)
            else:
                yield _render(_wrap(child), before, depth)
                before.line()

    yield gather(table)
    before.line()
    grid = []
    for row in rows:
        cells = []
        for cell in row:
            inner = _Out()
            yield _render(cell, inner, depth + 1)
            inner.line()
            cells.append([x for x in inner.lines if x] or [""])
        grid.append(cells)
    places = [list(accumulate((c.span for c in row), initial=0))[:-1] for row in rows]
    widths: dict[int, int] = {}  # of the columns that some cell begins at
    for row, cells, at in zip(rows, grid, places, strict=True):
        for k, (cell, place) in enumerate(zip(cells, at, strict=True)):
            fits = [len(x) for x in cell if len(x) <= WIDEST] if row[k].span == 1 and k + 1 < len(cells) else []
            widths[place] = max(widths.get(place, 0), *fits, 0)
    columns = sorted(widths)
    upto = [0, *accumulate(widths[c] + 2 for c in columns)]
    lines = list(before.lines)
    for row, cells, at in zip(rows, grid, places, strict=True):
        own = []
        for cell, node, place in zip(cells, row, at, strict=True):
            a, b = bisect_left(columns, place), bisect_left(columns, place + node.span)
            own.append((cell, min(upto[b] - upto[a] - 2, WIDEST if node.span == 1 else WIDEST_SPAN)))
        for n in range(max(map(len, cells), default=0)):
            lines.append("  ".join((cell[n] if n < len(cell) else "").ljust(w) for cell, w in own).rstrip(" "))
    return lines


def _only(node: Node, but: tuple[str, ...]) -> Node:
    rest = Node("div")
    rest.children = [c for c in node.children if isinstance(c, str) or c.tag not in but]
    return rest


def page_text(page: str | None) -> str:
    """The visible text of a page as laid out; empty for null."""
    if not page:
        return ""
    out = _Out()
    _run(_render(parse(page), out, 0))
    out.line()
    return "\n".join(out.lines).strip("\n")


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the columns in keep, and text; one row per input row, no shuffle.

    A null or empty page has empty text; so has one with nothing visible. Broken markup
    is read as far as the rules go, at any depth.
    Repeated rows are rendered alike; an empty input gives no rows; other columns are
    not read.
    """
    thin = df.select(id_col, *keep, F.col(html_col).alias("_html"))
    names = [id_col, *keep, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                text = pa.array([page_text(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in thin.schema.fields[:-1]]
    return thin.mapInArrow(run, ", ".join([*kinds, "text string"]))
