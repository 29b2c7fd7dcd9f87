"""HTML extraction: a tree builder with implied tags, visibility rules, and a layout that keeps blocks, lists and table cells."""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspan.llm.common import own_names, slices, table, texts_of

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object audio video canvas svg math datalist dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption optgroup option select".split()
)
SPACED = frozenset("article blockquote dl figure form h1 h2 h3 h4 h5 h6 ol p pre section table ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A start tag first closes the nearest open tag of the first set, if none of the second stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}), "body": ({"head"}, {"body"}),
}
#: Start tags that a head may hold; any other one, and text, closes it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Where a table holds its parts only; what else stands there goes before the table.
FRAME = frozenset("table tbody thead tfoot tr colgroup".split())
#: What a part of a table stands in: all that is open above the nearest of these is closed first.
PARTS = {
    "caption": {"table"}, "colgroup": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "col": {"table", "colgroup"},
    "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"table", "tbody", "thead", "tfoot", "tr"}, "th": {"table", "tbody", "thead", "tfoot", "tr"},
}
#: Elements that may stand in a table besides its parts.
UNSEEN = frozenset("script style template".split())
#: Elements that an end tag cannot reach through.
BARRIER = {"li": {"ul", "ol", "menu", "dir"}, "p": {"td", "th", "table", "caption", "button"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}

TOKEN = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|--!>|\Z)|(?P<bogus>[!?][^>]*(?:>|\Z)|/(?![A-Za-z])[^>]*(?:>|\Z))|(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)*)(?:>|\Z))", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """``hidden`` takes the whole subtree away; ``seen`` is the visibility that a parent hands down and a style may change."""

    __slots__ = ("attrs", "children", "hidden", "name", "seen")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, seen: bool = True):
        self.name, self.attrs, self.children, self.seen = name, attrs or {}, [], seen
        a = self.attrs
        style = {k.lower(): v.lower() for k, v in STYLE.findall(a["style"])} if "style" in a else {}
        self.hidden = name in HIDDEN and not (name == "dialog" and "open" in a) or "hidden" in a or style.get("display") == "none" or name == "input" and a.get("type", "").lower() == "hidden"
        if style.get("visibility") in ("hidden", "collapse", "visible"):
            self.seen = style["visibility"] == "visible"


def attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    found: dict[str, str] = {}
    for m in ATTR.finditer(text):
        found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return found


def tree(page: str) -> Node:
    """The document's tree. Unknown end tags are dropped; open tags at the end are closed; a table's rows and cells get the parts they lack.

    A head ends at the first text or start tag that cannot stand in it. Text and elements that stand in a table or row but
    outside its cells and caption go before the table.
    """
    root = Node("#root")
    stack = [root]
    #: Places of the open elements of each name, so that no tag walks down the stack.
    spots: dict[str, list[int]] = {}
    at, n = 0, len(page)

    def highest(names: set[str] | frozenset[str]) -> int:
        return max((spots[x][-1] for x in names if spots.get(x)), default=0)

    def cut(size: int) -> None:
        while len(stack) > size:
            spots[stack.pop().name].pop()

    def pop_to(names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        i = highest(names)
        if i and i >= highest(stop):
            cut(i)

    def clear_to(names: set[str]) -> None:
        i = highest(names)
        if i:
            cut(i + 1)

    def place(x: Node | str) -> None:
        """Into the open element; if that is a table or a row, before the table."""
        if stack[-1].name in FRAME and (not x.isspace() if isinstance(x, str) else x.name not in PARTS and x.name not in UNSEEN):
            i = highest({"table"})
            if i:
                stack[i - 1].children.insert(max(0, len(stack[i - 1].children) - 1), x)
                return
        stack[-1].children.append(x)

    def push(node: Node) -> None:
        place(node)
        if node.name not in VOID:
            spots.setdefault(node.name, []).append(len(stack))
            stack.append(node)

    def add_text(text: str) -> None:
        if text:
            if stack[-1].name == "head" and not text.isspace():
                cut(len(stack) - 1)
            place(text)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add_text(entities.unescape(page[at:]))
            break
        m = TOKEN.match(page, lt)
        if not m:
            nxt = page.find("<", lt + 1)
            nxt = n if nxt < 0 else nxt
            add_text(entities.unescape(page[at:nxt]))
            at = nxt
            continue
        if lt > at:
            add_text(entities.unescape(page[at:lt]))
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if name == "br":
                push(Node("br"))
            elif name == "p" and not spots.get("p"):
                push(Node("p"))
                cut(len(stack) - 1)
            elif name[0] == "h" and name[1:] in ("1", "2", "3", "4", "5", "6"):
                pop_to({"h1", "h2", "h3", "h4", "h5", "h6"}, {"table", "td", "th"})
            else:
                pop_to({name}, BARRIER.get(name, {"table", "td", "th"} if name not in ("table", "tbody", "thead", "tfoot", "body", "html") else set()))
            continue
        attrs = attributes(m["attrs"])
        if stack[-1].name == "head" and name not in IN_HEAD:
            cut(len(stack) - 1)
        if name == "table" and stack[-1].name in FRAME:
            pop_to({"table"}, set())
        if name in CLOSES_P:
            pop_to({"p"}, {"td", "th", "table", "button", "caption"})
        if name in IMPLIED:
            pop_to(*IMPLIED[name])
        if name in PARTS:
            clear_to(PARTS[name])
        if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            push(Node("tr", None, stack[-1].seen))
        node = Node(name, attrs, stack[-1].seen)
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            stop = end.start() if end else n
            if page[at:stop]:
                raw = page[at:stop]
                node.children.append(entities.unescape(raw) if name in ("textarea", "title") else raw)
            place(node)
            close = page.find(">", stop)
            at = n if close < 0 else close + 1
        else:
            push(node)
    return root


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


class Layout:
    """Lines of text. A space is owed between words, a line break between blocks, an empty line between spaced blocks."""

    def __init__(self, depth: int = 0):
        self.depth = depth
        self.lines: list[str] = []
        self.now = ""
        self.gap = False
        self.owed = False
        self.blank = False

    def text(self, text: str) -> None:
        parts = SPACE.split(text)
        for i, p in enumerate(parts):
            if i:
                self.owed = True
            if p:
                self._word(p)

    def _word(self, word: str) -> None:
        self._begin()
        if self.owed and self.now and self.now[-1] != " ":
            self.now += " "
        self.now += word
        self.owed = False

    def _begin(self) -> None:
        if self.blank and self.lines and not self.now:
            self.lines.append("")
        self.blank = False

    def raw(self, text: str) -> None:
        for i, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self._begin()
                self.lines.append(self.now)
                self.now = ""
            if line:
                self._begin()
                self.now += line
        self.owed = False

    def line(self) -> None:
        if self.now.strip():
            self.lines.append(self.now.rstrip())
        self.now, self.owed = "", False

    def space(self) -> None:
        self.line()
        self.blank = True

    def take(self) -> list[str]:
        self.line()
        return self.lines


def render(page: str) -> str:
    """All visible text of a page.

    Blocks stand on lines of their own, paragraphs, headings, lists and tables
    with an empty line around them; ``br`` breaks a line and ``hr`` is a rule;
    list items begin with a bullet or their number and are indented by depth;
    a table's cells are aligned in columns two spaces apart; ``pre`` keeps its
    white space. Hidden is what a browser without scripts would not paint: what
    is in the head, in scripts, styles, templates and embedded media, what
    ``hidden`` and display:none take away, what visibility:hidden hides until a
    visibility:visible inside it, a closed ``dialog``, and a closed ``details``
    but for its summary. ``aria-hidden`` speaks to readers aloud only and hides
    nothing.
    """
    out = Layout()
    _children(tree(page), out, False)
    return "\n".join(out.take()).strip("\n")


#: Lists and tables nested deeper than this are laid out as plain blocks: every line would else begin with its depth in spaces.
DEEP = 40


def _nested(node: Node, out: Layout) -> list[str]:
    inner = Layout(out.depth + 1)
    _children(node, inner, False)
    lines = inner.take()
    while lines and not lines[0]:
        lines.pop(0)
    return lines


def _children(top: Node, out: Layout, pre: bool) -> None:
    """Lays out what is in a node, with a stack of its own so that deep pages need no deep recursion; only lists and tables nest calls."""
    todo: list[tuple[object, bool, bool, bool]] = [(c, pre, False, top.seen) for c in reversed(top.children)]
    deep = out.depth >= DEEP
    while todo:
        x, pre, leave, seen = todo.pop()
        if isinstance(x, str):
            if seen:
                out.raw(x) if pre else out.text(x)
            continue
        name = x.name
        if leave:
            out.space() if name in SPACED else out.line()
            continue
        if x.hidden:
            continue
        if name == "br":
            out._begin()
            out.lines.append(out.now.rstrip())
            out.now, out.owed = "", False
        elif name == "hr":
            out.space()
            if x.seen:
                out._word("---")
            out.space()
        elif name == "img":
            if x.seen and x.attrs.get("alt", "").strip():
                out.text(x.attrs["alt"])
        elif name == "input":
            if x.seen and x.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text") and x.attrs.get("value", "").strip():
                out.text(x.attrs["value"])
        elif name in ("ul", "ol", "menu", "dir") and not deep:
            out.space()
            _list(x, out)
            out.space()
        elif name == "table" and not deep:
            out.space()
            _table(x, out)
            out.space()
        elif name == "details" and "open" not in x.attrs:
            out.line()
            todo.append((x, pre, True, x.seen))
            todo += [(c, pre, False, x.seen) for c in x.children if isinstance(c, Node) and c.name == "summary"][:1]
        elif name in BLOCK:
            out.space() if name in SPACED else out.line()
            todo.append((x, pre, True, x.seen))
            todo += [(c, pre or name == "pre", False, x.seen) for c in reversed(x.children)]
        else:
            if name in ("td", "th"):
                out.owed = True
            todo += [(c, pre, False, x.seen) for c in reversed(x.children)]


def _list(node: Node, out: Layout) -> None:
    ordered = node.name == "ol"
    start = node.attrs.get("start", "1")
    number = int(start) if ordered and re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str):
            if node.seen and not child.isspace():
                out.text(child)
                out.line()
            continue
        if child.hidden:
            continue
        if child.name != "li":
            for text in _nested(_wrap(child), out):
                out.line()
                out._begin()
                out.lines.append(text)
            continue
        value = child.attrs.get("value", "")
        if ordered and re.fullmatch(r"-?[0-9]{1,9}", value):
            number = int(value)
        mark = f"{number}. " if ordered else "* "
        number += 1
        lines = [x for x in _nested(child, out) if x]
        for i, text in enumerate(lines or [""]):
            out.line()
            out._begin()
            out.lines.append(((mark if not i else " " * len(mark)) + text).rstrip())


def _wrap(node: Node) -> Node:
    w = Node("#wrap")
    w.children.append(node)
    return w


def _span(cell: Node, name: str, most: int) -> int:
    """The standard's limits: 1,000 columns, 65,534 rows; 0 rows are all that follow."""
    value = cell.attrs.get(name, "1").strip()
    if not re.fullmatch("[0-9]{1,9}", value):
        return 1
    return most if name == "rowspan" and int(value) == 0 else max(1, min(most, int(value)))


#: Fixed values of the layout of tables.
WIDER, ROOM = 8, 20_000


def _table(node: Node, out: Layout) -> None:
    rows: list[list[Node]] = []
    todo: list = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x.hidden:
            continue
        if x.name == "caption":
            for line in _nested(x, out):
                out.line()
                out._begin()
                out.lines.append(line)
        elif x.name == "tr":
            rows.append([c for c in x.children if isinstance(c, Node) and not c.hidden])
        else:
            todo += reversed(x.children)
    grid: list[dict[int, list[str]]] = []
    taken: list[tuple[int, int, int]] = []  # first column, column behind the last, row behind the last, of cells over several rows
    for r, cells in enumerate(rows):
        taken = sorted(t for t in taken if t[2] > r)
        line: dict[int, list[str]] = {}
        more, c, k = [], 0, 0
        for cell in cells:
            while k < len(taken) and taken[k][0] <= c:
                c, k = max(c, taken[k][1]), k + 1
            wide, tall = _span(cell, "colspan", 1000), _span(cell, "rowspan", 65534)
            line[c] = [x for x in _nested(cell, out) if x]
            if tall > 1:
                more.append((c, c + wide, r + tall))
            c += wide
        taken += more
        grid.append(line)
    columns = sorted({c for g in grid for c in g})
    widths: dict[int, int] = {}
    for g in grid:
        for c, texts in g.items():
            widths[c] = max([widths.get(c, 0), *map(width, texts)])
    shown = [c for c in columns if widths[c]]
    aligned = _worth_aligning(grid, shown, widths)
    for g in grid:
        for i in range(max((len(x) for x in g.values()), default=0)):
            last = max((c for c, x in g.items() if len(x) > i), default=-1)
            if aligned:
                parts = [(g[c][i] if c in g and len(g[c]) > i else "", widths[c]) for c in shown if c <= last]
            else:
                parts = [(x[i], 0) for _, x in sorted(g.items()) if len(x) > i]
            text = "  ".join(p + " " * (w - width(p)) for p, w in parts).rstrip()
            if text:
                out.line()
                out._begin()
                out.lines.append(text)


def _worth_aligning(grid: list[dict[int, list[str]]], shown: list[int], widths: dict[int, int]) -> bool:
    """Layout rule: a table's columns are aligned while that makes no more than WIDER times the characters of its cells, and ROOM
    besides. Else, as with one very long cell beside many short ones, the cells of a row follow each other with the usual gap.
    No text is lost either way."""
    upto, total = {}, 0
    for c in shown:
        total += widths[c] + 2
        upto[c] = total
    filled = written = 0
    for g in grid:
        lines = max((len(x) for x in g.values()), default=0)
        written += sum(len(t) for x in g.values() for t in x)
        filled += lines * max((upto.get(c, 0) for c, x in g.items() if x), default=0)
    return filled <= WIDER * written + ROOM


def rendered(pages: DataFrame, columns: list[str], html: str = "html") -> DataFrame:
    """``columns`` of ``pages`` (``html`` among them) with the visible text as ``visible``.

    A null or empty page gives the empty text. Long pages are read whole, in
    time linear in their tags; repeated rows come as often as they are there;
    an empty table gives no rows. Columns that are not asked for are ignored;
    one that is asked for and is called ``visible`` raises a ValueError.
    """
    own_names(columns, "visible")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([render(x) for x in texts_of(part, html)], pa.string())], [*part.schema.names, "visible"])

    some = pages.select(*columns)
    return some.mapInArrow(run, T.StructType([*some.schema.fields, T.StructField("visible", T.StringType())]))


def op4_layout_text(spark, sf_dir: str) -> DataFrame:
    out = rendered(table(spark, sf_dir, "pages"), ["page_id", "html"])
    lines = F.split("visible", "\n")
    return out.select("page_id", F.col("visible").alias("text"), F.length("visible").cast("long").alias("n_chars"), F.when(F.col("visible") == "", 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.sha2("visible", 256).alias("text_sha256"))
