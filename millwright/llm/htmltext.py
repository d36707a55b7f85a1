"""Visible text of HTML pages, laid out as a browser would: blocks, lists and aligned tables.

A small tree builder applies the implied tags (a paragraph ends where a block starts, an item where the
next one starts, a cell where the next cell or row starts), visibility rules drop what is not shown, and a
renderer keeps the spacing of blocks, the marks and depth of lists and the columns of tables. All visible
text is emitted: no block is judged or dropped. Attributes are read by a state machine, searches go forward only and open elements
are found by their names, so long and hostile markup takes time in proportion to its length; only a table in which many cells
reach over very different numbers of rows takes more. `visibility` is inherited, so a visible element within a
hidden one is shown; `display: none` and the `hidden` attribute hide all that is within. Values of text fields and the text
of svg and math are shown; an element of theirs that closes itself is closed.

Cases: null or empty markup gives an empty text; broken markup is read as far as it goes (an open comment
or script hides the rest, as in browsers); elements may be nested to any depth, but lists, quotations and tables within LEVELS
others are neither indented nor aligned; a cell wider than WIDEST is shown whole and its column is
aligned by the others, and padding within a row ends at 4 * WIDEST; repeated rows are rendered alike; an empty table gives an empty result; the input's other
columns are kept unless they bear the output's name.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterable, Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS, WIDEST = 60, 100
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_GAP, _KEY, _BARE = re.compile(r"[\s/]*"), re.compile(r"[^\s/>][^\s/>=]*"), re.compile(r"[^\s>]*")
_EQUALS = re.compile(r"\s*=\s*")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER_SHOWN = frozenset("head title script style template noscript iframe noembed noframes datalist audio video canvas object rp".split())
#: Elements of svg and math whose text is not drawn where it stands, and tags that end an open svg or math.
NEVER_DRAWN = frozenset("defs symbol desc metadata clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split())
FOREIGN, HTML_WITHIN = ("svg", "math"), ("foreignobject", "annotation-xml")
NOT_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Fields whose value is not shown as text.
NO_TEXT = frozenset("hidden checkbox radio file password range color image".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
#: Blocks with an empty line before and after them.
APART = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
CLOSES_P = BLOCK - frozenset("dd dt li html body legend optgroup option summary".split()) | frozenset(["summary"])
CELLS = frozenset("caption tr td th thead tbody tfoot colgroup col".split())
#: A start tag of the key ends the open elements in the first set, looking up to one in the second.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
IMPLIED_END["thead"] = IMPLIED_END["tfoot"] = IMPLIED_END["tbody"]
#: An end tag does not reach beyond these, but for its own kind.
_P = frozenset(["p"])
SCOPE = frozenset("table td th caption html body button template".split())


class Node:
    """An element. shown: whether its own text is visible; None as that of its parent. hidden: neither it nor what is in it is shown."""

    __slots__ = ("tag", "hidden", "shown", "start", "span", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.children, self.start, self.span = tag, [], 1, (1, 1)
        self.hidden, self.shown = tag in NEVER_SHOWN, None
        if attrs and not self.hidden:
            found = {k: unescape(v) for k, v in attrs.items()}
            style = found.get("style", "")
            said: dict[str, tuple[bool, str]] = {}
            for name, value, important in _STYLE.findall(style):  # the last one holds, or the last important one
                name = name.lower()
                if important or not said.get(name, (False,))[0]:
                    said[name] = bool(important), value.lower()
            self.hidden = said["display"][1] == "none" if "display" in said else "hidden" in found
            if (seen := said.get("visibility", (False, ""))[1]) in ("visible", "hidden", "collapse"):
                self.shown = seen == "visible"
            if found.get("start", "").lstrip("-").isdecimal():
                self.start = int(found["start"][:9])
            if tag in ("td", "th"):
                across, down = (int(x[:6]) if (x := found.get(n, "").strip()).isdecimal() else 1 for n in ("colspan", "rowspan"))
                self.span = min(max(across, 1), 1000), min(down, 65534) or 65534
            if tag in ("details", "dialog") and "open" in found:
                self.tag = "div"
            if tag == "input" and not self.hidden and found.get("type", "").strip().lower() not in NO_TEXT:
                self.children.append(found.get("value", ""))


class _Reader:
    """Tags of a page, in one pass: a search that fails is not made again, so that no markup takes quadratic time."""

    def __init__(self, markup: str):
        self.markup, self.absent = markup, set()

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        found = self.markup.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def skip(self, what: str, at: int) -> int:
        """The place behind what, or the end of the page."""
        found = self.find(what, at)
        return len(self.markup) if found < 0 else found + len(what)

    def attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        """Attributes from a place in a tag on, the place behind the tag, and whether it ends with a slash. A quote that is never closed goes on to the tag's end only."""
        found: dict[str, str] = {}
        while True:
            gap = _GAP.match(self.markup, at)
            at = gap.end()
            if at >= len(self.markup):
                return found, at, False
            if self.markup[at] == ">":
                return found, at + 1, gap[0].endswith("/")
            key = _KEY.match(self.markup, at)
            name, at = key[0].lower(), key.end()
            value, equals = "", _EQUALS.match(self.markup, at)
            if equals:
                at = equals.end()
                quote = self.markup[at : at + 1]
                if quote in ('"', "'") and (close := self.find(quote, at + 1)) >= 0:
                    value, at = self.markup[at + 1 : close], close + 1
                else:
                    bare = _BARE.match(self.markup, at)
                    value, at = bare[0], bare.end()
            found.setdefault(name, value)


def parse(markup: str) -> Node:
    """The tree of elements and text pieces."""
    root = Node("html")
    stack, names, at, size = [root], ["html"], 0, len(markup)
    places: dict[str, list[int]] = {"html": [0]}  # where elements of each name are in the stack

    def top(tags: Iterable[str]) -> int:
        """The place of the last open element of tags, or -1."""
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close(first: int) -> None:
        """Close the open elements from a place on; the root stays."""
        while len(stack) > max(first, 1):
            stack.pop()
            places[names.pop()].pop()

    def end(tags: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        """Close the outermost of the last open elements of tags, if it is not beyond one of until."""
        found = top(tags)
        if found < 1 or top(until - tags) > found:
            return
        while found > 1 and names[found - 1] in tags:
            found -= 1
        close(found)

    def foreign() -> bool:
        return bool(places.get("svg") or places.get("math")) and top(FOREIGN) > top(HTML_WITHIN)

    reader, text_from = _Reader(markup), 0

    def text(until: int) -> None:
        if until > text_from:
            piece = markup[text_from:until]
            if names[-1] == "head" and not piece.isspace():
                close(len(stack) - 1)
            stack[-1].children.append(unescape(piece))

    while True:
        at = reader.find("<", at)
        if at < 0:
            text(size)
            break
        name = _NAME.match(markup, at + 1)
        if not name:
            if markup[at + 1 : at + 2] in ("!", "?", "/"):
                text(at)
                at = reader.skip("-->", at + 2) if markup.startswith("<!--", at) else reader.skip(">", at)
                text_from = at
            else:  # a plain character
                at += 1
            continue
        text(at)
        attrs, at, ended = reader.attributes(name.end())
        text_from = at
        closing, tag = name[0].startswith("/"), name[0].lstrip("/").lower()
        if closing:
            if tag in ("html", "body"):
                continue
            found = top([tag])
            if tag == "br" or tag == "p" and found < 0:
                stack[-1].children.append(Node(tag))
            elif found > 0 and (found == len(stack) - 1 or tag in SCOPE or tag in ("tr", "tbody", "thead", "tfoot") or top(SCOPE) < found):
                close(found)
            continue
        if tag == "html":
            continue
        while tag in NOT_FOREIGN and foreign():
            close(top(FOREIGN))
        within = tag in FOREIGN or foreign()
        if tag in CLOSES_P:
            end(_P, SCOPE)
        if tag in IMPLIED_END:
            end(*IMPLIED_END[tag])
        if tag == "body" or names[-1] == "head" and tag not in RAW | VOID | {"noscript", "template"}:
            end({"head"}, {"html"})
        node = Node(tag, attrs)
        if within and tag in NEVER_DRAWN:
            node.hidden = True
        elif within and tag == "text":
            node.tag = "div"  # each text of a drawing has its own place
        stack[-1].children.append(node)
        if within and ended:
            continue
        if tag in RAW and not within:
            finish = None if tag in reader.absent else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(markup, at)
            if not finish:
                reader.absent.add(tag)
            content = markup[at : finish.start() if finish else size]
            node.children.append(unescape(content) if tag in ("textarea", "title") else content)
            at = reader.skip(">", finish.end()) if finish else size
            text_from = at
        elif tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
            names.append(tag)
    return root


class _Lines:
    """Lines of a block under construction; white space collapses unless it is preformatted."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []  # pieces
        self.gap, self.space = 0, False

    def text(self, piece: str, pre: bool) -> None:
        if pre:
            first, *rest = piece.replace("\r\n", "\n").split("\n")
            self._add(first)
            for x in rest:
                self.newline()
                self._add(x)
            return
        words = _SPACE.sub(" ", piece)
        if words[:1] == " ":
            self.space, words = True, words[1:]
        if words:
            body = words.rstrip(" ")
            if body:
                self._add((" " if self.space and self.line else "") + body)
            self.space = len(body) < len(words) or (self.space and not body)

    def _add(self, x: str) -> None:
        if x and self.gap:
            if self.done:
                self.done.extend([""] * (self.gap - 1))
            self.gap = 0
        if x:
            self.line.append(x)

    def _end(self) -> None:
        self.done.append("".join(self.line))
        self.line = []

    def newline(self) -> None:
        if not self.gap or self.line:
            self._end()
        self.space = False

    def block(self, apart: bool) -> None:
        """End the line; the next text starts on a new one, after an empty line if apart."""
        if self.line:
            self._end()
        self.space = False
        self.gap = max(self.gap, 2 if apart else 1)

    def lines(self) -> list[str]:
        self.block(False)
        while self.done and not self.done[-1].strip():
            self.done.pop()
        return self.done

    def embed(self, lines: list[str], apart: bool) -> None:
        self.block(apart)
        for x in lines:
            if x or not self.gap:
                self._add(x)
            self._end()
        self.block(apart)


#: A step of rendering: it yields the steps that it needs and gets what they return, so pages of any depth need no deep calls.
_Step = Generator["_Step", object, object]


def _finish(step: _Step) -> object:
    waiting, value = [step], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as last:
            waiting.pop()
            value = last.value
    return value


def _render(node: Node, out: _Lines, pre: bool = False, shown: bool = True, level: int = 0) -> _Step:
    number, shown = node.start, shown if node.shown is None else node.shown
    deep = level >= LEVELS
    for child in node.children:
        if isinstance(child, str):
            if shown:
                out.text(child, pre)
            continue
        if child.hidden:
            continue
        tag = child.tag
        seen = shown if child.shown is None else child.shown
        if tag == "br":
            out.newline()
        elif tag == "table" and not deep:
            out.embed((yield _table(child, shown, level + 1)), True)
        elif tag == "li" and not deep:
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            inner = yield _inner(child, pre, shown, level + 1)
            if not inner and not seen:
                continue
            out.embed([(mark if i == 0 else " " * len(mark) if x else "") + x for i, x in enumerate(inner)], False)
        elif tag in ("blockquote", "dd") and not deep:
            inner = yield _inner(child, pre, shown, level + 1)
            out.embed([("  " + x) if x else "" for x in inner], tag in APART)
        elif tag == "details":
            for x in child.children:
                if isinstance(x, Node) and x.tag == "summary" and not x.hidden:
                    out.block(False)
                    yield _render(x, out, pre, seen, level)
                    out.block(False)
        elif tag == "dialog":
            continue
        elif tag in BLOCK or deep and tag in CELLS:
            nested = tag in ("ul", "ol") and node.tag == "li"
            apart = tag in APART and not nested
            out.block(apart)
            yield _render(child, out, pre or tag == "pre", shown, level)
            out.block(apart)
        else:
            yield _render(child, out, pre or tag in ("textarea", "xmp"), shown, level)


def _inner(node: Node, pre: bool = False, shown: bool = True, level: int = 0) -> _Step:
    out = _Lines()
    yield _render(node, out, pre, shown, level)
    return out.lines()


def _cells(table: Node, shown: bool) -> tuple[list[tuple[Node, bool]], list[tuple[int, list[Node], bool]]]:
    """What stands before a table (nodes, and whether they are visible), and its rows: section, cells, whether they are visible."""
    head: list[tuple[Node, bool]] = []
    rows: list[tuple[int, list[Node], bool]] = []
    section, waiting = 0, [(table, shown)]
    while waiting:
        node, shown = waiting.pop()
        shown = shown if node.shown is None else node.shown
        section += 1  # cells reach no further than their section
        loose = Node("div")
        for k, child in enumerate(node.children):
            if isinstance(child, str) or child.tag not in CELLS:
                loose.children.append(child)
            elif child.hidden:
                continue
            elif child.tag == "caption":
                head.append((child, shown))
            elif child.tag == "tr":
                visible = shown if child.shown is None else child.shown
                rest = Node("div")
                rest.children = [c for c in child.children if isinstance(c, str) or c.tag not in ("td", "th")]
                head.append((rest, visible))  # text that is not in a cell stands before the table
                rows.append((section, [c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and not c.hidden], visible))
            elif child.tag in ("td", "th"):
                rows.append((section, [child], shown))
            else:
                after = Node(node.tag)
                after.children = node.children[k + 1 :]
                if after.children:
                    waiting.append((after, shown))
                waiting.append((child, shown))
                break
        head.append((loose, shown))
    return head, rows


def _table(table: Node, shown: bool = True, level: int = 0) -> _Step:
    """Rows of cells in aligned columns; a cell of several lines takes as many lines of its row, and cells may span columns and rows."""
    lines: list[str] = []
    before, found = _cells(table, shown)
    for node, visible in before:
        lines.extend((yield _inner(node, False, visible, level)))
    bottom = {section: k + 1 for k, (section, _, _) in enumerate(found)}
    rows: list[list[tuple[int, int, list[str]]]] = []  # first column, column behind the last, lines
    over: list[tuple[int, int, int]] = []  # columns of cells of earlier rows, and the row where they end
    for k, (section, cells, visible) in enumerate(found):
        column, at, out, new = 0, 0, [], []

        def pass_over() -> None:
            """Go on behind the cells of earlier rows; neighbours are one empty stretch."""
            nonlocal column, at
            while at < len(over) and over[at][0] <= column:
                first, column = over[at][0], max(column, over[at][1])
                if out and not out[-1][2] and out[-1][3] and out[-1][1] == first:
                    out[-1] = (out[-1][0], column, [], True)
                else:
                    out.append((first, column, [], True))
                at += 1

        for cell in cells:
            pass_over()
            across, down = cell.span
            out.append((column, column + across, (yield _inner(cell, False, visible, level)), False))
            last = min(k + down, bottom[section])
            if last > k + 1:
                new.append((column, column + across, last))
            column += across
        rows.append([x[:3] for x in out])
        kept: list[tuple[int, int, int]] = []
        for x in sorted([*[x for x in over if x[2] > k + 1], *new]):
            if kept and kept[-1][1] == x[0] and kept[-1][2] == x[2]:
                kept[-1] = (kept[-1][0], *x[1:])
            else:
                kept.append(x)
        over = kept
    edges = sorted({e for cells in rows for a, b, _ in cells for e in (a, b)})  # columns that no cell starts or ends at count as one
    number = {e: k for k, e in enumerate(edges)}
    widths = [0] * len(edges)
    placed = [[(number[a], number[b], cell, max((len(x) for x in cell if len(x) <= WIDEST), default=0)) for a, b, cell in cells] for cells in rows]
    for cells in placed:
        for a, b, _, width in cells:
            if b == a + 1:
                widths[a] = max(widths[a], width)
    starts = [0, *accumulate(widths)]
    wider = [0] * len(edges)
    for cells in placed:
        for a, b, _, width in cells:
            if b > a + 1:
                wider[b - 1] = max(wider[b - 1], width - (starts[b] - starts[a]) - 3 * (b - a - 1))
    starts = [0, *accumulate(w + x for w, x in zip(widths, wider, strict=True))]
    for cells in placed:
        for k in range(max((len(c[2]) for c in cells), default=0)):
            parts, room = [], 4 * WIDEST
            for a, b, c, _ in cells:
                x = c[k] if k < len(c) else ""
                blank = max(0, min(starts[b] - starts[a] + 3 * (b - a - 1) - len(x), room))
                room -= blank
                parts.append(x + " " * blank)
            lines.append(" | ".join(parts).rstrip())
    return lines


def page_text(markup: str | None) -> str:
    return "\n".join(_finish(_inner(parse(markup)))) if markup else ""


def extract_text(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """df with the column out_col instead of html_col."""
    kept = [f for f in df.schema if f.name not in (html_col, out_col)]
    df = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(html_col).alias(out_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = pa.array([page_text(x) for x in part.column(len(kept)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], part.schema.names)

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out_col, T.StringType())]))


def op5_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op5_htmltext": op5_htmltext}
ORACLE_SQL: dict[str, str] = {}
