"""HTML extraction by layout-aware rendering.

A tokeniser and a tree builder with implied tags (an open p ends before a block; li, dt, dd, tr, td, th, option and
table sections end before their like; an end tag closes what stands open inside it, but nothing beyond the cell or table
that it stands in; what can't stand in a head ends it) make a tree; visibility rules drop what a browser does not show
(head, scripts, styles, templates, embedded media, hidden inputs, the hidden attribute, display:none, closed dialogs,
closed details but for their summary, definitions and annotations in svg and math; visibility:hidden is inherited and
taken back by visibility:visible); a renderer then emits all visible text: blocks on lines of their own, a blank line
around paragraphs, headings, lists and tables, bullets and numbers with nesting, table cells in aligned columns, white
space collapsed except in pre.

Neither building nor rendering recurses. The table operator, `extract`, limits nothing (`EXACT`): every level is indented
and every table aligned, however deep or wide a page is, whatever that adds to the text's size. For single pages there are
`Limits` as well that keep time and text in proportion to the page: they say where indentation stops, from which width on
tables are not padded, and within how many others a table gives a line a row; no text is lost by that.

Defined results: null and empty pages give the empty text; broken markup never fails, what is no tag is text; a tag that
the page's end cuts off is dropped; repeated
rows and null page_ids are rendered row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, text_slices, texts_of



@dataclass(frozen=True)
class Limits:
    """Columns of indentation, columns of text that a table is aligned over, tables within tables."""

    indent: float = 80
    widest: float = 400
    grids: float = 8


LIMITS, EXACT = Limits(), Limits(float("inf"), float("inf"), float("inf"))
#: The largest spans that the HTML standard knows.
COLSPAN, ROWSPAN = 1000, 65534
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title noscript".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes datalist object audio video canvas".split())
#: Children of svg and math that are not rendered, and the elements in them that hold HTML again.
FOREIGN_UNSEEN = frozenset("annotation annotation-xml clippath defs desc filter lineargradient marker mask metadata pattern radialgradient symbol".split())
HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header html legend li main menu nav optgroup option search section summary tbody td tfoot th thead tr".split())
TABLE_PARTS = frozenset("caption colgroup table tbody td tfoot th thead tr".split())
ROW_GROUPS = frozenset("tbody tfoot thead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: What an end tag does not look beyond, apart from those of a table's parts, and what a list's parts do not.
SCOPE = frozenset("caption object table td th".split())
LISTS = frozenset("dir menu ol ul".split())
_SCOPES = {"li": SCOPE | LISTS, "dd": SCOPE | {"dl"}, "dt": SCOPE | {"dl"}}
SHOWN_INPUTS = frozenset("button date email month number range reset search submit tel text time url week".split())
#: What a start tag ends first, and the elements beyond which it does not look.
ENDS_OPEN = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Comments and declarations, tags with whole quotes, else tags up to the next angle bracket; never backtracks.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>",
    re.S,
)
#: Where a tag or comment begins that nothing ends.
_CUT_OFF = re.compile(r"<(?=/?[a-zA-Z]|[!?])")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    children: list[Element | str] = field(default_factory=list)
    foreign: bool = False

    @property
    def hidden(self) -> bool:
        """Whether the element and all in it are not rendered."""
        a = self.attributes
        if self.tag in UNSEEN or self.foreign and self.tag in FOREIGN_UNSEEN or self.tag == "dialog" and "open" not in a:
            return True
        return bool(a) and ("hidden" in a or self.tag == "input" and a.get("type", "").lower() == "hidden" or self.style("display") == "none")

    def style(self, name: str) -> str | None:
        """The last value that the element's own style gives a property."""
        found = [v.lower() for k, v in _STYLE.findall(self.attributes["style"]) if k.lower() == name] if "style" in self.attributes else []
        return found[-1] if found else None

    def shows(self, visible: bool) -> bool:
        """Whether text right in the element is visible, given that it is around it."""
        own = self.style("visibility")
        return visible if own not in ("visible", "hidden", "collapse") else own == "visible"


def inside(element: Element) -> bool:
    """Whether children of the element are svg's or math's own."""
    return element.foreign and element.tag not in HTML_INSIDE


class _Open:
    """The open elements, and where each tag stands among them."""

    def __init__(self, root: Element) -> None:
        self.stack = [root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, element: Element) -> None:
        self.places[element.tag].append(len(self.stack))
        if element.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def close(self, at: int) -> None:
        """End the element at a place and all in it."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tags) -> int:
        """Where the innermost of the tags stands; 0 if none is open."""
        found = 0
        for t in tags:
            own = self.places.get(t)
            if own and own[-1] > found:
                found = own[-1]
        return found

    def end(self, tags, barrier) -> None:
        """End the innermost of the tags, and those it stands in, up to the barrier."""
        at = self.last(tags)
        if at:
            stop = self.last(barrier)
            while at > stop:
                self.close(at)
                at = self.last(tags)


def parse(source: str) -> tuple[Element, str | None]:
    """The tree of a page, and the text of its first title."""
    root, title = Element("#root", {}), None
    open_ = _Open(root)
    stack = open_.stack
    at = 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if not m and (cut := _CUT_OFF.search(text)):
            text = text[: cut.start()]
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                open_.close(open_.last(("head",)))
            stack[-1].children.append(_html.unescape(text))
        if not m:
            break
        at = m.end()
        close, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if m[0].startswith("<![CDATA["):
                if inside(stack[-1]):
                    stack[-1].children.append(m[0][9:].removesuffix("]]>"))
                else:  # in HTML it is a comment
                    at = source.find(">", m.start()) + 1 or len(source)
            continue
        tag = name.lower()
        if close:
            _end_tag(tag, open_)
            continue
        attributes = {k.lower(): _html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}
        if tag in BLOCK:  # HTML blocks end svg and math
            while inside(stack[-1]):
                open_.close(len(stack) - 1)
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            open_.close(open_.last(("head",)))
        if tag in ("html", "body") and open_.places.get(tag):
            continue
        if tag in ENDS_OPEN:
            open_.end(*ENDS_OPEN[tag])
        elif tag in BLOCK and tag not in ("html", "body"):
            open_.end(("p",), ("table", "td", "th", "caption", "button", "object"))
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                open_.close(len(stack) - 1)
        if tag == "tr" and stack[-1].tag == "table" or tag in ("td", "th") and (stack[-1].tag == "table" or stack[-1].tag in ROW_GROUPS):
            for implied in ("tbody", "tr"):
                if implied == "tbody" and stack[-1].tag == "table" or implied == "tr" and tag != "tr":
                    child = Element(implied, {})
                    stack[-1].children.append(child)
                    open_.push(child)
        child = Element(tag, attributes, foreign=tag in ("svg", "math") or inside(stack[-1]))
        stack[-1].children.append(child)
        if child.foreign and raw.endswith("/"):
            continue
        if tag in RAW:
            finish = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            text = source[at : finish.start() if finish else len(source)]
            child.children.append(_html.unescape(text) if tag in ("textarea", "title") else text)
            at = (source.find(">", finish.start()) + 1 or len(source)) if finish else len(source)
            if tag == "title" and title is None and not child.foreign:
                title = child.children[0]
        elif tag not in VOID:
            open_.push(child)
    return root, title


def _end_tag(tag: str, open_: _Open) -> None:
    stack = open_.stack
    if tag == "br":
        stack[-1].children.append(Element("br", {}))
    elif tag in ("body", "html"):
        return  # what follows still belongs to the page
    elif tag in TABLE_PARTS:
        if (at := open_.last((tag,))) and (tag == "table" or at > open_.last(("table",))):
            open_.close(at)
    elif tag == "p" and open_.last(("p",)) <= open_.last((*SCOPE, "button")):
        stack[-1].children.append(Element("p", {}))
    elif tag in BLOCK or tag == "head":
        at = open_.last(HEADINGS if tag in HEADINGS else (tag,))
        if at and at > open_.last(_SCOPES.get(tag, SCOPE)):
            open_.close(at)
    elif (at := open_.last((tag,))) > (open_.blocks[-1] if open_.blocks else 0):  # no end of what a block stands in
        open_.close(at)


def width(text: str) -> int:
    """Columns that the text takes in a fixed-width font."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Prefix:
    """What lines of a level begin with: the prefix around and its own text, put together only where a line is written."""

    __slots__ = ("around", "own", "size", "core", "text")

    def __init__(self, around: _Prefix | None, own: str) -> None:
        self.around, self.own, self.text = around, own, None if around else own
        core, before = len(own.rstrip(" ")), around.size if around else 0
        self.size = before + len(own)
        #: The length without blanks at the end.
        self.core = before + core if core or not around else around.core

    def __str__(self) -> str:
        if self.text is None:
            parts, at = [], self.around
            while at.text is None:
                parts.append(at.own)
                at = at.around
            if parts:  # levels within and lines after this one begin with it as well
                self.around.text = at.text + "".join(reversed(parts))
            self.text = self.around.text + self.own
        return self.text


_NO_PREFIX = _Prefix(None, "")


class _Writer:
    """Lines with collapsed white space; breaks are remembered until text follows, marks until a line does."""

    def __init__(self, grids: int = 0, limits: Limits = LIMITS) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        #: What the next line and those after it begin with, what the blank line due before it holds, levels open.
        self.first: _Prefix | None = None
        self.rest = _NO_PREFIX
        self.gap: _Prefix | None = None
        self.levels: list[tuple[_Prefix | None, _Prefix, _Prefix | None, int]] = []
        self.grids, self.limits = grids, limits

    def text(self, s: str) -> None:
        if not s:
            return
        parts = _SPACE.sub(" ", s)
        if parts == " ":
            self.space = bool(self.now)
            return
        if self.now and (self.space or parts[0] == " "):
            self.now.append(" ")
        self.now.append(parts.strip(" "))
        self.space = parts[-1] == " "

    def line(self) -> None:
        if self.now:
            self._out("".join(self.now))
            self.now = []
        self.space = False

    def _out(self, s: str) -> None:
        if self.lines and self.gap is not None:
            self.lines.append(str(self.gap)[: self.gap.core] if self.gap.core else "")
        self.gap = None
        self.lines.append((str(self.rest if self.first is None else self.first) + s).rstrip(" "))
        self.first = None

    def blank(self) -> None:
        self.line()
        if len(self.lines) > (self.levels[-1][3] if self.levels else 0):  # not before a level's first line
            if self.gap is None or self.gap.core > self.rest.size:
                self.gap = self.rest

    def verbatim(self, lines: list[str]) -> None:
        self.line()
        for s in lines:
            self._out(s)

    def ready(self, lines: list[str]) -> None:
        """Lines without blanks at their end, at once where nothing goes before them."""
        self.verbatim(lines[:1])
        if self.rest.size:
            self.verbatim(lines[1:])
        else:
            self.lines += lines[1:]

    def push(self, first: str, rest: str) -> None:
        """A level whose first line begins with a mark and the others with rest, behind what the levels around give."""
        self.line()
        self.levels.append((self.first, self.rest, self.gap, len(self.lines)))
        deep = self.rest.size >= self.limits.indent
        before = self.rest if self.first is None else self.first
        self.first = _Prefix(_Prefix(None, str(before)[: int(2 * self.limits.indent)]) if deep else before, first)
        self.rest = self.rest if deep else _Prefix(self.rest, rest)

    def pop(self) -> None:
        self.line()
        first, self.rest, gap, lines = self.levels.pop()
        wrote = len(self.lines) > lines
        self.first, self.gap = (None, None) if wrote else (first, gap)

    def done(self) -> list[str]:
        self.line()
        return self.lines


#: A step of rendering: yields the steps it needs done first and is sent their results, so that nothing recurses.
Step = Generator["Step", list[str] | None, list[str] | None]


def _work(step: Step) -> list[str] | None:
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


def _plain(element: Element, visible: bool) -> str:
    """All visible text of a preformatted element as it stands."""
    out: list[str] = []
    todo: list[tuple[Element | str, bool]] = [(c, visible) for c in reversed(element.children)]
    while todo:
        c, seen = todo.pop()
        if isinstance(c, str):
            if seen:
                out.append(c)
        elif c.tag == "br":
            out.append("\n")
        elif not c.hidden:
            inner = c.shows(seen)
            todo += [(x, inner) for x in reversed(c.children)]
    return "".join(out)


def _table(table: Element, out: _Writer, visible: bool) -> Step:
    rows: list[tuple[Element, bool]] = []
    todo: list[tuple[Element | str, bool]] = [(c, visible) for c in reversed(table.children)]
    while todo:  # captions and what should not stand in a table come before its rows
        c, seen = todo.pop()
        if isinstance(c, str):
            if seen and c.strip():
                out.text(c)
        elif c.hidden or c.tag in ("colgroup", "col"):
            continue
        elif c.tag == "tr":
            rows.append((c, c.shows(seen)))
        elif c.tag in ROW_GROUPS:
            inner = c.shows(seen)
            todo += [(x, inner) for x in reversed(c.children)]
        else:
            yield _walk(c, out, seen)
    if out.grids >= out.limits.grids:
        for row, seen in rows:
            out.line()
            yield _children(row, out, seen)
        out.line()
        return None
    grid: list[list[tuple[int, int, list[str]]]] = []  # rows of (column, span, lines)
    held: list[tuple[int, int, int]] = []  # columns taken by cells from above: first, past last, row where that ends
    for r, (row, seen) in enumerate(rows):
        held = [h for h in held if h[2] > r]
        cells, column, k, fresh = [], 0, 0, []
        for cell in row.children:
            text = isinstance(cell, str)
            if text and not (seen and cell.strip()) or not text and cell.hidden:
                continue
            while k < len(held) and held[k][0] <= column:
                column = max(column, held[k][1])
                k += 1
            spans = [1, 1]
            if not text and cell.tag in ("td", "th"):
                spans = [int(x) if (x := cell.attributes.get(a, "1").strip()).isdecimal() and len(x) < 9 else 1 for a in ("colspan", "rowspan")]
            span = max(1, min(spans[0], COLSPAN))
            until = min(r + min(spans[1], ROWSPAN), len(rows)) if spans[1] else len(rows)
            cells.append((column, span, [_SPACE.sub(" ", cell).strip()] if text else (yield render(cell, seen, out.grids + 1, out.limits))))
            if until > r + 1:
                fresh.append((column, column + span, until))
            column += span
        if fresh:
            held = sorted(held + fresh)
            joined: list[tuple[int, int, int]] = []
            for h in held:
                if joined and joined[-1][1] >= h[0] and joined[-1][2] == h[2]:
                    joined[-1] = (joined[-1][0], max(joined[-1][1], h[1]), h[2])
                else:
                    joined.append(h)
            held = joined
        grid.append(cells)
    if len({column for cells in grid for column, _, _ in cells}) < 2:  # nothing to align
        out.ready([*filter(None, chain.from_iterable(own for cells in grid for _, _, own in cells))])
        return None
    # a column is as wide as its cells; one that spans further counts where no other cell begins below or above it
    columns = sorted({column for cells in grid for column, _, _ in cells})
    widths = dict.fromkeys(columns, 0)
    for cells in grid:
        for column, span, lines in cells:
            after = bisect_right(columns, column)
            if span == 1 or after == len(columns) or columns[after] >= column + span:
                widths[column] = max(widths[column], max(map(width, lines), default=0))
    begin, total = {}, 0
    for column in columns:
        begin[column] = total
        total += widths[column] + 2 if widths[column] else 0
    padded = total - 2 <= out.limits.widest
    lines = []
    for cells in grid:
        height = max((len(x) for _, _, x in cells), default=0)
        parts: list[list[str]] = [[] for _ in range(height)]
        ends = [0] * height
        for column, _, own in cells:
            for i, s in enumerate(own):
                if s:
                    start = max(begin[column] if padded else 0, ends[i] + 2 if parts[i] else 0)
                    parts[i].append(" " * (start - ends[i]) + s)
                    ends[i] = start + width(s)
        lines += ["".join(x) for x in parts if x]
    out.verbatim(lines)
    return None


#: Roman numerals.
ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def counter(n: int, kind: str) -> str:
    """A list's number as its type shows it: 1, a, A, i or I; what has no such form is a decimal number."""
    if kind.lower() == "a" and n > 0:
        out = ""
        while n:
            n, letter = divmod(n - 1, 26)
            out = chr(97 + letter) + out
    elif kind.lower() == "i" and 0 < n < 4000:
        out = ""
        for value, letters in ROMAN:
            out += letters * (n // value)
            n %= value
    else:
        return str(n)
    return out.upper() if kind.isupper() else out


def _list(element: Element, out: _Writer, visible: bool) -> Step:
    number = lambda s: int(s) if re.fullmatch(r"\s*[+-]?[0-9]{1,9}\s*", s) else None
    ordered, down = element.tag == "ol", "reversed" in element.attributes
    now = number(element.attributes.get("start", ""))
    if now is None:
        now = sum(isinstance(c, Element) and c.tag == "li" for c in element.children) if down else 1
    for c in element.children:
        if isinstance(c, str):
            if visible:
                out.text(c)
        elif c.hidden:
            continue
        elif c.tag == "li":
            own = number(c.attributes.get("value", ""))
            now = now if own is None else own
            mark = f"{counter(now, c.attributes.get('type', element.attributes.get('type', '1')).strip())}. " if ordered else "- "
            now += -1 if down else 1
            out.push(mark, " " * len(mark))
            yield _children(c, out, c.shows(visible))
            out.pop()
        else:
            yield _walk(c, out, visible)
    out.line()
    return None


def _walk(element: Element, out: _Writer, around: bool) -> Step:
    tag, visible = element.tag, element.shows(around)
    if tag == "br":
        if out.now:
            out.line()
        else:
            out.blank()
        return None
    if tag == "hr":
        out.blank()
        return None
    if tag == "img":
        if visible:
            out.text(element.attributes.get("alt", ""))
        return None
    if tag == "input":
        if visible and element.attributes.get("type", "text").lower() in SHOWN_INPUTS:
            out.text(element.attributes.get("value", ""))
        return None
    display = element.style("display")
    spaced = tag in SPACED and display != "inline"
    block = (tag in BLOCK or element.foreign and tag == "text" or display in ("block", "flex", "grid", "list-item", "flow-root")) and display != "inline"
    if spaced:
        out.blank()
    elif block:
        out.line()
    if tag == "table":
        yield _table(element, out, visible)
    elif tag in LISTS:
        yield _list(element, out, visible)
    elif tag in ("pre", "xmp"):
        out.verbatim([x.rstrip() for x in _plain(element, visible).strip("\n").split("\n")])
    elif tag == "details" and "open" not in element.attributes:
        summary = next((c for c in element.children if isinstance(c, Element) and c.tag == "summary"), None)
        if summary is not None and not summary.hidden:
            yield _walk(summary, out, visible)
    elif tag in ("blockquote", "dd"):
        mark = "> " if tag == "blockquote" else "    "
        out.push(mark, mark)
        yield _children(element, out, visible)
        out.pop()
    else:
        yield _children(element, out, visible)
    if spaced:
        out.blank()
    elif block:
        out.line()
    elif tag in ("td", "th"):
        out.text(" ")
    return None


def _children(element: Element, out: _Writer, visible: bool) -> Step:
    for c in element.children:
        if isinstance(c, str):
            if visible:
                out.text(c)
        elif not c.hidden:
            yield _walk(c, out, visible)
    return None


def render(element: Element, visible: bool = True, grids: int = 0, limits: Limits = LIMITS) -> Step:
    """Lines of the element's content."""
    out = _Writer(grids, limits)
    yield _children(element, out, element.shows(visible))
    return out.done()


def page_text(source: str | None, limits: Limits = LIMITS) -> tuple[str | None, str]:
    """A page's title and its visible text."""
    if not source:
        return None, ""
    root, title = parse(source)
    return title if title is None else _SPACE.sub(" ", title).strip(), "\n".join(_work(render(root, limits=limits)))


def html_text(source: str | None, limits: Limits = LIMITS) -> str:
    return page_text(source, limits)[1]


def extract(pages: DataFrame, limits: Limits = EXACT) -> DataFrame:
    """page_id, title and the visible text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            got, begin, size = [], 0, 0
            for i, s in enumerate(texts_of(part, "html").to_pylist(), 1):
                got.append(page_text(s, limits))
                size += len(got[-1][1])
                if size >= SLICE_BYTES or i == part.num_rows:  # layout may make a text longer than its page
                    yield pa.record_batch([part.column("page_id").slice(begin, len(got)), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string())], names=["page_id", "title", "text"])
                    got, begin, size = [], i, 0

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, title string, text string")
