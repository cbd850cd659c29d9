"""Layout-aware rendering of HTML to text.

A tokenizer splits the page; a tree builder opens and closes elements with the tags
that HTML implies; hidden elements are dropped; what is left is laid out: inline text
runs together with white space collapsed, blocks begin on lines of their own,
paragraphs and headings are set off by an empty line, list items get a bullet or
their number and are indented by depth, tables become rows of cells padded to the
width of their columns, preformatted text keeps its white space.

All visible text of the whole page comes out, in order: formulas, options and the text
of drawings as well, what is hidden from screen readers only, and what an object shows
where it can't be loaded. `display: none` hides a subtree, `visibility` is inherited and
can be undone further down; of several declarations of a property the last important one
counts, else the last. A dialog that isn't open is hidden, of details that aren't open the
summary shows. Styles are read from style attributes; rules of style sheets play no part.

Time and memory are linear in the page, whatever it holds: tokens are found without
going back, the tree builder looks open elements up by name, and tree walks keep a stack
of their own, so that no depth is too great. Only the layout is bounded, never the text:
indentation and nested tables end at depth NEST, below which items, quotes and rows are
plain blocks; a cell wider than COLUMN characters doesn't widen its column; a table that
padding would make PADDED times longer than its text is not padded; row spans end once
SPANNED of them have been carried from row to row. Spans are held to the limits that
HTML itself sets.

Defined cases: a null page gives null; an empty one, or one without visible text, an
empty text; unclosed and stray tags never fail; a tag that isn't closed is text; a
quote that never ends makes the rest of the page be read without regard to quotes;
repeated rows each get a row; other columns are left alone, but for html, which is
replaced by text (and so is a column text that was there before).
"""

from __future__ import annotations

import html as entities
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style head title meta link template noscript iframe embed datalist audio video canvas noembed noframes rp".split())
#: What a head can hold; text and all other tags begin the body.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
#: Never shown within svg and math.
UNSEEN = frozenset("defs desc metadata symbol clippath mask marker pattern annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset menu".split())
BLOCKS = SPACED | frozenset("html body address article aside details dialog dd div dt figcaption footer form header hgroup legend li main nav section summary caption optgroup option tr thead tbody tfoot center".split())
#: An opening tag closes these open elements, up to the nearest of the barrier.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
CLOSES_P = BLOCKS - {"html", "body", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup", "legend", "li", "dd", "dt"} | {"li", "dd", "dt"}
SCOPE = frozenset({"td", "th", "table", "caption", "html", "object", "template"})
INLINE_END = frozenset("td th a b i em strong span".split())
#: Markup that isn't a tag, and text up to the next bracket.
OTHER = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</(?![a-zA-Z])[^>]*>?|[^<]+|<", re.S)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What follows a tag's name: a quote counts after an equals sign only. The second form takes no account of quotes.
QUOTED = re.compile(r"((?:[^>=]|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=(?!\s*[\"']))*+)>")
BLIND = re.compile(r"([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
GAP = re.compile(r"[ \t\n\r\f]+")
NEST, COLUMN, PADDED, SPANNED = 32, 80, 16, 2_000_000
#: The largest spans of HTML.
COLSPAN, ROWSPAN = 1000, 65534


class Node:
    __slots__ = ("name", "children", "attrs", "role")

    def __init__(self, name: str, attrs: str = "", role: str = ""):
        self.name, self.children, self.attrs, self.role = name, [], attrs, role

    def get(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attrs):
            if m[1].lower() == name:
                return entities.unescape(m[2] or m[3] or m[4] or "")
        return None


class Open:
    """The open elements: a stack, and by name the places in it."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}

    def last(self, names) -> int:
        """The place of the innermost open element with one of the names, or 0."""
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=0)

    def push(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        """Closes all from place k on."""
        while len(self.stack) > k:
            self.at[self.stack.pop().name].pop()

    def close(self, names, barrier) -> None:
        """Closes the outermost element of names that lies within the barrier, and all in it."""
        low = self.last(barrier)
        first = len(self.stack)
        for x in names:
            for p in reversed(self.at.get(x, ())):  # all that lie within are closed, so that each is looked at once
                if p <= low:
                    break
                first = min(first, p)
        self.cut(first)


def build(page: str) -> Node:
    """The tree of a page. Children are nodes and strings."""
    root = Node("html")
    now = Open(root)
    stack = now.stack
    pos, n, last = 0, len(page), page.rfind(">")
    form = QUOTED

    def say(text):
        if stack[-1].name == "head" and text.strip(" \t\n\r\f"):
            now.cut(len(stack) - 1)
        stack[-1].children.append(text)

    def foreign():
        """Whether svg or math is open, with no HTML inside."""
        return now.last(("svg", "math")) > now.last(("foreignobject",))

    while pos < n:
        m = NAME.match(page, pos)
        body = None
        if m and last >= m.end():
            body = form.match(page, m.end())
            if body is None:
                form = BLIND
                body = form.match(page, m.end())
        if body is None:
            text = "<" if m else OTHER.match(page, pos)[0]
            pos += len(text)
            if text[0] != "<" or text == "<":
                say(entities.unescape(text) if "&" in text else text)
            continue
        pos = body.end()
        name = m[2].lower()
        if m[1]:
            if name == "p" and not now.at.get("p"):
                stack[-1].children.append(Node("p"))
            elif name == "br":
                if stack[-1].name == "head":
                    now.cut(len(stack) - 1)
                stack[-1].children.append(Node("br"))
            k = now.last((name,))
            if k and (name in BLOCKS or name in INLINE_END or now.last(("td", "th", "table", "li")) <= k):
                now.cut(k)
            continue
        if name in CLOSES_P:
            now.close({"p"}, SCOPE)
        if name in IMPLIED:
            now.close(*IMPLIED[name])
        if name == "html" or (name == "body" and now.at.get("body")):
            continue
        if stack[-1].name == "head":
            if name == "head":
                continue
            if name not in IN_HEAD:
                now.cut(len(stack) - 1)
        attrs = body[1]
        closed = attrs.endswith("/")
        inside = (closed or name == "text" or name in UNSEEN) and foreign()
        node = Node(name, attrs, "" if not inside else "hidden" if name in UNSEEN else "block" if name == "text" else "")
        stack[-1].children.append(node)
        if closed and (inside or name in ("svg", "math")):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, pos)
            stop = end.start() if end else n
            text = page[pos:stop]
            node.children.append(entities.unescape(text) if name in ("textarea", "title") else text)
            pos = n if end is None else (page.find(">", stop) + 1 or n)
        elif name not in VOID:
            now.push(node)
    return root


def declared(node: Node, prop: str) -> str | None:
    """The value of a property in the node's style attribute, in lower case; None where it isn't declared."""
    if not node.attrs or prop not in node.attrs.lower():
        return None
    found, strong = None, False
    for part in (node.get("style") or "").split(";"):
        name, _, value = part.partition(":")
        if name.strip().lower() == prop and value.strip():
            value, mark, rest = value.strip().lower().partition("!")
            important = bool(mark) and rest.strip() == "important"
            if important or not strong:
                found, strong = value.strip(), important
    return found


def hidden(node: Node) -> bool:
    if node.name in HIDDEN or node.role == "hidden":
        return True
    if node.name == "input" or node.name == "dialog" and node.get("open") is None:
        return True
    return bool(node.attrs) and (node.get("hidden") is not None or declared(node, "display") == "none")


def _wide(text: str) -> int:
    """Columns that a text takes."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Layout:
    """Lines of a block. gap: empty lines wanted before the next line."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0

    def inline(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.split("\n")
            self.now.append(first)
            for x in rest:
                self.lines.append("".join(self.now).rstrip())
                self.now = [x]
            return
        text = GAP.sub(" ", text)
        if text.startswith(" ") and (not self.now or self.now[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.now.append(text)

    def end(self, gap: int = 0, force: bool = False) -> None:
        line = "".join(self.now).rstrip()
        self.now = []
        if line or force:
            self.put([line])
        self.gap = max(self.gap, gap)

    def put(self, lines: list[str]) -> None:
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.lines.extend(lines)


def _walk(steps) -> None:
    """Runs a generator that yields generators to be run before it goes on: recursion on a stack of its own."""
    stack = [steps]
    while stack:
        try:
            stack.append(next(stack[-1]))
        except StopIteration:
            stack.pop()


def _visible(node: Node, before: bool) -> bool:
    """Whether text in the node is shown: the last word of its own style, else what is inherited."""
    said = declared(node, "visibility")
    return said == "visible" if said in ("visible", "hidden", "collapse") else before


def _number(text: str | None, least: int, most: int) -> int:
    """A span: 1 where it is missing or odd."""
    return min(max(int(text), least), most) if text and re.fullmatch(r"[0-9]{1,9}", text) else 1


def _integer(text: str | None, other: int) -> int:
    """A whole number of an attribute, or another where it is missing or odd."""
    return int(text) if text and re.fullmatch(r"[+-]?[0-9]{1,9}", text.strip()) else other


def render(node: Node, out: Layout, keep: bool = False, depth: int = 0, seen: bool = True):
    """Steps (see _walk) that lay the children of node out. depth: how many layouts are nested here."""
    number, step = None, 1
    if node.name == "ol":
        items = [c for c in node.children if isinstance(c, Node) and c.name == "li" and not hidden(c)]
        step = -1 if node.get("reversed") is not None else 1
        number = _integer(node.get("start"), 1 if step > 0 else len(items))
    children = node.children
    if node.name == "details" and node.get("open") is None:  # only the first summary shows
        children = [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
    for child in children:
        if isinstance(child, str):
            if seen:
                out.inline(child, keep)
            continue
        name = child.name
        if hidden(child):
            continue
        shown = _visible(child, seen)
        if name == "br":
            out.end(force=True)
        elif name == "hr":
            out.end(1)
        elif name == "img":
            if shown and (alt := child.get("alt")):
                out.inline(alt, keep)
        elif name == "table" and depth < NEST:
            out.end(1)
            lines: list[str] = []
            yield table(child, lines, depth + 1, shown)
            if lines:
                out.put(lines)
            out.end(1)
        elif name == "li" and depth < NEST:
            out.end()
            inner = Layout()
            yield render(child, inner, keep, depth + 1, shown)
            inner.end()
            if number is not None:
                number = _integer(child.get("value"), number)
            mark = "- " if number is None else f"{number}. "
            if number is not None:
                number += step
            if inner.lines:
                out.put([(mark if k == 0 else " " * len(mark) if line else "") + line for k, line in enumerate(inner.lines)])
            out.end()
        elif name in ("dd", "blockquote") and depth < NEST:
            out.end(int(name == "blockquote"))
            inner = Layout()
            yield render(child, inner, keep, depth + 1, shown)
            inner.end()
            if inner.lines:
                out.put(["  " + line if line else "" for line in inner.lines])
            out.end(int(name == "blockquote"))
        elif name in BLOCKS or child.role == "block":
            nested = name in ("ul", "ol", "menu") and node.name == "li"
            gap = int(name in SPACED and not nested)
            out.end(gap)
            if name == "pre" and not keep and depth < NEST:
                inner = Layout()
                yield render(child, inner, True, depth + 1, shown)
                inner.lines.append("".join(inner.now).rstrip())
                while inner.lines and not inner.lines[-1]:
                    inner.lines.pop()
                if inner.lines and not inner.lines[0]:
                    del inner.lines[0]
                if inner.lines:
                    out.put(inner.lines)
            else:
                yield render(child, out, keep, depth, shown)
            out.end(gap)
        else:
            yield render(child, out, keep, depth, shown)
            if name in ("td", "th"):
                out.inline(" ", False)


def table(node: Node, out: list[str], depth: int, seen: bool):
    """Steps that put the rows of a table into out, each column as wide as its widest cell; other content of the table comes before them.

    A cell stands in the first column that no row span from above holds. Only columns in
    which some cell begins are written, so that spans cost nothing.
    """
    rows: list[list[tuple[int, list[str]]]] = []
    loose = Layout()
    spans: list[tuple[int, int, int]] = []  # first column, column after the last, last row of what spans rows, by column
    at = next_span = work = 0

    def begin():
        nonlocal at, next_span, work
        rows.append([])
        at = next_span = 0
        spans.extend(tail)
        tail.clear()
        work += len(spans)
        spans[:] = sorted(x for x in spans if x[2] >= len(rows)) if work < SPANNED else []

    def place(cell: Node) -> int:
        """The cell's first column."""
        nonlocal at, next_span
        while next_span < len(spans) and spans[next_span][0] <= at:
            at = max(at, spans[next_span][1])
            next_span += 1
        first, at = at, at + _number(cell.get("colspan"), 1, COLSPAN)
        tall = _number(cell.get("rowspan"), 0, ROWSPAN) or ROWSPAN
        if tall > 1 and work < SPANNED:
            tail.append((first, at, len(rows) + tall - 1))
        return first

    tail: list[tuple[int, int, int]] = []  # spans that this row begins

    def cells(part: Node, vis: bool):
        row = False
        for child in part.children:
            if isinstance(child, str):
                if vis and child.strip():
                    loose.inline(child, False)
            elif hidden(child):
                continue
            elif child.name in ("thead", "tbody", "tfoot", "tr", "colgroup"):
                if child.name == "tr":
                    begin()
                    row = False
                elif child.name != "colgroup":
                    spans.clear()  # a row span ends with its group
                    tail.clear()
                yield cells(child, _visible(child, vis))
            elif child.name in ("td", "th"):
                if not rows or (part.name != "tr" and not row):
                    begin()
                row = True
                inner = Layout()
                yield render(child, inner, False, depth, _visible(child, vis))
                inner.end()
                rows[-1].append((place(child), inner.lines))
            elif child.name == "caption":
                loose.end()
                yield render(child, loose, False, depth, _visible(child, vis))
                loose.end()
            else:
                lone = Node("div")
                lone.children.append(child)
                yield render(lone, loose, False, depth, vis)

    yield cells(node, seen)
    loose.end()
    out.extend(loose.lines)
    used = {c: k for k, c in enumerate(sorted({c for row in rows for c, _ in row}))}
    wide = [0] * len(used)
    text = 0
    for row in rows:
        for c, lines in row:
            k = used[c]
            for line in lines:
                w = _wide(line)
                text += w + 1
                wide[k] = max(wide[k], min(w, COLUMN))
    ends = [0]
    for w in wide:
        ends.append(ends[-1] + w + 3)
    padded = sum(ends[used[row[-1][0]]] * max((len(lines) for _, lines in row), default=0) for row in rows if row)
    aligned = padded <= PADDED * (text + 1000)
    for row in rows:
        for k in range(max((len(lines) for _, lines in row), default=0)):
            line, done = [], 0
            for c, lines in row:
                own = lines[k] if k < len(lines) else ""
                if aligned:
                    line.extend(" " * w for w in wide[done : used[c]])
                    done = used[c] + 1
                    own += " " * (wide[used[c]] - _wide(own))
                line.append(own)
            out.append(" | ".join(line).rstrip(" |") if not any("|" in x for x in line) else " | ".join(line).rstrip())


def to_text(page: str | None) -> str | None:
    if page is None:
        return None
    out = Layout()
    _walk(render(build(page), out))
    out.end()
    return "\n".join(out.lines).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """pages with html replaced by text (a column text of their own as well)."""
    columns = [c for c in pages.columns if c not in ("html", "text")]
    used = pages.select(F.struct(*columns).alias("__row"), F.col("html").alias("__html"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_text(x) for x in batch.column(1).to_pylist()], pa.string())], ["__row", "text"])

    return used.mapInArrow(run, f"__row {used.schema['__row'].dataType.simpleString()}, text string").select("__row.*", "text")


def html_report(pages: DataFrame) -> DataFrame:
    """page_id, text and its length of every page."""
    return extract(pages.select("page_id", "html")).select("page_id", "text", F.length("text").cast("bigint").alias("n_chars"))
