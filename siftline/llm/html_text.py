"""HTML extraction: a tree builder with implied tags, visibility rules and a layout-aware renderer.

Markup is scanned once into tags and text; the builder supplies implied end tags (p, li, td, ...), table
bodies and rows, and closes what is left open. Elements that a browser does not show are dropped:
by kind, by attribute, by style, and by rules of the page's style sheets for an element, class or id;
formulas, texts of drawings, options and open dialogs are shown.
The renderer keeps block spacing (blank lines around paragraphs and headings, single line ends
around other blocks), list marks with nesting, preformatted text, and table cells padded to aligned
columns, with row and column spans, heads before and feet after the other rows.

Nothing recurses, and no step looks through the page or the open elements again for each tag, so that
time grows with the page (nested tables: with the page and the text that they nest).

Defined results: null markup gives a null text; an empty page gives an empty text; unclosed comments
and elements run to the end of the page, and so does a tag without its end, which shows nothing; a very
long page is rendered whole; of style rules for one selector the last counts; repeated rows are
rendered each; an empty table gives an empty table; the input's columns are returned with the text
column added or replaced, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style noscript template iframe noembed noframes".split())
PLAIN = frozenset("textarea title".split())
UNSEEN = RAW | frozenset("head title datalist audio video canvas object area source track param".split())
#: Elements of drawings and formulas that are not shown, by the element around them.
FOREIGN = {
    "svg": frozenset("desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter".split()),
    "math": frozenset(["annotation", "annotation-xml"]),
}
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside header footer nav main address li dt dd form figcaption details summary tr caption legend center dialog option optgroup".split()
)
#: A start tag of the first kind ends open elements of the second, up to the boundary.
PARAGRAPH_END = BLOCK - {"html", "body", "tr", "caption", "legend", "option", "optgroup"}
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
SCOPE = frozenset("table td th caption button body html".split())

#: The standard's bounds of spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
ROWS = frozenset("tr tbody thead tfoot".split())
BUTTONS = frozenset("submit button reset".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Up to the end of a tag; quoted values are passed over as a whole, other quotes are like any character.
REST = re.compile(r"""(?:[^>"'=]+|=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?|["'])*+""")
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
STYLE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)", re.I)
SELECTOR = re.compile(r"([a-zA-Z][a-zA-Z0-9]*)?((?:[.#][a-zA-Z_][a-zA-Z0-9_-]*)?)")


class Element:
    __slots__ = ("name", "attrs", "parts")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.parts = name, attrs, []


class Open:
    """The open elements, with the places of those of each name."""

    def __init__(self, root: Element):
        self.stack = [root]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, e: Element) -> None:
        self.places[e.name].append(len(self.stack))
        self.stack.append(e)

    def cut(self, place: int) -> None:
        """Closes the element at that place and all within it."""
        while len(self.stack) > place:
            self.places[self.stack.pop().name].pop()

    def last(self, names) -> int:
        """Place of the innermost open element of these names, or 0."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, names, until) -> None:
        place = self.last(names)
        if place > self.last(until):
            self.cut(place)


def parse(markup: str) -> Element:
    """The tree below an element without a name."""
    root = Element("", {})
    opened = Open(root)
    stack = opened.stack

    def add(name: str, attrs: dict[str, str]) -> Element:
        node = Element(name, attrs)
        stack[-1].parts.append(node)
        if name not in VOID:
            opened.push(node)
        return node

    at, size = 0, len(markup)
    text_from = 0
    while True:
        start = markup.find("<", at)
        named = NAME.match(markup, start + 2 if markup.startswith("/", start + 1) else start + 1) if start >= 0 else None
        if start >= 0 and named is None and markup[start + 1 : start + 2] not in ("!", "?", "/"):
            at = start + 1  # a bare sign
            continue
        stop = start if start >= 0 else size
        if stop > text_from:
            stack[-1].parts.append(html.unescape(markup[text_from:stop]))
        if start < 0:
            return root
        if named is None:
            comment = markup.startswith("<!--", start)
            found = markup.find("-->" if comment else ">", start + (4 if comment else 2))
            at = text_from = size if found < 0 else found + (3 if comment else 1)
            continue
        end = REST.match(markup, named.end()).end()
        if end >= size:  # no end: the rest of the page belongs to the tag
            return root
        name, attributes = named[0].lower(), markup[named.end() : end]
        at = text_from = end + 1
        if markup[start + 1] == "/":
            if name == "p" and not opened.places.get("p"):
                add("p", {})
            place = opened.last((name,))
            outside = name in ("table", "tr", "tbody", "thead", "tfoot", "body", "html")
            if place and (outside or place >= opened.last(("table", "td", "th"))):
                opened.cut(place)
            continue
        attrs = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTR.findall(attributes)}
        if name in PARAGRAPH_END:
            opened.close(("p",), SCOPE)
        if name in IMPLIED_END:
            ends, until = IMPLIED_END[name]
            for _ in ends:
                opened.close(ends, until)
        if name == "body":
            opened.close(("head",), ())
        if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            add("tr", {})
        if attributes.endswith("/") and opened.last(FOREIGN):
            stack[-1].parts.append(Element(name, attrs))
            continue
        node = add(name, attrs)
        if name in RAW or name in PLAIN:
            closing = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(markup, at)
            text = markup[at : closing.start() if closing else size]
            node.parts.append(html.unescape(text) if name in PLAIN else text)
            at = text_from = closing.end() if closing else size
            opened.cut(len(stack) - 1)


def sheet_rules(sheet: str) -> Iterator[tuple[str, dict[str, str]]]:
    """Selectors of one element, class or id, with their display and visibility. Conditional blocks (@media ...) are left out."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)
    depth, at, skipped = 0, 0, False
    selector = ""
    for m in re.finditer(r"[{};]", sheet):
        part, at = sheet[at : m.start()], m.end()
        if m[0] == "{":
            depth += 1
            if depth == 1:
                selector, skipped = part.strip(), part.strip().startswith("@")
                body = ""
        elif m[0] == "}":
            depth = max(0, depth - 1)
            if depth == 0 and not skipped and selector:
                found = {k.lower(): v.lower() for k, v in STYLE.findall(body + part)}
                if found:
                    for one in selector.split(","):
                        if SELECTOR.fullmatch(one.strip()) and one.strip():
                            yield one.strip(), found
                selector = ""
        elif depth == 1:
            body += part + ";"


class Rules:
    """Which elements a page shows."""

    def __init__(self, root: Element):
        self.rules: dict[str, dict[str, str]] = {}
        stack = [iter(root.parts)]
        while stack:
            part = next(stack[-1], None)
            if part is None:
                stack.pop()
            elif isinstance(part, Element):
                if part.name == "style":
                    for selector, found in sheet_rules("".join(x for x in part.parts if isinstance(x, str))):
                        self.rules.setdefault(selector, {}).update(found)
                elif part.parts:
                    stack.append(iter(part.parts))

    def style(self, e: Element) -> dict[str, str]:
        """display and visibility of an element, from the least specific rule to its own style."""
        a, out = e.attrs, {}
        if self.rules:
            marks = [f".{c}" for c in a.get("class", "").split()] + ([f"#{a['id']}"] if a.get("id") else [])
            for selector in [e.name, *(x for m in marks for x in (m, e.name + m))]:
                out |= self.rules.get(selector, {})
        if "style" in a:
            out |= {k.lower(): v.lower() for k, v in STYLE.findall(a["style"])}
        return out

    def shown(self, e: Element, style: dict[str, str]) -> bool:
        """Whether anything of an element can be shown."""
        a = e.attrs
        if e.name in UNSEEN or (e.name == "dialog" and "open" not in a) or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
            return False
        if e.name == "input" and a.get("type", "").lower() == "hidden":
            return False
        return style.get("display") != "none"


def invisible(style: dict[str, str], around: bool) -> bool:
    """Whether an element's own text is hidden; within a hidden element another can be visible."""
    value = style.get("visibility")
    return around if value is None or value == "inherit" else value in ("hidden", "collapse")


class Page:
    """Lines of text under construction; gap: line ends owed before the next text."""

    def __init__(self):
        self.out: list[str] = []
        self.gap = 0
        self.indent: list[str] = []
        self.mark = ""
        self.space = False
        self.fresh = True

    def block(self, lines: int) -> None:
        self.gap = max(self.gap, lines)
        self.space = False

    def _begin(self) -> None:
        if self.gap:
            if self.out:
                self.out.append("\n" * self.gap)
            self.gap, self.fresh = 0, True
        if self.fresh:
            self.out.append("".join(self.indent) + self.mark)
            self.mark, self.fresh = "", False

    def text(self, value: str) -> None:
        words = value.split()
        if not words:
            self.space = self.space or bool(value)
            return
        lead = self.space or value[0].isspace()
        starts = bool(self.gap) or self.fresh
        self._begin()
        self.out.append((" " if lead and not starts else "") + " ".join(words))
        self.space = value[-1].isspace()

    def verbatim(self, value: str) -> None:
        for n, line in enumerate(value.split("\n")):
            if n:
                self.gap = max(self.gap, 0) + 1
            if line:
                self._begin()
                self.out.append(line.rstrip())

    def broken(self) -> None:
        self.block(self.gap + 1 if self.gap else 1)


class Renderer:
    """Renders one page: tables first, inner before outer, so that their lines are there when a cell needs them."""

    def __init__(self, root: Element):
        self.root = root
        self.rules = Rules(root)
        self.tables: dict[int, list[str]] = {}

    def text(self) -> str:
        for table, hidden in reversed(self._tables()):
            self.tables[id(table)] = self.table_lines(table, hidden)
        return self.text_of(self.root)

    def _tables(self) -> list[tuple[Element, bool]]:
        """The tables that are shown, outer before inner, and whether their text is hidden."""
        found = []
        stack = [(iter(self.root.parts), False)]
        while stack:
            parts, hidden = stack[-1]
            part = next(parts, None)
            if part is None:
                stack.pop()
            elif isinstance(part, Element) and part.parts:
                style = self.rules.style(part)
                if self.rules.shown(part, style):
                    within = invisible(style, hidden)
                    if part.name == "table":
                        found.append((part, within))
                    stack.append((iter(part.parts), within))
        return found

    def text_of(self, e: Element, hidden: bool = False) -> str:
        page = Page()
        self._render(page, e, hidden)
        return re.sub(r"\n{3,}", "\n\n", "".join(page.out)).strip("\n")

    def line_of(self, e: Element, hidden: bool) -> str:
        return " ".join(self.text_of(e, hidden).split())

    def _alone(self, e: Element, hidden: bool) -> str:
        """The text of an element with its own marks and layout, in one line."""
        around = Element("", {})
        around.parts.append(e)
        return self.line_of(around, hidden)

    def _render(self, page: Page, e: Element, hidden: bool) -> None:
        within: dict[str, int] = defaultdict(int)  # open elements by name
        lists: list[Element] = []
        numbers: dict[int, int] = {}  # of the next item, by list
        stack: list = [(e, iter(e.parts), None, hidden)]
        within[e.name] += 1
        while stack:
            node, parts, after, hidden = stack[-1]
            part = next(parts, None)
            if part is None:
                stack.pop()
                within[node.name] -= 1
                if node.name in ("ul", "ol") and lists:
                    lists.pop()
                if after:
                    after()
                continue
            if isinstance(part, str):
                if not hidden:
                    page.verbatim(part) if within["pre"] else page.text(part)
                continue
            name, style = part.name, self.rules.style(part)
            if not self.rules.shown(part, style) or any(within[f] and name in unseen for f, unseen in FOREIGN.items()):
                continue
            veiled = invisible(style, hidden)
            if name == "br":
                page.broken()
            elif name == "hr":
                page.block(2)
            elif name == "img":
                if part.attrs.get("alt") and not veiled:
                    page.text(" " + part.attrs["alt"] + " ")
            elif name == "input":
                if part.attrs.get("type", "").lower() in BUTTONS and not veiled:
                    page.text(" " + part.attrs.get("value", "") + " ")
            elif name == "table":
                page.block(2)
                for line in self.tables.get(id(part), ()):
                    page.verbatim(line)
                    page.block(1)
                page.block(2)
            else:
                lines = 2 if name in SPACED else 1 if name in BLOCK else 0
                if name in ("ul", "ol"):
                    lists.append(part)
                    if within["li"]:
                        lines = 1
                if lines:
                    page.block(lines)
                undo = None
                if name == "li":
                    mark = "- "
                    if lists and lists[-1].name == "ol":
                        owner = lists[-1]
                        if id(owner) not in numbers:
                            start = owner.attrs.get("start", "1")
                            numbers[id(owner)] = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
                        mark = f"{numbers[id(owner)]}. "
                        numbers[id(owner)] += 1
                    page.mark = "  " * max(0, len(lists) - 1) + mark
                elif name == "blockquote":
                    page.indent.append("  ")
                    undo = page.indent.pop
                elif name == "dd":
                    page.mark = "  "
                elif name == "optgroup":
                    if not veiled:
                        page.text(part.attrs.get("label", ""))
                elif name == "text":
                    page.text(" ")  # labels of a drawing stand apart

                def after(lines=lines, undo=undo):
                    if undo:
                        undo()
                    page.mark = ""
                    if lines:
                        page.block(lines)

                within[name] += 1
                stack.append((part, iter(part.parts), after, veiled))

    def _holders(self, table: Element) -> set[int]:
        """Elements between the table and its rows, cells and captions, whatever they are; a nested table's are its own."""
        found: set[int] = set()
        stack = [(table, iter(table.parts))]
        while stack:
            part = next(stack[-1][1], None)
            if part is None:
                stack.pop()
            elif isinstance(part, Element) and part.name != "table" and self.rules.shown(part, self.rules.style(part)):
                if part.name in ("tr", "td", "th", "caption"):
                    for node, _ in reversed(stack):
                        if id(node) in found:
                            break
                        found.add(id(node))
                if part.name not in ("td", "th", "caption"):
                    stack.append((part, iter(part.parts)))
        return found

    def table_lines(self, table: Element, hidden: bool) -> list[str]:
        """Rows with cells padded to their column's width; a cell's own lines are joined by a space.

        Captions, and what stands in the table outside of rows and cells, come first, as browsers place it.
        """
        sections: dict[str, list[Row]] = {"thead": [], "tbody": [], "tfoot": []}
        captions: list[str] = []
        holders = self._holders(table)
        loose: Row | None = None  # the row of cells that stand outside of rows
        spans: dict[str, list[tuple[int, int, int]]] = {k: [] for k in sections}

        def row_of(section: str) -> Row:
            row = Row(spans[section], len(sections[section]))
            sections[section].append(row)
            return row

        stack: list = [(iter(table.parts), None, "tbody", hidden)]
        while stack:
            parts, row, section, veil = stack[-1]
            part = next(parts, None)
            if part is None:
                stack.pop()
                continue
            if isinstance(part, str):
                if not veil:
                    captions.append(" ".join(part.split()))
                continue
            style = self.rules.style(part)
            if not self.rules.shown(part, style):
                continue
            veiled = invisible(style, veil)
            if part.name in ROWS:
                loose = None
                if part.name == "tr":
                    row = row_of(section)
                else:
                    section = part.name
                stack.append((iter(part.parts), row, section, veiled))
            elif part.name in ("td", "th"):
                if row is None:
                    if loose is None:
                        loose = row_of(section)
                    row = loose
                row.add(self.line_of(part, veiled), span_of(part, "colspan", MOST_COLUMNS), span_of(part, "rowspan", MOST_ROWS))
            elif part.name == "caption":
                captions.append(self.line_of(part, veiled))
            elif id(part) in holders:
                stack.append((iter(part.parts), row, section, veiled))
            elif row is None:
                captions.append(self._alone(part, veil))
            else:
                row.add(self._alone(part, veil), 1, 1)
        rows = [r.cells for section in sections.values() for r in section if any(r.cells.values())]
        widths: dict[int, int] = defaultdict(int)
        for cells in rows:
            for column, cell in cells.items():
                widths[column] = max(widths[column], len(cell))
        # a column without any text takes no place
        place = {c: n for n, c in enumerate(sorted(c for c, w in widths.items() if w))}
        order = sorted(place, key=place.get)
        lines = []
        for cells in rows:
            last = max((place[c] for c, x in cells.items() if x), default=-1)
            lines.append("  ".join(cells.get(c, "").ljust(widths[c]) for c in order[: last + 1]).rstrip())
        return [c for c in captions if c] + lines


def span_of(cell: Element, name: str, most: int) -> int:
    found = re.match(r"\s*([0-9]+)", cell.attrs.get(name, ""))
    if not found:
        return 1
    span = int(found[1][:9])
    return min(span or (most if name == "rowspan" else 1), most)


class Row:
    """Cells by column. spans: columns (first, past the last) that cells of earlier rows reach into, and up to which row."""

    def __init__(self, spans: list[tuple[int, int, int]], number: int):
        self.cells: dict[int, str] = {}
        self.column = 0
        spans[:] = sorted(s for s in spans if s[2] > number)
        self.spans, self.number, self.taken = spans, number, deque(spans)

    def add(self, text: str, columns: int, rows: int) -> None:
        while self.taken and self.taken[0][0] <= self.column:
            self.column = max(self.column, self.taken.popleft()[1])
        self.cells[self.column] = text
        if rows > 1:
            self.spans.append((self.column, self.column + columns, self.number + rows))
        self.column += columns


def visible_text(markup: str | None) -> str | None:
    return None if markup is None else Renderer(parse(markup)).text()


def extracted(pages: DataFrame, markup: str = "html", into: str = "text", drop_markup: bool = True) -> DataFrame:
    """pages with the visible text; the markup column goes unless kept."""
    names = [c for c in pages.columns if c != into and not (drop_markup and c == markup)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(m) for m in batch.column(markup).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, into])

    fields = [f for f in pages.schema.fields if f.name in names]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return pages.mapInArrow(run, f"{kinds}{', ' if kinds else ''}`{into}` string")
