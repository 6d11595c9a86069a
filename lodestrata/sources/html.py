"""Visible text of HTML as located blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F

# Elements that end a run of text, elements whose content isn't visible, elements without content.
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style head template noscript iframe object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MOST_SPAN = 1000
# Links that run something, and characters that no link may hold.
UNREADABLE = re.compile(r"\A\s*(?:javascript|data|vbscript):|[\x00-\x1f]", re.I)


@dataclass
class Block:
    text: str
    line_start: int
    line_end: int
    table: int | None = None
    row: int | None = None
    column: int | None = None
    column_span: int | None = None
    row_span: int | None = None
    list_id: int | None = None
    list_depth: int | None = None
    item_index: int | None = None
    list_item: bool | None = None
    links: list[tuple[str, int, int, str]] = field(default_factory=list)


@dataclass
class Frame:
    """An open element: what it is, whether it hides its content, and, of an item, its list and number."""

    tag: str
    hidden: bool
    item: tuple[int, int, int] | None = None  # list, depth, number


@dataclass
class Anchor:
    target: str
    start: int
    line: int
    fresh: bool = True  # no block has ended since it was opened, or it has shown an image since

    def worth(self, end: int) -> bool:
        """It labels something here: text, an image, or, never broken off, nothing at all."""
        return self.fresh or end > self.start


class Table:
    def __init__(self, number: int):
        self.number, self.row, self.column = number, 0, 0
        self.spans = (1, 1)
        self.taken: dict[int, int] = {}  # column -> rows still covered from above

    def next_row(self) -> None:
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}
        self.row += 1
        self.column = 0
        self.spans = (1, 1)

    def next_cell(self, columns: int, rows: int) -> None:
        self.column += self.spans[0] if self.column else 1
        while self.column in self.taken:
            self.column += 1
        self.spans = (columns, rows)
        if rows > 1:
            self.taken.update({c: rows for c in range(self.column, self.column + columns)})


class VisibleText(HTMLParser):
    """Collects blocks; white space collapses outside ``pre``. Raises ValueError for spans out of bounds."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[Frame] = []
        self.tags = 0
        self.parts: list[str] = []
        self.first_line = self.last_line = 0
        self.tables: list[Table] = []
        self.n_tables = self.n_lists = 0
        self.lists: list[list[int]] = []  # list number, items so far
        self.anchors: list[Anchor] = []
        self.links: list[tuple[str, int, int, bool]] = []  # the last: closed
        self.link_line = 0

    # the text run

    def _length(self) -> int:
        return sum(map(len, self.parts))

    def _pre(self) -> bool:
        return any(f.tag == "pre" for f in self.open)

    def _invisible(self) -> bool:
        return bool(self.open) and self.open[-1].hidden

    def _item(self) -> tuple[int, int, int] | None:
        """The item that the innermost open ``li`` stands for."""
        return next((f.item for f in reversed(self.open) if f.tag == "li"), None)

    def _edge(self, tag: str) -> None:
        """A block element begins or ends. Within a list item that is a line break, not another item."""
        if self._item() and tag not in ("li", "ul", "ol"):
            if self.parts and not self.parts[-1].endswith("\n"):
                self.parts.append("\n")
        else:
            self.flush()

    def flush(self) -> None:
        raw = "".join(self.parts)
        spans = self.links + [(a.target, a.start, len(raw), False) for a in self.anchors]
        lead, text = len(raw) - len(raw.lstrip()), raw.strip()
        clip = lambda k: min(max(k - lead, 0), len(text))
        links = [(target, clip(a), clip(b), text[clip(a) : clip(b)]) for target, a, b, closed in spans if closed or clip(a) < clip(b)]
        if text or links:
            first = self.first_line if text else self.link_line
            block = Block(text, first, self.last_line if text else first, links=links)
            if self.tables:
                t = self.tables[-1]
                block.table, block.row, block.column = t.number, max(t.row, 1), max(t.column, 1)
                block.column_span, block.row_span = t.spans
            if item := self._item():
                block.list_id, block.list_depth, block.item_index = item
                block.list_item = True
            self.blocks.append(block)
        self.parts, self.links = [], []
        for a in self.anchors:
            a.start, a.fresh = 0, False

    # events

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        given = {k: v or "" for k, v in attrs}
        style = re.sub(r"\s+", "", given.get("style", "")).lower()
        item = None
        hidden = self._invisible() or tag in HIDDEN or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
        if not hidden:
            if tag in BLOCKS:
                self._edge(tag)
            if tag == "br":
                self.parts.append("\n")
            elif tag == "table":
                self.n_tables += 1
                self.tables.append(Table(self.n_tables))
            elif tag == "tr" and self.tables:
                self.tables[-1].next_row()
            elif tag in ("td", "th") and self.tables:
                self.tables[-1].next_cell(self._span(given, "colspan"), self._span(given, "rowspan"))
            elif tag in ("ul", "ol"):
                self.n_lists += 1
                self.lists.append([self.n_lists, 0])
            elif tag == "li":
                if not self.lists:  # an item of no list is a list of its own
                    self.n_lists += 1
                number, before = self.lists[-1] if self.lists else (self.n_lists, 0)
                item = number, max(1, len(self.lists)), before + 1
                if self.lists:
                    self.lists[-1][1] += 1
            elif tag == "a" and given.get("href", "").strip() and not UNREADABLE.search(given["href"]):
                self.anchors.append(Anchor(given["href"].strip(), self._length(), self.getpos()[0]))
                self.link_line = self.link_line if self.links else self.getpos()[0]
            elif tag == "img":
                for a in self.anchors:
                    a.fresh = True
        if tag not in VOID:
            self.open.append(Frame(tag, hidden, item))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k].tag == tag), None)
        if at is None:
            return
        hidden = self.open[at].hidden
        if not hidden:
            if tag in BLOCKS:
                self._edge(tag)
            if tag == "table" and self.tables:
                self.tables.pop()
            elif tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            elif tag == "a" and self.anchors:
                a, end = self.anchors.pop(), self._length()
                if a.worth(end):
                    self.links.append((a.target, a.start, end, True))
        del self.open[at:]

    def handle_data(self, data: str) -> None:
        if self._invisible():
            return
        line = self.getpos()[0]
        if not self._pre():
            data = re.sub(r"[ \t\n\r\f]+", " ", data)
            if data.startswith(" ") and (not self.parts or self.parts[-1][-1:].isspace()):
                data = data[1:]
        if not data:
            return
        if not "".join(self.parts).strip():
            self.first_line = line
        self.last_line = line + (data.count("\n") if self._pre() else 0)
        self.parts.append(data)

    @staticmethod
    def _span(given: dict[str, str], name: str) -> int:
        value = given.get(name, "1").strip() or "1"
        if not value.isdigit() or not 1 <= int(value) <= MOST_SPAN:
            raise ValueError(f"{name} must be from 1 to {MOST_SPAN}")
        return int(value)


def visible_blocks(html: str) -> list[Block]:
    parser = VisibleText()
    parser.feed(html)
    parser.close()
    if not parser.tags:
        raise ValueError("no HTML element")
    parser.flush()
    return parser.blocks


LINK = ("target", "text_start", "text_end", "text")


def _parse(html: str | None) -> tuple[list[tuple], str | None]:
    if html is None:
        return [], "no content"
    try:
        found = visible_blocks(html)
    except (ValueError, AssertionError) as error:
        return [], str(error)
    return [(k + 1, b.text, b.line_start, b.line_end, b.table, b.row, b.column, b.column_span, b.row_span, b.list_id, b.list_depth, b.item_index, b.list_item, [dict(zip(LINK, x, strict=True)) for x in b.links]) for k, b in enumerate(found)], None


def html_blocks(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per visible block: the columns ``keep``, seq, text, its place, links and, for pages that can't be read, a row with ``error``."""
    keep = keep or [c for c in pages.columns if c != html]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            parsed = [_parse(x.as_py()) for x in batch.column(len(keep))]
            places, blocks, errors = [], [], []
            for k, (found, error) in enumerate(parsed):
                places += [k] * max(1, len(found))
                blocks += found or [None]
                errors += [error] * max(1, len(found))
            fields = {n: pa.array([None if b is None else b[i] for b in blocks], t) for i, (n, t) in enumerate(types)}
            columns = [batch.column(i).take(pa.array(places, pa.int64())) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, *fields.values(), pa.array(errors, pa.string())], names=[*keep, *fields, "error"])

    import pyarrow as pa

    whole = ["line_start", "line_end", "table", "row", "column", "column_span", "row_span", "list_id", "list_depth", "item_index"]
    link = pa.list_(pa.struct([("target", pa.string()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("text", pa.string())]))
    types = [("seq", pa.int32()), ("text", pa.string()), *((n, pa.int32()) for n in whole), ("list_item", pa.bool_()), ("links", link)]
    types_sql = ", ".join(["seq int", "text string", *(f"`{n}` int" for n in whole), "list_item boolean", "links array<struct<target:string,text_start:int,text_end:int,text:string>>", "error string"])
    rows = pages.select(*keep, F.col(html).alias("_html"))
    inner = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    out = rows.mapInArrow(run, f"{inner}, {types_sql}")
    return out.filter("seq is not null or error is not null")

