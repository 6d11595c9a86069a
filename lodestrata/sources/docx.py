"""Word documents: headers, body and footers as paragraphs and table cells."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from xml.etree.ElementTree import Element

from .block import Extraction, safe_target
from .package import Package, ReadError

# Namespaces.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
DEEPEST_STYLE = 128
ON, OFF = ("true", "1", "on"), ("false", "0", "off")
GONE = {W + "del", W + "moveFrom"}


def switch(node: Element | None) -> bool | None:
    """Absent node: off. Absent value: on. An unknown value is neither."""
    if node is None:
        return False
    value = (node.get(W + "val") or "on").casefold()
    return True if value in ON else False if value in OFF else None


def children(node: Element) -> list[Element]:
    """Of alternative content, the first choice with text, else the fallback."""
    if node.tag != MC + "AlternateContent":
        return list(node)
    choices = node.findall(MC + "Choice")
    for c in choices:
        if any(x.tag in (W + "p", W + "t", W + "tbl") for x in c.iter()):
            return [c]
    fallback = node.find(MC + "Fallback")
    return [fallback] if fallback is not None else choices[:1]


class Styles:
    """Style chains by kind; a chain that can't be followed is None."""

    def __init__(self, root: Element | None, out: Extraction):
        self.out = out
        self.known: dict[tuple[str, str], Element | None] = {}
        self.default: dict[str, list[str]] = {"paragraph": [], "character": []}
        self.base: bool | None = False
        self.chains: dict[tuple[str, str], list[Element] | None] = {}
        if root is None:
            return
        for style in root.findall(W + "style"):
            kind, key = style.get(W + "type", "paragraph"), style.get(W + "styleId")
            if not key or kind not in self.default:
                continue
            if (kind, key) in self.known:
                out.warn(f"style {key} is defined twice")
            self.known[kind, key] = None if (kind, key) in self.known else style
            if style.get(W + "default") in ON:
                self.default[kind].append(key)
        vanish = root.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr/{W}vanish")
        self.base = switch(vanish)

    def chain(self, kind: str, key: str | None) -> list[Element] | None:
        """From the style itself to its furthest ancestor."""
        if key is None:
            defaults = self.default[kind]
            if not defaults:
                return []
            if len(defaults) > 1:
                self.out.warn(f"several default {kind} styles")
                return None
            key = defaults[0]
        if (kind, key) not in self.chains:
            self.chains[kind, key] = self._follow(kind, key)
        return self.chains[kind, key]

    def _follow(self, kind: str, key: str) -> list[Element] | None:
        found: list[Element] = []
        seen: set[str] = set()
        at: str | None = key
        while at is not None:
            style = self.known.get((kind, at))
            if style is None or at in seen or len(seen) >= DEEPEST_STYLE:
                self.out.warn(f"style {at} is missing, defined twice or inherits from itself")
                return None
            seen.add(at)
            found.append(style)
            parent = style.find(W + "basedOn")
            at = None if parent is None else parent.get(W + "val", "")
        return found


def _style_name(properties: Element | None, tag: str) -> str | None:
    node = properties.find(W + tag) if properties is not None else None
    return None if node is None else node.get(W + "val", "")


class Visibility:
    """Whether a run is hidden. In styles ``vanish`` toggles what is inherited; on a run it decides. Unknown counts as visible, with a warning."""

    def __init__(self, paragraph: Element, styles: Styles, out: Extraction):
        self.styles, self.out = styles, out
        self.state = self._styled(styles.base, "paragraph", _style_name(paragraph.find(W + "pPr"), "pStyle"))

    def _styled(self, state: bool | None, kind: str, key: str | None) -> bool | None:
        chain = self.styles.chain(kind, key)
        if chain is None:
            return None
        for style in reversed(chain):
            vanish = style.find(f"{W}rPr/{W}vanish")
            if vanish is None or state is None:
                continue
            on = switch(vanish)
            state = None if on is None else state ^ on
        return state

    def hidden(self, run: Element) -> bool:
        properties = run.find(W + "rPr")
        state = self._styled(self.state, "character", _style_name(properties, "rStyle"))
        vanish = properties.find(W + "vanish") if properties is not None else None
        if vanish is not None:
            state = switch(vanish)
        if state is None:
            self.out.warn("hidden text can't be told from visible text; it was kept")
        elif state:
            self.out.warn("hidden text was left out")
        return state is True


def numbering(paragraph: Element, styles: Styles) -> dict:
    """List intent of a paragraph: its own numbering, else its styles', the nearest of each field."""
    direct = paragraph.find(f"{W}pPr/{W}numPr")
    chain = styles.chain("paragraph", _style_name(paragraph.find(W + "pPr"), "pStyle"))
    levels = ([("direct", direct)] if direct is not None else []) + [(f"style:{s.get(W + 'styleId')}", n) for s in chain or [] if (n := s.find(f"{W}pPr/{W}numPr")) is not None]
    values: dict[str, tuple[str | None, str]] = {}
    for origin, node in levels:
        for name in ("numId", "ilvl"):
            item = node.find(W + name)
            if item is not None:
                values.setdefault(name, (item.get(W + "val"), origin))
    num, origin = values.get("numId", (None, ""))
    if num and num.isdigit():
        if int(num) == 0:
            return {"numbered_paragraph": False, "numbering_status": "cancelled", "numbering_source": origin, "num_id": num}
        level = {"numbering_level": values["ilvl"][0]} if "ilvl" in values else {}
        return {"numbered_paragraph": True, "numbering_status": "list", "numbering_source": origin, "num_id": num} | level
    if levels or chain is None:
        return {"numbered_paragraph": direct is not None, "numbering_candidate": True, "numbering_status": "unresolved", "numbering_source": "direct" if direct is not None else "style"}
    return {}


# The switches of a HYPERLINK field that take a value, and the formats that change nothing.
VALUED = {"\\l": "bookmark", "\\o": "tip", "\\t": "window", "\\*": "format"}
FORMATS = ("mergeformat", "charformat")
#: A word, or a text in quotes, in which a backslash stands for a quote; each up to white space.
WORDS = re.compile(r'''\s*(?:"((?:\\"|[^"\\]|\\(?!"))*)"|([^\s"]+))(?=\s|$)''')


def hyperlink(instruction: str) -> str | None:
    """Target of a static HYPERLINK field; anything else is None, and is never evaluated.

    The grammar: HYPERLINK, then in any order one target and valued switches; a bookmark
    at most once, which replaces the target's fragment; an unfinished quote, another switch or
    a value that is empty or looks like a switch is no such field.
    """
    words, at = [], 0
    while m := WORDS.match(instruction, at):
        words.append((m[1].replace('\\"', '"'), True) if m[1] is not None else (m[2], False))
        at = m.end()
    if instruction[at:].strip() or not words or words[0][0].casefold() != "hyperlink":
        return None
    rest = iter(words[1:])
    targets, given = [], {name: [] for name in VALUED.values()}
    for word, quoted in rest:
        if quoted or not word.startswith("\\"):
            targets.append(word)
            continue
        value, in_quotes = next(rest, ("", False))
        if word.casefold() not in VALUED or not value or (value.startswith("\\") and not in_quotes):
            return None
        given[VALUED[word.casefold()]].append(value)
    well_formed = len(targets) <= 1 and all(targets) and len(given["bookmark"]) <= 1 and all(f.casefold() in FORMATS for f in given["format"])
    if not well_formed:
        return None
    target = targets[0] if targets else ""
    if given["bookmark"]:
        target = target.partition("#")[0] + "#" + given["bookmark"][0]
    return target or None


class Content:
    """One walk over a paragraph: its text, its links by position, its text boxes."""

    def __init__(self, relations: dict, visibility: Visibility, out: Extraction):
        self.relations, self.visibility, self.out = relations, visibility, out
        self.text, self.links, self.boxes = "", [], []
        self.field: dict | None = None
        self.nested = 0

    def walk(self, node: Element) -> None:
        tag = node.tag
        if tag in GONE:
            self.out.warn("deleted or moved text was left out")
        elif tag == W + "txbxContent":
            self.boxes.append(node)
        elif tag == W + "r" and self.visibility.hidden(node):
            pass
        elif tag == W + "hyperlink":
            relation = self.relations.get(node.get(R + "id"), {}).get("Target")
            anchor = node.get(W + "anchor")
            self.linked(node, (relation or "") + (f"#{anchor}" if anchor else ""))
        elif tag == W + "fldSimple":
            self.linked(node, hyperlink(node.get(W + "instr", "")))
        elif tag == W + "fldChar":
            self.field_mark(node.get(W + "fldCharType"))
        elif tag == W + "instrText":
            if self.field and self.field["part"] == "code":
                self.field["code"] += node.text or ""
        elif self.field and self.field["part"] == "code" and tag in (W + "t", W + "tab", W + "br", W + "cr", W + "noBreakHyphen"):
            self.out.warn("text inside a field's instruction was left out")
        elif tag == W + "t":
            self.text += node.text or ""
        elif tag == W + "tab":
            self.text += "\t"
        elif tag in (W + "br", W + "cr"):
            self.text += "\n"
        elif tag == W + "noBreakHyphen":
            self.text += "‑"
        else:
            for c in children(node):
                self.walk(c)

    def linked(self, node: Element, target: str | None) -> None:
        start = len(self.text)
        for c in children(node):
            self.walk(c)
        self.add_link(target, start)

    def add_link(self, target: str | None, start: int) -> None:
        if safe_target(target):
            self.links.append({"target": target, "text_start": start, "text_end": len(self.text), "text": self.text[start:]})

    def field_mark(self, kind: str | None) -> None:
        if kind == "begin":
            self.nested += 1
            # a field within a field leaves no target to rely on
            self.field = {"part": "code", "code": "", "start": len(self.text), "good": self.nested == 1} if self.nested == 1 else (self.field or {}) | {"good": False}
        elif kind == "separate" and self.field and self.nested == 1:
            self.field |= {"part": "result", "start": len(self.text)}
        elif kind == "end" and self.nested:
            self.nested -= 1
            if not self.nested and self.field:
                if self.field.get("good") and self.field["part"] == "result":
                    self.add_link(hyperlink(self.field["code"]), self.field["start"])
                self.field = None


def _number(node: Element | None, default: int) -> int:
    try:
        return int(node.get(W + "val", default)) if node is not None else default
    except ValueError:
        raise ReadError("a table span is not a number") from None


class Part:
    """One part of the package, from its paragraphs' numbers to its tables."""

    def __init__(self, document: Document, name: str, region: str):
        self.doc, self.name, self.region = document, name, region
        self.relations = document.package.relations(name)
        self.paragraph = 0

    def walk(self, node: Element, context: dict) -> Iterator[dict]:
        if node.tag in GONE:
            self.doc.out.warn("deleted or moved text was left out")
        elif node.tag == W + "p":
            yield from self.read_paragraph(node, context)
        elif node.tag == W + "tbl":
            yield from self.table(node, context)
        else:
            for c in children(node):
                yield from self.walk(c, context)

    def read_paragraph(self, node: Element, context: dict) -> Iterator[dict]:
        out = self.doc.out
        self.paragraph += 1
        place = {"part": self.name, "region": self.region, "paragraph": self.paragraph} | context | numbering(node, self.doc.styles)
        if place.get("numbered_paragraph") or place.get("numbering_candidate"):
            out.warn("list labels are not part of the text")
        content = Content(self.relations, Visibility(node, self.doc.styles, out), out)
        for c in children(node):
            content.walk(c)
        number = self.paragraph
        if block := out.add(f"docx/{self.name}/p{number}", content.text, place, content.links, empty=bool(content.links)):
            yield block
        for box in content.boxes:
            self.doc.boxes += 1
            out.warn("text boxes are read after their paragraph")
            yield from self.walk(box, context | {"textbox": self.doc.boxes, "anchor_paragraph": number})

    def table(self, node: Element, context: dict) -> Iterator[dict]:
        out = self.doc.out
        out.warn("the reading order of table cells needs review")
        self.doc.tables += 1
        number = self.doc.tables
        parent = {k: context[k] for k in ("table", "row", "column", "column_span", "row_span") if k in context}
        above: dict[int, dict] = {}  # column -> the cell merged downwards there
        for r, row in enumerate(node.findall(W + "tr"), 1):
            if row.find(f"{W}trPr/{W}del") is not None:
                continue
            column = 1 + _number(row.find(f"{W}trPr/{W}gridBefore"), 0)
            below: dict[int, dict] = {}
            grown: set[int] = set()
            for cell in row.findall(W + "tc"):
                width = _number(cell.find(f"{W}tcPr/{W}gridSpan"), 1)
                if not 1 <= width <= 1000 or not 1 <= column <= 10_000:
                    raise ReadError("a table span exceeds the limits")
                columns = range(column, column + width)
                if cell.find(f"{W}tcPr/{W}cellDel") is not None:
                    out.warn("deleted table cells were left out")
                    column += width
                    continue
                merge = cell.find(f"{W}tcPr/{W}vMerge")
                state = None if merge is None else merge.get(W + "val", "continue")
                record = {"table": number, "row": r, "column": column, "column_span": width, "row_span": 1} | ({"parent_cell": parent} if parent else {})
                origin = above.get(column) if state == "continue" else None
                if origin:
                    record["merge_origin"] = [origin["row"], origin["column"]]
                    if origin["column"] not in grown:
                        grown.add(origin["column"])
                        origin["row_span"] += 1
                        for b in origin["blocks"]:
                            b["locator"]["row_span"] = origin["row_span"]
                    below.update(dict.fromkeys(columns, origin))
                elif state == "continue":
                    out.warn("a merged cell continues nothing; it was kept")
                place = {k: v for k, v in context.items() if k in ("textbox", "anchor_paragraph")} | record
                blocks = [b for c in cell if c.tag != W + "tcPr" for b in self.walk(c, place)]
                if not blocks:
                    blocks = [out.add(f"docx/{self.name}/t{number}r{r}c{column}", "", {"part": self.name, "region": self.region} | place, empty=True)]
                record["blocks"] = blocks
                if state == "restart":
                    below.update(dict.fromkeys(columns, record))
                out.cells.append(record)
                column += width
                yield from blocks
            above = below


class Document:
    def __init__(self, raw: bytes, out: Extraction):
        self.package, self.out = Package(raw), out
        self.tables = self.boxes = 0
        if not any(x.get("PartName") == "/word/document.xml" for x in self.package.xml("[Content_Types].xml")):
            raise ReadError("not a word-processing document")
        self.main = self.package.xml("word/document.xml")
        styles = self.package.xml("word/styles.xml") if "word/styles.xml" in self.package.names else None
        self.styles = Styles(styles, out)

    def read(self) -> None:
        body = self.main.find(W + "body")
        if body is None:
            raise ReadError("no document body")
        self._referenced("headerReference", "header")
        list(Part(self, "word/document.xml", "body").walk(body, {}))
        self._referenced("footerReference", "footer")
        for cell in self.out.cells:
            cell["block_ids"] = [b["block_id"] for b in cell.pop("blocks")]

    def _referenced(self, tag: str, region: str) -> None:
        relations = self.package.relations("word/document.xml")
        names = []
        for node in self.main.iter(W + tag):
            r = relations.get(node.get(R + "id"), {})
            if r.get("Target") and r.get("TargetMode") != "External":
                target = r["Target"]
                names.append(target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("word", target)))
        for name in dict.fromkeys(names):
            list(Part(self, name, region).walk(self.package.xml(name), {}))


def read_docx(raw: bytes, out: Extraction) -> None:
    out.method = "docx-zip-xml"
    Document(raw, out).read()
