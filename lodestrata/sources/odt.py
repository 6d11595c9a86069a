"""OpenDocument text: paragraphs, headings, nested lists and tables."""

from __future__ import annotations

from xml.etree.ElementTree import Element

from .block import Extraction, safe_target
from .package import Package, ReadError

# Namespaces.
T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
TB = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
O = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"  # noqa: E741
X = "{http://www.w3.org/1999/xlink}"
XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
SKIPPED = {T + "tracked-changes", T + "note", O + "annotation", T + "bookmark"}
MOST_REPEAT, MOST_SPACES = 1000, 10_000


def _count(node: Element, name: str, most: int) -> int:
    try:
        n = int(node.get(name, "1"))
    except ValueError:
        n = 0
    if not 1 <= n <= most:
        raise ReadError("a repeat or span is out of bounds")
    return n


class Reader:
    def __init__(self, out: Extraction):
        self.out = out
        self.paragraph = self.lists = self.tables = 0

    def content(self, node: Element, links: list[dict], text: str = "") -> str:
        """A paragraph's text so far and the node's own, links by position."""
        text += node.text or ""
        for c in node:
            if c.tag == T + "s":
                text += " " * _count(c, T + "c", MOST_SPACES)
            elif c.tag == T + "tab":
                text += "\t"
            elif c.tag == T + "line-break":
                text += "\n"
            elif c.tag in SKIPPED:
                self.out.warn("notes and comments were left out")
            elif c.tag == T + "a":
                start = len(text)
                text = self.content(c, links, text)
                if safe_target(c.get(X + "href")):
                    links.append({"target": c.get(X + "href"), "text_start": start, "text_end": len(text), "text": text[start:]})
            else:
                text = self.content(c, links, text)
            text += c.tail or ""
        return text

    def walk(self, node: Element, place: dict) -> list[dict]:
        if node.tag in (T + "p", T + "h"):
            return self.read_paragraph(node, place)
        if node.tag == T + "list":
            return self.read_list(node, place)
        if node.tag == TB + "table":
            return self.read_table(node, place)
        if node.tag == T + "tracked-changes":
            self.out.warn("deleted text was left out")
            return []
        return [b for c in node for b in self.walk(c, place)]

    def read_paragraph(self, node: Element, place: dict) -> list[dict]:
        self.paragraph += 1
        links: list[dict] = []
        text = self.content(node, links)
        block = self.out.add(f"odt/content.xml/p{self.paragraph}", text, {"part": "content.xml", "paragraph": self.paragraph} | place, links, empty=bool(links))
        return [block] if block else []

    def read_list(self, node: Element, place: dict) -> list[dict]:
        self.lists += 1
        here = {"list_id": node.get(XML_ID) or f"list-{self.lists}", "list_depth": place.get("list_depth", 0) + 1}
        found = []
        for k, item in enumerate((x for x in node if x.tag in (T + "list-item", T + "list-header")), 1):
            own = place | here | {"list_item": True, "item_index": k, "list_item_id": f"{here['list_id']}/{k}"}
            found += [b for c in item for b in self.walk(c, own)]
        return found

    def _rows(self, node: Element) -> list[Element]:
        return [r for c in node for r in ([c] if c.tag == TB + "table-row" else self._rows(c) if c.tag in (TB + "table-header-rows", TB + "table-rows", TB + "table-row-group") else [])]

    def read_table(self, node: Element, place: dict) -> list[dict]:
        self.out.warn("the reading order of table cells needs review")
        self.tables += 1
        number, found, r = self.tables, [], 1
        parent = {k: place[k] for k in ("table", "row", "column", "row_span", "column_span") if k in place}
        for row in self._rows(node):
            column = 1
            for cell in (c for c in row if c.tag in (TB + "table-cell", TB + "covered-table-cell")):
                own = {"table": number, "row": r, "column": column, "row_span": _count(cell, TB + "number-rows-spanned", MOST_REPEAT), "column_span": _count(cell, TB + "number-columns-spanned", MOST_REPEAT)}
                own |= {"parent_cell": parent} if parent else {}
                if cell.tag == TB + "covered-table-cell":
                    own["merge_continuation"] = True
                blocks = [b for c in cell for b in self.walk(c, place | own)]
                self.out.cells.append(own | {"block_ids": [b["block_id"] for b in blocks]})
                found += blocks
                column += _count(cell, TB + "number-columns-repeated", MOST_REPEAT)
            r += _count(row, TB + "number-rows-repeated", MOST_REPEAT)
        return found


def read_odt(raw: bytes, out: Extraction) -> None:
    out.method = "odt-zip-xml"
    package = Package(raw)
    if "mimetype" not in package.names or package.bytes("mimetype").strip() != b"application/vnd.oasis.opendocument.text":
        raise ReadError("not an OpenDocument text")
    body = package.xml("content.xml").find(f"{O}body/{O}text")
    if body is None:
        raise ReadError("no document body")
    Reader(out).walk(body, {})
