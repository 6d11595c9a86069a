"""ZIP packages and their XML parts, with limits that hold before anything is parsed."""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree

MOST_MEMBERS, MOST_BYTES, MOST_PART = 2000, 100 << 20, 20 << 20


class ReadError(ValueError):
    """A source that can't be read, is malformed or too large."""


class Package:
    def __init__(self, raw: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(raw))
        except (zipfile.BadZipFile, OSError) as error:
            raise ReadError(f"not a ZIP package: {error}") from error
        members = self.zip.infolist()
        names = [m.filename for m in members]
        if len(members) > MOST_MEMBERS or sum(m.file_size for m in members) > MOST_BYTES:
            raise ReadError("the package is too large")
        if len(set(names)) < len(names):
            raise ReadError("two members of one name")
        if any(n.startswith(("/", "\\")) or ".." in n.replace("\\", "/").split("/") for n in names):
            raise ReadError("a member's name leaves the package")
        if any(m.flag_bits & 1 for m in members):
            raise ReadError("the package is encrypted")
        self.names = set(names)

    def bytes(self, name: str) -> bytes:
        if name not in self.names:
            raise ReadError(f"{name} is missing")
        if self.zip.getinfo(name).file_size > MOST_PART:
            raise ReadError(f"{name} is too large")
        return self.zip.read(name)

    def xml(self, name: str) -> ElementTree.Element:
        raw = self.bytes(name)
        flat = raw.replace(b"\0", b"").upper()
        if b"<!DOCTYPE" in flat or b"<!ENTITY" in flat:
            raise ReadError(f"{name} declares entities")
        try:
            return ElementTree.fromstring(raw)
        except ElementTree.ParseError as error:
            raise ReadError(f"{name}: {error}") from error

    def relations(self, part: str) -> dict[str, dict[str, str]]:
        """Relation id -> attributes; a part without relations has none."""
        folder, name = posixpath.split(part)
        at = posixpath.join(folder, "_rels", f"{name}.rels")
        return {r.get("Id"): dict(r.attrib) for r in self.xml(at)} if at in self.names else {}
