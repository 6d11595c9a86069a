"""Width and height from the headers of PNG, JPEG and TIFF images."""

from __future__ import annotations

import struct

from .package import ReadError

MOST_SIDE, MOST_PIXELS = 10_000, 40_000_000
# JPEG markers that start a frame, and those without a length.
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
BARE = {0x01, *range(0xD0, 0xDA)}


def _png(raw: bytes) -> tuple[int, int, bool]:
    if raw[12:16] != b"IHDR":
        raise ReadError("a PNG without a header")
    return *struct.unpack(">II", raw[16:24]), False


def _jpeg(raw: bytes) -> tuple[int, int, bool]:
    at = 2
    while at + 9 < len(raw):
        if raw[at] != 0xFF:
            raise ReadError("a JPEG out of step")
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker in BARE:
            at += 2
        elif marker in FRAMES:
            height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
            return width, height, False
        else:
            at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
    raise ReadError("a JPEG without a frame")


def _tiff(raw: bytes) -> tuple[int, int, bool]:
    order = "<" if raw[:2] == b"II" else ">"
    read = lambda fmt, at: struct.unpack(order + fmt, raw[at : at + struct.calcsize(fmt)])[0]
    at = read("I", 4)
    n = read("H", at)
    found = {}
    for k in range(n):
        entry = at + 2 + 12 * k
        tag, kind = read("H", entry), read("H", entry + 2)
        if tag in (256, 257):
            found[tag] = read("H" if kind == 3 else "I", entry + 8)
    if len(found) < 2:
        raise ReadError("a TIFF without dimensions")
    return found[256], found[257], read("I", at + 2 + 12 * n) != 0


def dimensions(raw: bytes) -> tuple[int, int, bool]:
    """(width, height, several pages) by what the bytes are, not by the file's name."""
    kinds = {b"\x89PNG\r\n\x1a\n": _png, b"\xff\xd8": _jpeg, b"II*\0": _tiff, b"MM\0*": _tiff}
    read = next((f for mark, f in kinds.items() if raw.startswith(mark)), None)
    if read is None:
        raise ReadError("not a PNG, JPEG or TIFF image")
    try:
        width, height, several = read(raw)
    except (struct.error, IndexError) as error:
        raise ReadError("a truncated image") from error
    if not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE and width * height <= MOST_PIXELS):
        raise ReadError("the image's dimensions exceed the limits")
    return width, height, several
