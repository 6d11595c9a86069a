"""Does an extracted text hold an expected one? Wrapping is tolerated, changed values are not.

The expected text is read as its visible characters ("ink") and the joint before each.
A joint's kind follows from the characters beside it, and a table says which passages a
text may show there: nothing, white space, a line break, a hyphen and a line break. A
text is walked from each place where the first character stands; at every joint
there is only one way on, so a walk never turns back.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F, types as Y

from .values import normalize

# What counts as an address, as a letter of a word, and as a script without spaces.
URL_TEXT = re.compile(r"(?:https?://|www\.|[a-z0-9][a-z0-9.-]*\.[a-z]{2,}/)\S+", re.I)
WORD = re.compile(r"[A-Za-z0-9_À-ɏḀ-ỿ]")
UNSPACED = ("CJK ", "HIRAGANA ", "KATAKANA ", "HANGUL ")
SIGNS, DASHES, CLOSING_QUOTES = "+-−–—.", "–—", "’”"

TIGHT, SPACE, BREAK, HYPHEN = "nothing", "white space", "line break", "hyphen and line break"
#: Passages that a text may show at each kind of joint. A line break counts as white space too.
PASSAGES = {
    "gap": {SPACE},
    "loose gap": {TIGHT, SPACE},
    "address": {TIGHT, BREAK},
    "word": {TIGHT, HYPHEN},
    "after a hyphen": {TIGHT, BREAK},
    "unspaced": {TIGHT, SPACE},
    "other": {TIGHT},
}
ONE_BREAK = re.compile(r"[ \t]*\n[ \t]*")


@lru_cache(maxsize=4096)
def script(char: str) -> str:
    name = unicodedata.name(char, "")
    return "latin" if name.startswith("LATIN ") else "unspaced" if name.startswith(UNSPACED) else ""


@dataclass(frozen=True)
class Joint:
    """The places around a joint: the visible characters beside it, and the words if a gap is between."""

    before: str
    after: str
    second: str  # the character before ``before``, or ""
    words: tuple[str, str] | None
    in_address: bool

    def scripts(self) -> set[str]:
        return {script(self.before), script(self.after)}

    def initials(self) -> bool:
        return all(len(w) == 1 and w.isupper() and script(w) == "latin" for w in self.words)


#: The first rule that holds names the joint.
GAPS: list[tuple[str, Callable[[Joint], bool]]] = [
    ("loose gap", lambda j: "unspaced" in j.scripts()),
    ("loose gap", lambda j: j.before in DASHES or j.after in DASHES or j.before in CLOSING_QUOTES),
    ("loose gap", Joint.initials),
    ("gap", lambda j: True),
]
JOINTS: list[tuple[str, Callable[[Joint], bool]]] = [
    ("address", lambda j: j.in_address),
    ("word", lambda j: j.scripts() == {"latin"}),
    ("after a hyphen", lambda j: j.before == "-" and script(j.after) == "latin" and bool(j.second) and script(j.second) == "latin"),
    ("unspaced", lambda j: "unspaced" in j.scripts()),
    ("other", lambda j: True),
]


def _number(text: str) -> bool:
    unsigned = text[1:] if text[0] in "+-−" else text
    return unsigned[:1].isdecimal() or (unsigned[:1] == "." and unsigned[1:2].isdecimal())


@dataclass(frozen=True)
class Expected:
    ink: str
    allowed: tuple[frozenset[str], ...]  # passages before each character but the first
    starts: frozenset[str]
    ends: frozenset[str]

    @classmethod
    @lru_cache(maxsize=10_000)
    def of(cls, value: str) -> Expected:
        words = normalize(value).split()
        text = " ".join(words)
        if not text:
            return cls("", (), frozenset(), frozenset())
        addresses = {k for m in URL_TEXT.finditer(text) for k in range(m.start() + 1, m.end())}
        allowed, nth = [], 0
        for k in range(1, len(text)):
            if text[k] == " ":
                nth += 1
                continue
            gap = text[k - 1] == " "
            second = text[k - 2] if k > 1 and not gap else ""
            joint = Joint(text[k - 2] if gap else text[k - 1], text[k], "" if second == " " else second, (words[nth - 1], words[nth]) if gap else None, k in addresses)
            kind = next(name for name, holds in (GAPS if gap else JOINTS) if holds(joint))
            allowed.append(frozenset(PASSAGES[kind]))
        starts = {"number"} if _number(text) else set()
        starts |= {"word"} if starts or script(text[0]) == "latin" else set()
        last = text[-1]
        if last.isdecimal():
            ends = {"word", "decimals"}
        elif script(last) == "latin":
            ends = {"word"}
        else:
            ends = {"digit"} if last in ".," and text[-2:-1].isdecimal() else set()
        return cls("".join(words), tuple(allowed), frozenset(starts), frozenset(ends))


#: What may not stand beside a place, by what the expected text begins or ends with.
LEFT: dict[str, Callable[[str, int], bool]] = {
    "word": lambda t, k: bool(k and WORD.match(t[k - 1])),
    # 3 is not found in -3, .3 or 1,003
    "number": lambda t, k: bool(k) and (t[k - 1] in SIGNS or (t[k - 1] == "," and t[k - 2 : k - 1].isdecimal())),
}
RIGHT: dict[str, Callable[[str, int], bool]] = {
    "word": lambda t, k: bool(WORD.match(t[k : k + 1] or " ")),
    "decimals": lambda t, k: t[k : k + 1] in (".", ",") and t[k + 1 : k + 2].isdecimal(),
    "digit": lambda t, k: t[k : k + 1].isdecimal(),
}


def _passage(text: str, at: int, char: str) -> tuple[set[str], int]:
    """What stands between ``at`` and the next visible character, and where that is."""
    if text[at : at + 1] == char:
        return {TIGHT}, at
    hyphen = text[at : at + 1] == "-"
    low = at + hyphen
    high = low
    while high < len(text) and text[high].isspace():
        high += 1
    if high == low:
        return set(), high
    broken = ONE_BREAK.fullmatch(text, low, high) is not None
    if hyphen:
        return {HYPHEN} if broken else set(), high
    return {SPACE, BREAK} if broken else {SPACE}, high


def _end(want: Expected, text: str, start: int) -> int | None:
    """Where the expected text ends if it stands at ``start``."""
    if any(LEFT[x](text, start) for x in want.starts):
        return None
    at = start + 1
    for char, allowed in zip(want.ink[1:], want.allowed, strict=True):
        seen, at = _passage(text, at, char)
        if not seen & allowed or text[at : at + 1] != char:
            return None
        at += 1
    return None if any(RIGHT[x](text, at) for x in want.ends) else at


def places(value: str, text: str) -> Iterator[tuple[int, int]]:
    """All places of an expected text, from left to right, none overlapping the one before; ``text`` is normalised."""
    want = Expected.of(value)
    at = text.find(want.ink[0]) if want.ink else -1
    while at >= 0:
        end = _end(want, text, at)
        if end is not None:
            yield at, end
        at = text.find(want.ink[0], at + 1 if end is None else end)


def is_present(expected: str, extracted: str) -> bool:
    return not Expected.of(expected).ink or next(places(expected, normalize(extracted)), None) is not None


def missing(expected: list[str], extracted: str) -> list[int]:
    """Numbers of the expected texts for which no place is left; each place serves one of them.

    All places of all texts are one list: those with more ink first, then by the order
    of the texts, then with the fewest line breaks, the shortest, the leftmost. Each text takes
    its first place that overlaps none taken before.
    """
    text = normalize(extracted)
    ink = [len(Expected.of(v).ink) for v in expected]
    offers = sorted((-ink[k], k, sum(c in "\n\f" for c in text[a:b]), b - a, a) for k, v in enumerate(expected) if ink[k] for a, b in places(v, text))
    taken: list[tuple[int, int]] = []
    served = {k for k, n in enumerate(ink) if not n}
    for _, k, _, length, start in offers:
        at = bisect_left(taken, (start, start))
        free = (not at or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= start + length)
        if k not in served and free:
            served.add(k)
            insort(taken, (start, start + length))
    return [k for k in range(len(expected)) if k not in served]


@F.pandas_udf(Y.BooleanType())
def text_is_present(expected: pd.Series, extracted: pd.Series) -> pd.Series:
    return pd.Series([None if e is None or t is None else is_present(e, t) for e, t in zip(expected, extracted, strict=True)], dtype="object")


@F.pandas_udf(Y.ArrayType(Y.IntegerType()))
def missing_texts(expected: pd.Series, extracted: pd.Series) -> pd.Series:
    return pd.Series([missing(list(e), t or "") if e is not None else None for e, t in zip(expected, extracted, strict=True)])
