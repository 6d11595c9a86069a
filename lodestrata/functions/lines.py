"""Predicates on single lines, in Python, for the order-dependent classifier."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote, urlsplit

from . import vocabulary as V

EMAIL, URL = re.compile(V.EMAIL, re.I), re.compile(V.URL, re.I)
PHONE = re.compile(V.PHONE)
NAME_LABEL = re.compile(V.NAME_LABEL, re.I)
DATE_SPAN = re.compile(V.DATE_SPAN, re.I)
DATE_CUE = re.compile(V.DATE_CUE, re.I)
CUE_BEFORE, CUE_AFTER = re.compile(V.DATE_CUE_ZH_BEFORE), re.compile(V.DATE_CUE_ZH_AFTER)
BULLET = re.compile(V.BULLET, re.S)
EXTRA = re.compile(V.EXTRA_HEADING, re.I)
NOT_A_NAME = re.compile(V.NOT_A_NAME, re.I)
RISK = re.compile(V.LAYOUT_RISK, re.I)
EDGES = " |/–—-\t"


def _ornament(char: str, leading: bool) -> bool:
    return unicodedata.category(char)[0] in "PSZ" or char.isspace() or (leading and 0xE000 <= ord(char) <= 0xF8FF)


def heading_key(value: str) -> str | None:
    t = value.strip()
    start = next((k for k, c in enumerate(t) if not _ornament(c, True)), len(t))
    end = next((k for k in range(len(t), start, -1) if not _ornament(t[k - 1], False)), start)
    t = re.sub(r"^\d+[.)、]\s*", "", t[start:end])
    return V.SECTION_OF.get(" ".join(t.split()).casefold())


def has_contact(value: str) -> bool:
    return any(p.search(value) for p in (EMAIL, URL, PHONE))


def contact_candidate(value: str) -> bool:
    return len(value) <= 180 and "\n" not in value and has_contact(value)


def extra_heading(value: str) -> bool:
    return bool(EXTRA.fullmatch(value))


def unknown_heading(value: str) -> bool:
    return bool(re.fullmatch(r"#+\s+[^\n]{1,80}", value)) or extra_heading(value)


def labelled_name(value: str) -> bool:
    return bool(NAME_LABEL.fullmatch(value))


def candidate_name(value: str) -> str | None:
    t = value.strip().strip("#* ").strip()
    if label := NAME_LABEL.fullmatch(t):
        name = label[1].strip()
        return name if len(name) <= 100 else None
    if heading_key(t) or extra_heading(t) or has_contact(t) or NOT_A_NAME.search(t):
        return None
    words = t.split()
    latin = 2 <= len(words) <= 4 and all(re.fullmatch(V.LATIN_NAME_WORD, w) for w in words)
    return t if latin or re.fullmatch(V.CJK_NAME, t) else None


def date_header(value: str) -> re.Match | None:
    """The date range, unless the line is a sentence that mentions it."""
    span = DATE_SPAN.search(value)
    if span is None:
        return None
    before, after = value[: span.start()], value[span.end() :]
    open_end = lambda t: t.endswith(("|", "/"))
    if cue := DATE_CUE.search(before):
        rest = before[: cue.start()].strip()
        if rest and not open_end(rest):
            return None
    zh = CUE_BEFORE.search(before)
    if CUE_AFTER.match(after) or (zh and not open_end(before[: zh.start()].rstrip())):
        return None
    return span


def entry_heading(value: str) -> str:
    if span := DATE_SPAN.search(value):
        before = value[: span.start()]
        value = (DATE_CUE.sub("", before) if date_header(value) else before) + value[span.end() :]
    return value.strip(EDGES)


def heading_fragment(value: str) -> bool:
    return not re.search(V.SENTENCE_END, value) or bool(re.search(V.ORGANISATION_END, value, re.I))


def date_key(value: str):
    span = DATE_SPAN.fullmatch(value.strip())
    return tuple(" ".join(x.split()).casefold() for x in span.groups()) if span else value


def layout_risk(warnings: list[str]) -> bool:
    return bool(RISK.search(" ".join(map(str, warnings))))


def link_contact(target: str) -> str | None:
    """Mail or web address that a link leads to, if it is plain and short."""
    t = target.strip()
    if not t or len(t) > 180 or any(unicodedata.category(c) == "Cc" for c in t):
        return None
    try:
        parts = urlsplit(t)
        host = parts.hostname
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme == "mailto":
        mail = unquote(parts.path)
        return mail if EMAIL.fullmatch(mail) else None
    return t if scheme in ("http", "https") and host else None


def linked_contacts(links: list[dict]) -> list[str]:
    return list(dict.fromkeys(c for link in links if (c := link_contact(link["target"]))))


def unexplained(text: str, links: list[dict]) -> str:
    """What a contact line says besides its contacts and the words that label them."""
    left, labels = text, []
    for link in links:
        if not (contact := link_contact(link["target"])):
            continue
        labels += V.LINK_LABELS if link["target"].strip().lower().startswith("http") else V.MAIL_LABELS
        if shown := (link.get("text") or "").strip():
            left = left.replace(shown, "", 1)
        del contact
    for pattern, words in ((EMAIL, V.MAIL_LABELS), (URL, V.LINK_LABELS), (PHONE, V.PHONE_LABELS)):
        if pattern.search(left):
            labels += words
    for pattern in (EMAIL, URL, PHONE):
        left = pattern.sub("", left)
    marks = " \t|·•,;/：:–—-"
    left = left.strip(marks)
    if labels:
        word = "(?:" + "|".join(re.escape(x) for x in sorted(set(labels), key=len, reverse=True)) + ")"
        if re.fullmatch(f"{word}(?:[{re.escape(marks)}]+{word})*", left, re.I):
            return ""
    return left
