"""Profiles: visible fields in order, and the rules they must meet - all breaches, not just the first."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as Y

from ..functions import text as T, values as X, vocabulary as V

# Known keys.
TOP_KEYS = {"language", "role", "name", "headline", "contacts", "facts_confirmed", "sections", "example_notice"}
SECTION_KEYS, ENTRY_KEYS = {"id", "title", "entries"}, {"heading", "date", "bullets"}

ENTRY = Y.StructType([Y.StructField("heading", Y.StringType()), Y.StructField("date", Y.StringType()), Y.StructField("bullets", Y.ArrayType(Y.StringType()))])
SECTION = Y.StructType([Y.StructField("id", Y.StringType()), Y.StructField("title", Y.StringType()), Y.StructField("entries", Y.ArrayType(ENTRY))])
PROFILE = Y.StructType(
    [Y.StructField(k, Y.StringType()) for k in ("language", "role", "name", "headline")]
    + [Y.StructField("contacts", Y.ArrayType(Y.StringType())), Y.StructField("facts_confirmed", Y.BooleanType()), Y.StructField("sections", Y.ArrayType(SECTION)), Y.StructField("example_notice", Y.StringType())]
)


def fields(profile: dict) -> Iterator[tuple[str, str]]:
    """(path, value) of what a reader sees; sections without entries show nothing, headings and dates always count."""
    yield "name", profile["name"]
    yield "headline", profile["headline"]
    yield from ((f"contacts[{k}]", c) for k, c in enumerate(profile["contacts"]))
    for s, section in enumerate(profile["sections"]):
        if section["entries"]:
            yield f"sections[{s}].title", section["title"]
        for e, entry in enumerate(section["entries"]):
            at = f"sections[{s}].entries[{e}]"
            yield f"{at}.heading", entry.get("heading", "")
            yield f"{at}.date", entry.get("date", "")
            yield from ((f"{at}.bullets[{b}]", x) for b, x in enumerate(entry.get("bullets", [])))


def visible_fields(profiles: DataFrame, profile: str = "profile", keep: list[str] | None = None) -> DataFrame:
    """One row per visible field of PROFILE structs: the columns ``keep``, ord, path, value. Arrays only, no shuffle."""
    keep = keep or [c for c in profiles.columns if c != profile]
    p = F.col(profile)
    pair = lambda path, value: F.struct(path.alias("path"), F.coalesce(value, F.lit("")).alias("value"))

    def numbered(head: Column, items: Column) -> Column:
        return F.transform(F.coalesce(items, F.array()), lambda x, k: pair(F.concat(head, F.lit("["), k.cast("string"), F.lit("]")), x))

    def entry(at: Column, e: Column) -> Column:
        return F.concat(F.array(pair(F.concat(at, F.lit(".heading")), e["heading"]), pair(F.concat(at, F.lit(".date")), e["date"])), numbered(F.concat(at, F.lit(".bullets")), e["bullets"]))

    def section(s: Column, k: Column) -> Column:
        at = F.concat(F.lit("sections["), k.cast("string"), F.lit("]"))
        entries = F.flatten(F.transform(s["entries"], lambda e, n: entry(F.concat(at, F.lit(".entries["), n.cast("string"), F.lit("]")), e)))
        return F.when(F.size(s["entries"]) > 0, F.concat(F.array(pair(F.concat(at, F.lit(".title")), s["title"])), entries)).otherwise(F.array().cast("array<struct<path:string,value:string>>"))

    head = F.array(pair(F.lit("name"), p["name"]), pair(F.lit("headline"), p["headline"]))
    everything = F.concat(head, numbered(F.lit("contacts"), p["contacts"]), F.flatten(F.transform(F.coalesce(p["sections"], F.array().cast(Y.ArrayType(SECTION))), section)))
    return profiles.select(*keep, F.posexplode_outer(everything).alias("ord", "f")).filter("ord is not null").select(*keep, "ord", "f.path", "f.value")


class Check:
    """Collects breaches with their path, in the order of the rules."""

    def __init__(self) -> None:
        self.found: list[tuple[str, str]] = []

    def need(self, good: bool, path: str, rule: str) -> bool:
        if not good:
            self.found.append((path, rule))
        return good

    def closed(self, value, allowed: set[str], path: str) -> bool:
        if not self.need(isinstance(value, dict), path, "must be an object"):
            return False
        for key in value:
            self.need(key in allowed, f"{path}.{key}" if path else key, "unknown field")
        return True

    def text(self, value, path: str, empty: bool = True) -> bool:
        if not self.need(isinstance(value, str) and (empty or bool(value.strip())), path, "must be a string" if empty else "must be a non-empty string"):
            return False
        return self.need(not any(ord(c) < 32 and c not in "\r\n\t" for c in value), path, "unsupported control characters")

    def items(self, value, path: str) -> list:
        return value if self.need(isinstance(value, list), path, "must be a list") else []


def breaches(profile, draft: bool) -> list[tuple[str, str]]:
    """(path, rule) of every rule a profile breaks; drafts may lack a name, contacts and confirmation."""
    c = Check()
    if not c.closed(profile, TOP_KEYS, ""):
        return c.found
    if "role" in profile and c.text(profile["role"], "role", empty=False):
        c.need(profile["role"] in V.ROLE_TEMPLATES, "role", "must be a known role")
    if "example_notice" in profile:
        c.text(profile["example_notice"], "example_notice")
    c.need(profile.get("language") in ("zh", "en"), "language", "must be zh or en")
    c.text(profile.get("name"), "name", empty=draft)
    c.text(profile.get("headline"), "headline")
    c.need(type(profile.get("facts_confirmed")) is bool, "facts_confirmed", "must be true or false")
    contacts = c.items(profile.get("contacts"), "contacts")
    c.need(draft or bool(contacts), "contacts", "at least one contact")
    for k, x in enumerate(contacts):
        c.text(x, f"contacts[{k}]", empty=False)
    sections = c.items(profile.get("sections"), "sections")
    c.need(bool(sections), "sections", "must be a non-empty list")
    ids: set[str] = set()
    bullets = sum([_section(c, s, f"sections[{k}]", ids) for k, s in enumerate(sections)])
    if not draft and not c.found:
        c.need(profile["facts_confirmed"], "facts_confirmed", "facts not confirmed")
        c.need(bool(bullets), "sections", "no content")
        for path, value in fields(profile):
            c.need(not has_placeholder(value), path, "unresolved placeholder")
    return c.found


ROLE_MARKERS = sorted({m for template in V.ROLE_TEMPLATES.values() for m in re.findall("【[^】]*】", template[3])})
PLACEHOLDER = re.compile(V.PLACEHOLDER, re.I)


def has_placeholder(value: str) -> bool:
    return bool(PLACEHOLDER.search(value)) or any(m in value for m in ROLE_MARKERS)


def placeholder_in(value: Column | str) -> Column:
    """``has_placeholder`` as a column."""
    v = T.col(value)
    marked = [F.contains(v, F.lit(m)) for m in ROLE_MARKERS]
    out = T.found(v, V.PLACEHOLDER)
    for m in marked:
        out = out | m
    return out


def skeleton(role: str, language: str) -> dict:
    """An empty profile with a role's sections."""
    sections = [{"id": key, "title": V.SECTION_TITLES[key][language == "en"], "entries": []} for key in V.ROLE_TEMPLATES[role][2]]
    return {"language": language, "role": role, "name": "", "headline": "", "contacts": [], "facts_confirmed": False, "sections": sections}


def _section(c: Check, section, path: str, ids: set[str]) -> int:
    if not c.closed(section, SECTION_KEYS, path):
        return 0
    if c.text(section.get("id"), f"{path}.id", empty=False):
        c.need(section["id"] not in ids, f"{path}.id", "duplicate section id")
        ids.add(section["id"])
    c.text(section.get("title"), f"{path}.title", empty=False)
    return sum([_entry(c, e, f"{path}.entries[{k}]") for k, e in enumerate(c.items(section.get("entries"), f"{path}.entries"))])


def _entry(c: Check, entry, path: str) -> int:
    if not c.closed(entry, ENTRY_KEYS, path):
        return 0
    for key in ("heading", "date"):
        c.text(entry.get(key, ""), f"{path}.{key}")
    bullets = c.items(entry.get("bullets", []), f"{path}.bullets")
    for k, b in enumerate(bullets):
        c.text(b, f"{path}.bullets[{k}]", empty=False)
    heading = entry.get("heading", "")
    c.need(bool(bullets) or isinstance(heading, str) and bool(heading.strip()), path, "must have a heading or bullets")
    return len(bullets)


BREACHES = Y.ArrayType(X.record(ord=Y.IntegerType(), path=Y.StringType(), rule=Y.StringType()))


def _judge(text: str | None, draft: bool) -> list[dict]:
    try:
        found = breaches(X.strict_json(text or ""), draft)
    except ValueError as error:
        found = [("", f"not strict JSON: {error}")]
    return [{"ord": k, "path": p, "rule": r} for k, (p, r) in enumerate(found)]


@F.pandas_udf(BREACHES)
def profile_breaches(profile: pd.Series, draft: pd.Series) -> pd.Series:
    return pd.Series([_judge(t, bool(d)) for t, d in zip(profile, draft, strict=True)])


def validate(profiles: DataFrame, profile: str = "profile", draft: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per broken rule of profiles in JSON text: the columns ``keep``, ord, path, rule."""
    keep = keep or [c for c in profiles.columns if c != profile]
    found = profile_breaches(F.col(profile), F.lit(False) if draft is None else draft)
    return profiles.select(*keep, F.explode(found).alias("b")).select(*keep, "b.*")


def as_struct(profile: Column | str) -> Column:
    """A profile's JSON text as a PROFILE struct, for ``visible_fields``; validate it first."""
    return F.from_json(T.col(profile), PROFILE)


def dumps(profile: dict) -> str:
    return json.dumps(profile, ensure_ascii=False)
