"""Several sources to one draft and one ledger: paths are re-based, disagreement is kept, nothing is lost."""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field

from ..functions import lines as L, vocabulary as V
from . import profile as P
from .classify import Claim, Organizer


@dataclass
class Ledger:
    profile: dict
    claims: list[dict] = field(default_factory=list)
    remaining: list[dict] = field(default_factory=list)
    conflicts: list[dict] = field(default_factory=list)


def structured(profile: dict, lines: list, language: str) -> tuple[dict, list[Claim], list[tuple[int, str]]]:
    """A profile that came as JSON: each line is matched to its own path, else to all fields of that value."""
    if found := P.breaches(profile, draft=True):
        raise ValueError(f"{found[0][0]}: {found[0][1]}")
    profile = copy.deepcopy(profile) | {"facts_confirmed": False, "language": language}
    visible = dict(P.fields(profile))
    claims, remaining = [], []
    for line in lines:
        own = line.locator.get("json_path") or line.locator.get("path")
        paths = [own] if own in visible else [p for p, v in visible.items() if v == line.text]
        claims.append(Claim(line, "structured_source" if paths else "source_metadata", paths))
        if not paths:
            remaining.append((len(claims) - 1, "source_metadata_preserved"))
    return profile, claims, remaining


class Assembler:
    """``parts`` are (source_id, profile, claims, remaining) in order."""

    def __init__(self, parts: list[tuple[str, dict, list[Claim], list[tuple[int, str]]]], language: str, role: str | None = None):
        self.parts, self.language = parts, language
        self.ledger = Ledger({"language": language, "name": "", "headline": "", "contacts": [], "facts_confirmed": False, "sections": []})
        self.out = self.ledger.profile
        alone = parts[0][1] if len(parts) == 1 else {}
        if role or "role" in alone:
            self.out["role"] = role or alone["role"]
        if "example_notice" in alone:
            self.out["example_notice"] = alone["example_notice"]
        self.candidates = {k: list(dict.fromkeys(p[k] for _, p, _, _ in parts if p[k])) for k in ("name", "headline")}
        self.dated: dict[str, list[tuple[str, str]]] = {}

    def run(self) -> Ledger:
        for key, values in self.candidates.items():
            if len(values) == 1:
                self.out[key] = values[0]
        for number, part in enumerate(self.parts):
            self._add(number, *part)
        self._conflicts()
        if not self.out["sections"]:
            self.out["sections"].append({"id": "unclassified", "title": V.UNCLASSIFIED_TITLES[self.language == "en"], "entries": []})
        return self.ledger

    def _free_id(self, wanted: str) -> str:
        taken = {s["id"] for s in self.out["sections"]}
        if wanted not in taken:
            return wanted
        n = 2
        while f"{wanted}-{n}" in taken:
            n += 1
        return f"{wanted}-{n}"

    def _add(self, number: int, source_id: str, profile: dict, claims: list[Claim], remaining: list[tuple[int, str]]) -> None:
        shift = len(self.out["sections"])
        contacts = self.out["contacts"]
        contacts += [c for c in dict.fromkeys(profile["contacts"]) if c not in contacts]
        moved = {f"contacts[{k}]": f"contacts[{contacts.index(c)}]" for k, c in enumerate(profile["contacts"])}
        for section in copy.deepcopy(profile["sections"]):
            section["id"] = self._free_id(section["id"])
            self.out["sections"].append(section)
            for e, entry in enumerate(section["entries"]):
                if entry.get("heading") and entry.get("date"):
                    key = " ".join(entry["heading"].casefold().split())
                    self.dated.setdefault(key, []).append((entry["date"], f"sections[{len(self.out['sections']) - 1}].entries[{e}].date"))
        first = len(self.ledger.claims)
        for claim in claims:
            paths = [self._rebase(p, shift, moved, number, claim) for p in claim.paths]
            self.ledger.claims.append({"id": f"claim-{len(self.ledger.claims) + 1:06d}", "source_id": source_id, "text": claim.line.raw, "block_id": claim.line.block_id, "locator": claim.line.locator, "resume_paths": paths, "original_paths": claim.paths, "status": "source_only", "interpretation": claim.interpretation, "needs_review": True})
        for k, reason in remaining:
            own = self.ledger.claims[first + k]
            self.ledger.remaining.append({"fact_id": own["id"], "text": own["text"], "reason": reason})

    def _rebase(self, path: str, shift: int, moved: dict[str, str], number: int, claim: Claim) -> str:
        if path in moved:
            return moved[path]
        if path in self.candidates and len(self.candidates[path]) > 1:
            # no candidate is chosen, each stays readable
            sections = self.out["sections"]
            sections.append({"id": f"candidate-{number + 1}-{len(sections)}", "title": V.CONFLICT_TITLES[self.language == "en"], "entries": [{"bullets": [claim.line.raw]}]})
            return f"sections[{len(sections) - 1}].entries[0].bullets[0]"
        return re.sub(r"^sections\[(\d+)\]", lambda m: f"sections[{int(m[1]) + shift}]", path)

    def _conflicts(self) -> None:
        for key, values in self.candidates.items():
            if len(values) > 1:
                ids = [c["id"] for c in self.ledger.claims if key in c["original_paths"]]
                self.ledger.conflicts.append({"kind": f"{key}_candidates_disagree", "heading": None, "values": values, "fact_ids": ids})
        for heading, entries in self.dated.items():
            dates = {d for d, _ in entries}
            if len({L.date_key(d) for d in dates}) > 1:
                paths = {p for _, p in entries}
                ids = [c["id"] for c in self.ledger.claims if paths.intersection(c["resume_paths"])]
                self.ledger.conflicts.append({"kind": "entry_dates_disagree", "heading": heading, "values": sorted(dates), "fact_ids": ids})
        for c in self.ledger.claims:
            del c["original_paths"]


def part(source_id: str, done: Organizer) -> tuple[str, dict, list[Claim], list[tuple[int, str]]]:
    return source_id, done.profile, done.claims, done.remaining


def assemble(parts: list, language: str, role: str | None = None) -> Ledger:
    """One ledger; as many claims as all sources have visible lines, or an error."""
    ledger = Assembler(parts, language, role).run()
    if len(ledger.claims) != sum(len(p[2]) for p in parts):
        raise ValueError("claims and segments differ in number")
    return ledger
