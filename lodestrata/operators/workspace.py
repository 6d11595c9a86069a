"""Shared facts to document versions: references are bound to facts, facts to expressions, expressions to fields.

A workspace is flattened into tables: facts by language, versions, and slots - the
places of a version that a template fills, in its fields (binding), its summary or
its basis. Form is a matter of each value by itself and is judged against ``WORKSPACE``,
a description of what may stand where. Everything that looks from one part to another
- unknown references, missing languages, fields that don't exist or are bound twice,
facts that aren't confirmed - is a join or a group, so any number of
workspaces is compiled by one plan.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as Y

from ..functions import values as X
from . import profile as P

Breach = tuple[str, str]


# What may stand where


@dataclass(frozen=True)
class Leaf:
    rule: str
    holds: Callable[[object], bool]

    def breaches(self, value, path: str) -> Iterator[Breach]:
        if not self.holds(value):
            yield path, self.rule


@dataclass(frozen=True)
class Fields:
    """An object with these keys, those in ``optional`` not always."""

    of: dict
    optional: tuple[str, ...] = ()

    def breaches(self, value, path: str) -> Iterator[Breach]:
        if not isinstance(value, dict):
            yield path, "is no object"
            return
        yield from ((f"{path}.{k}", "isn't a known field") for k in value.keys() - self.of.keys())
        yield from ((f"{path}.{k}", "is missing") for k in self.of.keys() - value.keys() - set(self.optional))
        for k in self.of.keys() & value.keys():
            yield from self.of[k].breaches(value[k], f"{path}.{k}")


@dataclass(frozen=True)
class Entries:
    """An object with any keys of a form, at least one."""

    key: re.Pattern
    item: object

    def breaches(self, value, path: str) -> Iterator[Breach]:
        if not isinstance(value, dict) or not value:
            yield path, "must be an object with an entry"
            return
        for k, v in value.items():
            if not self.key.fullmatch(k):
                yield f"{path}.{k}", "isn't a fit key"
            yield from self.item.breaches(v, f"{path}.{k}")


@dataclass(frozen=True)
class Items:
    item: object
    least: int = 1
    own: str | None = None  # a key whose values must differ

    def breaches(self, value, path: str) -> Iterator[Breach]:
        if not isinstance(value, list) or len(value) < self.least:
            yield path, f"must be a list of {self.least} or more"
            return
        seen = [v[self.own] for v in value if isinstance(v, dict) and isinstance(v.get(self.own), str)] if self.own else []
        yield from ((path, f"has the {self.own} {k} more than once") for k in sorted({k for k in seen if seen.count(k) > 1}))
        for n, v in enumerate(value):
            yield from self.item.breaches(v, f"{path}[{n}]")


@dataclass(frozen=True)
class Either:
    """The second form for objects, the first for all else."""

    plain: object
    nested: object

    def breaches(self, value, path: str) -> Iterator[Breach]:
        yield from (self.nested if isinstance(value, dict) else self.plain).breaches(value, path)


def _filled(value) -> bool:
    return isinstance(value, str) and bool(value.strip()) and not any(ord(c) < 32 and c not in "\r\n\t" for c in value)


@dataclass(frozen=True)
class DraftProfile:
    def breaches(self, value, path: str) -> Iterator[Breach]:
        yield from ((f"{path}.{p}", rule) for p, rule in P.breaches(value, draft=True))


IDENTIFIER = re.compile(r"[a-z][a-z0-9_-]{0,63}")
TEXT = Leaf("must be a filled string", _filled)
NAME = Leaf("must be a short lower-case identifier", lambda v: isinstance(v, str) and bool(IDENTIFIER.fullmatch(v)))
REFS = Entries(re.compile(r"[a-z][a-z0-9_]*"), Leaf("must name a fact", lambda v: isinstance(v, str)))
SLOT = {"template": TEXT, "refs": REFS}
FACT = Fields(
    {
        "id": NAME,
        "source": TEXT,
        "status": Leaf("is neither confirmed nor pending", lambda v: v in ("confirmed", "pending")),
        "value": Leaf("is neither a string nor an integer", lambda v: type(v) is int or _filled(v)),
        "expressions": Entries(re.compile("zh|en"), Either(TEXT, Entries(re.compile(r"(?s).*\S.*"), TEXT))),
    }
)
VERSION = Fields(
    {"id": NAME, "resume": DraftProfile(), "bindings": Items(Fields(SLOT | {"path": Leaf("must be a path", lambda v: isinstance(v, str))})), "summary": Items(Fields(SLOT)), "basis": Items(Fields(SLOT | {"requirement": TEXT}), least=0)}
)
WORKSPACE = Fields({"schema_version": Leaf("must be 1", lambda v: type(v) is int and v == 1), "notice": TEXT, "facts": Items(FACT, own="id"), "versions": Items(VERSION, own="id")}, optional=("notice",))


# A workspace as tables

S, I = Y.StringType(), Y.IntegerType()
FLAT = X.record(
    breaches=Y.ArrayType(X.record(path=S, rule=S)),
    facts=Y.ArrayType(X.record(fact_id=S, language=S, source=S, status=S, value=S, expression=S)),
    versions=Y.ArrayType(X.record(v=I, version_id=S, language=S, resume=S)),
    slots=Y.ArrayType(X.record(v=I, path=S, kind=S, ord=I, field=S, requirement=S, template=S, refs=Y.MapType(S, S))),
)


def expression(fact: dict, language: str) -> str:
    """A fact in a language: its template, or the label of its value."""
    form, value = fact["expressions"][language], str(fact["value"])
    if isinstance(form, str):
        return X.expand(form, {"value": value})
    if value not in form:
        raise ValueError(f"no expression for value {value!r}")
    return form[value]


def flat(data) -> dict:
    """The tables of a workspace; only breaches if it isn't well formed or a fact can't be said."""
    out: dict = {k.name: [] for k in FLAT}
    found = list(WORKSPACE.breaches(data, "workspace"))
    if not found:
        for n, fact in enumerate(data["facts"]):
            for language in fact["expressions"]:
                try:
                    said = expression(fact, language)
                except ValueError as error:
                    found.append((f"workspace.facts[{n}].expressions.{language}", str(error)))
                    continue
                out["facts"].append({"fact_id": fact["id"], "language": language, "expression": said, "value": str(fact["value"]), "source": fact["source"], "status": fact["status"]})
        for v, version in enumerate(data["versions"] if not found else []):
            out["versions"].append({"v": v, "version_id": version["id"], "language": version["resume"]["language"], "resume": P.dumps(version["resume"])})
            for kind in ("bindings", "summary", "basis"):
                for n, slot in enumerate(version[kind]):
                    out["slots"].append({"v": v, "path": f"workspace.versions[{v}].{kind}[{n}]", "kind": kind, "ord": n, "field": slot.get("path"), "requirement": slot.get("requirement"), "template": slot["template"], "refs": slot["refs"]})
    out["breaches"] = [{"path": p, "rule": r} for p, r in found]
    return out


@F.pandas_udf(FLAT)
def flattened(workspace: pd.Series) -> pd.DataFrame:
    def one(text):
        try:
            return flat(X.strict_json(text or ""))
        except ValueError as error:
            return {"breaches": [{"path": "workspace", "rule": f"isn't strict JSON: {error}"}], "facts": [], "versions": [], "slots": []}

    return pd.DataFrame([one(t) for t in workspace], columns=[k.name for k in FLAT])


STEP = re.compile(r"([a-z_]+)|\[([0-9]+)\]")


@F.pandas_udf(S)
def with_fields(resume: pd.Series, values: pd.Series, confirmed: pd.Series) -> pd.Series:
    """Profiles as JSON text with the fields ``values`` (path to text) set; unless ``confirmed``, marked as unconfirmed."""

    def one(text, fields, keep):
        profile = json.loads(text)
        for path, value in dict(fields or {}).items():
            node, *steps = profile, *[int(n) if n else k for k, n in STEP.findall(path)]
            for step in steps[:-1]:
                node = node[step]
            node[steps[-1]] = value
        return P.dumps(profile if keep else profile | {"facts_confirmed": False})

    return pd.Series([one(*x) for x in zip(resume, values, confirmed, strict=True)], dtype="object")


# Joins between the tables


def bind_references(bindings: DataFrame, facts: DataFrame) -> DataFrame:
    """Bindings (id, template, refs: map of token to fact id) filled in from facts (fact_id, expression, status).

    Returns id, value, error and pending, the facts that bar a final version. Unknown
    facts are errors of their binding, not of the job.
    """
    refs = bindings.select("id", "template", F.explode("refs").alias("token", "fact_id"))
    joined = refs.join(facts, "fact_id", "left")
    grouped = joined.groupBy("id", "template").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("expression").isNotNull(), F.struct("token", "expression")))).alias("values"),
        F.min(F.when(F.col("expression").isNull(), F.col("fact_id"))).alias("unknown"),
        F.sort_array(F.collect_set(F.when(F.col("status") != "confirmed", F.col("fact_id")))).alias("pending"),
    )
    filled_ = grouped.withColumn("e", X.render_template("template", "values"))
    error = F.when(F.col("unknown").isNotNull(), F.concat(F.lit("unknown fact id "), "unknown")).otherwise(F.col("e.error"))
    return filled_.select("id", F.when(error.isNull(), F.col("e.value")).alias("value"), error.alias("error"), "pending")


def shared_fact_paths(basis: DataFrame, bindings: DataFrame) -> DataFrame:
    """Fields that share a fact with a basis item: (basis_id, refs) and (path, refs), refs arrays -> basis_id, paths."""
    left = basis.select("basis_id", F.explode(F.array_distinct("refs")).alias("fact_id"))
    right = bindings.select("path", F.explode(F.array_distinct("refs")).alias("fact_id"))
    return left.join(right, "fact_id").groupBy("basis_id").agg(F.sort_array(F.collect_set("path")).alias("paths"))


@dataclass
class Compiled:
    """Of many workspaces: ``versions`` of those without a breach (id, v, version_id, resume, summary, basis, facts), and ``breaches`` (id, path, rule)."""

    versions: DataFrame
    breaches: DataFrame
    final: bool = field(default=False)


def compile_workspaces(workspaces: DataFrame, workspace: str = "workspace", id_col: str = "id", final: bool = False) -> Compiled:
    """Fills every version of workspaces in JSON text: for review, or, with ``final``, under the final gate.

    A basis item's paths are the fields that share a fact with it. The requirement is
    quoted; only what is said of the person has to be final.
    """
    w = workspaces.select(F.col(id_col).alias("id"), flattened(workspace).alias("w"))
    table = lambda name: w.select("id", F.explode(f"w.{name}").alias("r")).select("id", "r.*")
    facts, versions, slots = table("facts"), table("versions"), table("slots")
    at = ["id", "path"]
    spoken = slots.join(versions.select("id", "v", "language"), ["id", "v"])
    refs = spoken.select("id", "v", "path", "template", "language", F.explode("refs").alias("token", "fact_id"))
    known = refs.join(facts.select("id", "fact_id").distinct().withColumn("known", F.lit(True)), ["id", "fact_id"], "left")
    cited = known.join(facts, ["id", "fact_id", "language"], "left")
    lacking = cited.filter("expression is null").select("id", F.concat("path", F.lit(".refs."), "token").alias("path"), F.when(F.col("known").isNull(), F.concat(F.lit("unknown fact "), "fact_id")).otherwise(F.concat("fact_id", F.lit(" isn't expressed in "), "language")).alias("rule"))

    told = cited.groupBy("id", "v", "path", "template").agg(F.map_from_entries(F.collect_list(F.struct("token", "expression"))).alias("values"), F.count("expression").alias("n"), F.count("*").alias("refs"), F.sort_array(F.collect_set("fact_id")).alias("fact_ids"))
    told = told.filter("n = refs").withColumn("e", X.render_template("template", "values")).select(*at, "v", "fact_ids", "e.value", "e.error")
    misfits = told.filter("error is not null").select("id", F.concat("path", F.lit(".template")).alias("path"), F.col("error").alias("rule"))

    bound = slots.filter("kind = 'bindings'").select("id", "v", "path", "field")
    shown = P.visible_fields(versions.select("id", "v", P.as_struct("resume").alias("profile")), keep=["id", "v"]).select("id", "v", F.col("path").alias("field"))
    nowhere = bound.join(shown, ["id", "v", "field"], "left_anti").select("id", F.concat("path", F.lit(".path")).alias("path"), F.concat("field", F.lit(" is no visible field")).alias("rule"))
    twice = bound.groupBy("id", "v", "field").agg(F.count("*").alias("n"), F.max("path").alias("path")).filter("n > 1").select("id", F.concat("path", F.lit(".path")).alias("path"), F.concat("field", F.lit(" is bound more than once")).alias("rule"))
    found = table("breaches").unionByName(lacking).unionByName(misfits).unionByName(nowhere).unionByName(twice)

    if final:
        open_facts = cited.filter("status <> 'confirmed'").groupBy("id", "v").agg(F.array_join(F.sort_array(F.collect_set("fact_id")), ", ").alias("names"))
        unsure = open_facts.select("id", F.concat(F.lit("workspace.versions["), F.col("v").cast("string"), F.lit("]")).alias("path"), F.concat(F.lit("rests on unconfirmed facts: "), "names").alias("rule"))
        unfinished = told.join(slots.filter("kind <> 'bindings'").select(*at), at).filter(P.placeholder_in("value")).select(*at, F.lit("holds a placeholder").alias("rule"))
        found = found.unionByName(unsure).unionByName(unfinished)

    values = told.join(bound, ["id", "v", "path"]).join(nowhere.select("id").distinct(), "id", "left_anti").join(twice.select("id").distinct(), "id", "left_anti")
    fields = values.filter("value is not null").groupBy("id", "v").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    written = versions.join(fields, ["id", "v"], "left").select("id", "v", "version_id", with_fields("resume", "fields", F.lit(final)).alias("resume"))
    judged = written.select("id", "v", F.explode(P.profile_breaches("resume", F.lit(not final))).alias("b"))
    found = found.unionByName(judged.select("id", F.concat(F.lit("workspace.versions["), F.col("v").cast("string"), F.lit("].resume."), "b.path").alias("path"), F.col("b.rule").alias("rule")))

    parts = told.join(slots.select(*at, "kind", "ord", "requirement"), at)
    summary = parts.filter("kind = 'summary'").groupBy("id", "v").agg(F.sort_array(F.collect_list(F.struct("ord", "value"))).alias("s"))
    said = parts.filter("kind = 'basis'").select("id", "v", "path", "ord", "requirement", F.col("value").alias("evidence"), "fact_ids")
    shares = said.select("id", "v", "path", F.explode("fact_ids").alias("fact_id")).join(values.select("id", "v", "field", F.explode("fact_ids").alias("fact_id")), ["id", "v", "fact_id"])
    shares = shares.groupBy(*at).agg(F.sort_array(F.collect_set("field")).alias("resume_paths"))
    basis = said.join(shares, at, "left").withColumn("resume_paths", F.coalesce("resume_paths", F.array().cast("array<string>")))
    basis = basis.groupBy("id", "v").agg(F.sort_array(F.collect_list(F.struct("ord", "requirement", "evidence", "fact_ids", "resume_paths"))).alias("basis"))
    used = cited.select("id", "v", F.struct("fact_id", "source", "status", "value", "expression").alias("f")).groupBy("id", "v").agg(F.sort_array(F.collect_set("f")).alias("facts"))
    none = F.array().cast("array<struct<ord:int,requirement:string,evidence:string,fact_ids:array<string>,resume_paths:array<string>>>")
    out = written.join(summary, ["id", "v"]).join(basis, ["id", "v"], "left").join(used, ["id", "v"]).join(found.select("id").distinct(), "id", "left_anti")
    out = out.select("id", "v", "version_id", "resume", F.transform("s", lambda x: x["value"]).alias("summary"), F.coalesce("basis", none).alias("basis"), "facts")
    return Compiled(out, found, final)


def digest(data: dict) -> str:
    """SHA-256 of canonical JSON: sorted keys, no blanks, non-ASCII as it is."""
    return hashlib.sha256(json.dumps(data, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
