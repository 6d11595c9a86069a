"""Where to start talking about a draft: rules over its work entries, as ranked rows.

Inputs are DataFrames: ``bullets`` (doc_id, section_id, section, entry, bullet,
heading, date, text), ``claims`` (doc_id, claim_id, resume_paths) and ``reports``
(doc_id, role, requested_target, target, doubtful). Nothing is a score; every row
carries the claims and quotes that it rests on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T, vocabulary as V
from .scoring import roles_of

MOST = 3
WORK = ("experience", "projects")
# The rules in the order of their priority, and what each asks for.
IMPROVEMENTS = {
    "source_review": "compare extraction and grouping with the source",
    "result_scope": "say how the figure was measured, over which period and from which baseline",
    "personal_action": "say which part was done in person, and which choice was made",
    "target": "choose a first target",
    "timeline": "complete the heading and the dates",
    "content": "supply an experience to work with",
}


def entry_path() -> Column:
    return F.concat(F.lit("sections["), F.col("section").cast("string"), F.lit("].entries["), F.col("entry").cast("string"), F.lit("]"))


def bullet_path() -> Column:
    return F.concat(entry_path(), F.lit(".bullets["), F.col("bullet").cast("string"), F.lit("]"))


def work_rows(bullets: DataFrame) -> DataFrame:
    """Bullets that tell of work done: contacts, titles and bare skills don't."""
    at_work = F.split("section_id", "-").getItem(0).isin(*WORK)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "entry", "bullet"))
    return bullets.filter(at_work & (T.strip("text") != "")).withColumns({"path": bullet_path(), "entry_path": entry_path(), "ord": order})


def cited(rows: DataFrame, claims: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """Adds fact_ids: claims at the path or below it, in order. Paths' ancestors are listed, so the join is by equality."""
    at = claims.select(F.col("doc_id").alias("_doc"), "claim_id", F.explode("resume_paths").alias("p"))
    up = F.filter(F.array("p", F.regexp_extract("p", r"^(sections\[\d+\]\.entries\[\d+\])\.", 1), F.regexp_extract("p", r"^(sections\[\d+\])\.", 1)), lambda x: x != "")
    at = at.select("_doc", "claim_id", F.explode(F.array_distinct(up)).alias("_path"))
    joined = rows.join(at, (F.col("doc_id") == F.col("_doc")) & (F.col(path) == F.col("_path")), "left")
    return joined.groupBy(*keep).agg(F.sort_array(F.collect_set("claim_id")).alias("fact_ids"))


def improvements(bullets: DataFrame, claims: DataFrame, reports: DataFrame) -> DataFrame:
    """At most three per document, by priority: doc_id, rank, kind, ask, path, quote, fact_ids, status."""
    rows = work_rows(bullets)
    keep = F.struct("ord", "path", "text")
    earliest = lambda condition: F.min(F.when(condition, keep))
    firsts = rows.groupBy("doc_id").agg(
        earliest(T.found("text", V.NUMBER)).alias("result_scope"),
        earliest(T.found("text", V.OWNERSHIP)).alias("owner"),
        earliest(T.found("text", V.VAGUE)).alias("vague"),
        F.min(keep).alias("any"),
        earliest((F.coalesce("heading", F.lit("")) == "") | (F.coalesce("date", F.lit("")) == "")).alias("timeline"),
    )
    target = F.coalesce("target", "requested_target", "role")
    base = reports.join(firsts, "doc_id", "left").withColumn("personal_action", F.coalesce("owner", "vague", "any"))
    nothing = F.lit(None).cast("struct<ord:int,path:string,text:string>")
    given = {
        "source_review": (F.coalesce("doubtful", F.lit(False)), nothing),
        "result_scope": (F.col("result_scope").isNotNull(), F.col("result_scope")),
        "personal_action": (F.col("personal_action").isNotNull(), F.col("personal_action")),
        "target": (target.isNull(), nothing),
        "timeline": (F.col("timeline").isNotNull(), F.col("timeline")),
    }
    item = lambda kind, row: F.struct(F.lit(kind).alias("kind"), row["path"].alias("path"), row["text"].alias("quote"))
    found = F.filter(F.array(*[F.when(on, item(kind, row)) for kind, (on, row) in given.items()]), lambda x: x.isNotNull())
    base = base.select("doc_id", found.alias("found"))
    chosen = F.when(F.size("found") == 0, F.array(item("content", nothing))).otherwise(F.slice("found", 1, MOST))
    rows = base.select("doc_id", F.posexplode(chosen).alias("at", "i")).select("doc_id", (F.col("at") + 1).alias("rank"), "i.*")
    asks = F.create_map(*[F.lit(x) for pair in IMPROVEMENTS.items() for x in pair])
    out = cited(rows, claims, "path", ["doc_id", "rank", "kind", "path", "quote"])
    return out.withColumns({"ask": F.element_at(asks, F.col("kind")), "status": F.lit("proposal")})


def stories(bullets: DataFrame, claims: DataFrame, most: int = 2) -> DataFrame:
    """The first entries of a document with their quotes: doc_id, rank, heading, date, path, quotes, fact_ids, status."""
    entries = work_rows(bullets).groupBy("doc_id", "section", "entry", "entry_path", "heading", "date").agg(F.transform(F.array_sort(F.collect_list(F.struct("bullet", "text"))), lambda x: x["text"]).alias("quotes"))
    ranked = entries.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "entry"))).filter(F.col("rank") <= most)
    keep = ["doc_id", "rank", "heading", "date", "path", "quotes"]
    return cited(ranked.withColumnRenamed("entry_path", "path"), claims, "path", keep).withColumn("status", F.lit("source_only_draft"))


def directions(bullets: DataFrame, claims: DataFrame, reports: DataFrame) -> DataFrame:
    """At most three roles per document that its work gives clues for: doc_id, rank, role, fact_ids, quotes, status.

    The report's own role comes first, then roles by the number of claims, ties in
    the clues' order. A clause with a negation gives no clue.
    """
    rows = work_rows(bullets).select("doc_id", "path", "ord", "text", F.explode_outer(roles_of(F.col("text"))).alias("role")).filter("role is not null")
    quotes = rows.groupBy("doc_id", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("quotes"))
    facts = cited(rows, claims, "path", ["doc_id", "role"])
    order = F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(V.ROLE_CLUES) for x in (r, k)]), F.col("role"))
    joined = quotes.join(facts, ["doc_id", "role"]).join(reports.select("doc_id", F.col("role").alias("own")), "doc_id", "left")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy((~F.col("role").eqNullSafe(F.col("own"))).cast("int"), F.desc(F.size("fact_ids")), order))
    return joined.withColumn("rank", rank).filter(F.col("rank") <= MOST).select("doc_id", "rank", "role", "fact_ids", "quotes", F.lit("exploratory").alias("status"))
