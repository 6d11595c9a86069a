"""Queries over texts and files that Spark makes of the tables' rows; the SQL says what must come out, from the same rows.

What the tables have no example of - dated lines, headings, links, packages - is made of their values here, so
the work grows with them. The SQL never parses: it knows how a row was made.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, values as X, vocabulary as V
from ..operators import claims, classify, coaching, conflicts, fields, integrity, pages, profile as P, render, segments as S
from ..sources import html, reader
from .registry import LINES, Tables, query


def pick(key: Column, *options: Column | str) -> Column:
    """The option whose number is the key modulo their number."""
    n = len(options)
    out = F.lit(None).cast("string")
    for k, o in enumerate(options):
        out = F.when(key % n == k, F.lit(o) if isinstance(o, str) else o).otherwise(out)
    return out


# Lines of many kinds


DATES = """o AS (SELECT o_orderkey AS id, 'Works ' || o_orderstatus AS name, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%b') AS b,
      CAST(year(o_orderdate) + 2 AS VARCHAR) AS z FROM orders)"""


@query(
    f"""WITH {DATES}, s AS (
      SELECT id, name, CASE id % 8 WHEN 0 THEN b || ' ' || y || ' - Jun ' || z WHEN 1 THEN y || '.' || m || '-' || z || '.06' WHEN 2 THEN y || '-' || z WHEN 3 THEN y || ' to ' || z WHEN 4 THEN y || ' to ' || z WHEN 6 THEN y || '年3月-至今' WHEN 7 THEN y || '-' || z ELSE '' END AS span,
        y, m, z FROM o)
    SELECT id, span, id % 8 NOT IN (4, 5, 7) AS header, id % 8 <> 4 AS fragment,
      CASE id % 8 WHEN 1 THEN '' WHEN 2 THEN name || '  / F' WHEN 4 THEN 'Worked from .' WHEN 7 THEN '在期间 ' || name ELSE name END AS heading,
      CASE WHEN id % 8 = 1 THEN y || '.' || m || chr(1) || z || '.06' END AS ends FROM s"""
)
def dated_lines(t: Tables) -> DataFrame:
    """Orders' dates as a header, a sentence or a plain range."""
    y, m, b = F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "MM"), F.date_format("o_orderdate", "MMM")
    z, name = (F.year("o_orderdate") + 2).cast("string"), F.concat(F.lit("Works "), "o_orderstatus")
    w = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    line = pick(F.col("o_orderkey"), w(name, " | ", b, " ", y, " - Jun ", z), w(y, ".", m, "-", z, ".06"), w(name, " ", y, "-", z, " / F"), w("From ", y, " to ", z, " ", name), w("Worked from ", y, " to ", z, "."), name, w(name, " ", y, "年3月-至今"), w("在", y, "-", z, "期间 ", name))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), line.alias("x"))
    key = T.date_key("x")
    return rows.select("id", T.date_span("x").alias("span"), T.date_header("x").alias("header"), T.heading_fragment("x").alias("fragment"), T.entry_heading("x").alias("heading"), F.when(key != F.col("x"), key).alias("ends"))


LABELS = list(V.SECTION_OF)
LABELS_SQL, SECTIONS_SQL = ("[" + ", ".join(f"'{x}'" for x in xs) + "]" for xs in (LABELS, V.SECTION_OF.values()))


@query(
    f"""WITH c AS (SELECT c_custkey AS id, c_custkey % 10 AS f, {SECTIONS_SQL}[c_custkey // 10 % {len(LABELS)} + 1] AS section, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) AS word, c_mktsegment FROM customer)
    SELECT id, CASE WHEN f < 4 THEN section END AS section, f IN (3, 4, 5) AS unsupported, CASE f WHEN 6 THEN 'Mx ' || c_mktsegment WHEN 7 THEN 'Mira ' || word END AS name, f IN (1, 9) AS bullet FROM c"""
)
def line_kinds(t: Tables) -> DataFrame:
    """Section labels in many dresses, other headings, names and bullets."""
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.floor(F.col("c_custkey") / 10) % len(LABELS) + 1).cast("int"))
    word = F.initcap(F.lower("c_mktsegment"))
    w = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    line = pick(F.col("c_custkey"), F.upper(label), w("1. ", label), w("【", label, "】："), w("## ", label), w("# ", word), "Awards and Honors", w("Name: Mx ", F.col("c_mktsegment")), w("Mira ", word), w(word, " Engineer"), w("- ", word))
    rows = t.customer.select(F.col("c_custkey").alias("id"), line.alias("x"))
    return rows.select("id", T.heading_key("x").alias("section"), T.unknown_heading("x").alias("unsupported"), T.candidate_name("x").alias("name"), T.found("x", V.BULLET, "(?sU)").alias("bullet"))


@query(
    """WITH c AS (SELECT c_nationkey AS nation, c_custkey AS id, c_custkey % 6 AS f, c_custkey % 50 AS k FROM customer), l AS (
      SELECT nation, id, CASE f WHEN 0 THEN 'a' || k || '@b.org' WHEN 1 THEN 'https://b.org/' || k || '?x=1' END AS contact, f NOT IN (2, 5) AS readable FROM c)
    SELECT nation, count(*) FILTER (WHERE readable) AS readable, (SELECT string_agg(contact, ' ' ORDER BY first) FROM (SELECT contact, min(id) AS first FROM l x WHERE x.nation = l.nation AND contact IS NOT NULL GROUP BY contact)) AS contacts FROM l GROUP BY nation"""
)
def link_contacts(t: Tables) -> DataFrame:
    """A nation's links: how many can be read, and the contacts among them in the order of their first appearance."""
    k = (F.col("c_custkey") % 50).cast("string")
    target = pick(F.col("c_custkey"), F.concat(F.lit("mailto:a"), k, F.lit("%40b.org?subject=x")), F.concat(F.lit(" https://b.org/"), k, F.lit("?x=1")), F.lit("javascript:alert(1)"), F.lit("http://"), F.lit("ftp://b.org/x"), F.lit("  "))
    rows = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), target.alias("target")).withColumns({"contact": T.link_contact("target"), "ok": T.readable_link("target")})
    named = integrity.ordered_distinct(rows.filter("contact is not null"), "nation", "contact", "id").select("nation", F.array_join("values", " ").alias("contacts"))
    return rows.groupBy("nation").agg(F.count_if("ok").alias("readable")).join(named, "nation", "left")


@query("SELECT p_partkey AS id, 'fine ' || p_partkey || ' ' || p_name AS normal FROM part")
def normal_texts(t: Tables) -> DataFrame:
    """Ligatures, full-width figures and soft hyphens are read as what they stand for."""
    wide = F.translate(F.col("p_partkey").cast("string"), "0123456789", "０１２３４５６７８９")
    made = F.concat(F.lit("ﬁne "), wide, F.lit(" "), F.regexp_replace("p_name", "(?<=.)(?=.)", "­"))
    return t.part.select(F.col("p_partkey").alias("id"), X.normalized_text(made).alias("normal"))


@query(
    f"""SELECT doc_id, CAST(line AS INT) AS line, regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '([\\\\`*_{{}}\\[\\]<>#!|&+().=~-])', '\\\\\\1', 'g') AS markdown FROM ({LINES}) WHERE trim(raw) <> ''"""
)
def escaped_lines(t: Tables) -> DataFrame:
    """Every line so that Markdown shows it as it is."""
    rows = S.segments(t.documents, keep=["doc_id"])
    return rows.select("doc_id", F.col("line_in_block").alias("line"), T.md_escape("raw_text").alias("markdown"))


@query(
    """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS switch, p_partkey % 5 <> 3 AS identifier, p_partkey % 5 = 4 AS bad, p_partkey % 5 IN (0, 2) AS risky, p_partkey % 3 = 1 AS layout FROM part"""
)
def text_rules(t: Tables) -> DataFrame:
    """Switches, identifiers, texts that must not be blank, and lines that may be columns."""
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    w = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    rows = t.part.select(k.alias("id"), pick(k, "TRUE", "off", F.lit(None).cast("string"), "perhaps", "2").alias("s"), pick(k, w("p_", n), w("p-", n), w("p", n), w("P", n), w("a", n)).alias("i"), pick(k, "a", " b ", "c\td", w("x", n), " \n ").alias("b"), pick(k, w("left ", n, "    right"), w("Works ", n, "    2019-2021"), w("first\na", n, "     b     c"), w("   ", n, "   Mar 2020 - 现在"), n).alias("c"), F.array(F.lit("encoding guessed"), pick(k, "text order on a page is that of its layout, not proof of the reading order", "page 1 has possible columns", "")).alias("n"))
    return rows.select("id", T.on_off("s").alias("switch"), T.identifier("i").alias("identifier"), T.bad_text("b", allow_empty=False).alias("bad"), T.possible_columns("c").alias("risky"), T.layout_risk("n").alias("layout"))


@query(
    f"""WITH w AS (SELECT doc_id, line, k, list_extract(ws, k) AS word FROM (SELECT doc_id, line, ws, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT doc_id, line, string_split(raw, ' ') AS ws FROM ({LINES}))))
    SELECT doc_id, CAST(line AS INT) AS line, string_agg(word, ' ' ORDER BY k) AS text, min((doc_id * 31 + line * 7 + k * 13) % 40 + 60) AS least, min((doc_id * 31 + line * 7 + k * 13) % 40 + 60) < 75 AS needs_review
    FROM w WHERE trim(word) <> '' GROUP BY 1, 2"""
)
def recognised_lines(t: Tables) -> DataFrame:
    """Words as a recogniser gives them, with a confidence each: a line is as sure as its least sure word."""
    lines = t.documents.select("doc_id", F.posexplode_outer(T.lines(F.col("text"))).alias("at", "raw")).filter("raw is not null")
    words = lines.select("doc_id", (F.col("at") + 1).alias("line"), F.posexplode(F.split("raw", " ")).alias("k", "text"))
    sure = (F.col("doc_id") * 31 + F.col("line") * 7 + (F.col("k") + 1) * 13) % 40 + 60
    words = words.select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("block"), F.lit(1).alias("par"), "line", F.col("k").alias("word"), "text", (sure / 100).alias("confidence"))
    return pages.recognised_lines(words).select("doc_id", "line", "text", F.round(F.col("confidence") * 100).cast("long").alias("least"), "needs_review")


@query(
    """WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, min(l_discount) * 10 AS d FROM lineitem GROUP BY 1, 2)
    SELECT doc_id, count(*) AS pages, bool_and(d < 0.95) AS a4, min(page) = 1 AND max(page) = count(*) AS contiguous FROM p GROUP BY 1"""
)
def page_checks(t: Tables) -> DataFrame:
    """Orders as documents: sizes and numbers of their pages."""
    own = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")).agg(F.min("l_discount").alias("d"))
    return pages.page_check(own.select("doc_id", "page", (F.lit(595.276) + F.col("d") * 10 * 1.05).alias("width"), F.lit(841.89).alias("height")))


# Records, references and claims


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey % 5 AS f, 'o-' || o_orderkey AS oid, 'c-' || o_custkey AS cid, o_orderpriority AS p FROM orders), n AS (
      SELECT o.*, c.c_name AS name, c.c_custkey IS NOT NULL AND f <> 4 AS there FROM o LEFT JOIN customer c ON c.c_custkey = o.c)
    SELECT id, CASE WHEN there THEN CASE f WHEN 0 THEN name || ': ' || p WHEN 1 THEN name || ' {' || p || '}' END END AS value,
      CASE WHEN f = 4 THEN oid || ',x-' || c ELSE cid || ',' || oid END AS fact_ids, CASE WHEN NOT there THEN 'no fact ' || CASE WHEN f = 4 THEN 'x-' || c ELSE cid END WHEN f = 2 THEN 'unknown token {when}' WHEN f = 3 THEN 'unused reference what' END AS error FROM n"""
)
def bound_templates(t: Tables) -> DataFrame:
    """Orders told by templates whose tokens refer to customers and orders."""
    template = pick(F.col("o_orderkey"), "{who}: {what}", "{who} {{{what}}}", "{who} {what} {when}", "{who}", "{who}: {what}")
    prefix = F.when(F.col("o_orderkey") % 5 == 4, "x-").otherwise("c-")
    refs = F.create_map(F.lit("who"), F.concat(prefix, "o_custkey"), F.lit("what"), F.concat(F.lit("o-"), "o_orderkey"))
    templates = t.orders.select(F.col("o_orderkey").alias("id"), template.alias("template"), refs.alias("refs"))
    facts = t.customer.select(F.concat(F.lit("c-"), "c_custkey").alias("fact_id"), F.col("c_name").alias("value")).unionByName(t.orders.select(F.concat(F.lit("o-"), "o_orderkey").alias("fact_id"), F.col("o_orderpriority").alias("value")))
    return fields.bound_templates(templates, facts, "template", "refs").withColumn("fact_ids", F.array_join("fact_ids", ","))


@query(
    """WITH f AS (SELECT c_custkey AS id, unnest(['name', 'segment', 'nation']) AS path, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer), u AS (
      SELECT o_custkey AS id, CASE o_custkey % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'segment' WHEN 2 THEN 'note' ELSE 'nation' END AS path, max(o_orderpriority) AS value FROM orders GROUP BY 1, 2)
    SELECT coalesce(f.id, u.id) AS id, coalesce(f.path, u.path) AS path, CASE WHEN f.id IS NOT NULL AND u.id IS NOT NULL THEN u.value ELSE f.value END AS value, CASE WHEN f.id IS NULL THEN 'unknown' WHEN u.id IS NULL THEN 'kept' ELSE 'set' END AS state
    FROM f FULL JOIN u ON f.id = u.id AND f.path = u.path"""
)
def field_updates(t: Tables) -> DataFrame:
    """Customers' fields, some set by their orders; a path that a customer doesn't have is reported."""
    pair = lambda path, c: F.struct(F.lit(path).alias("path"), F.col(c).cast("string").alias("value"))
    own = t.customer.select(F.col("c_custkey").alias("id"), F.explode(F.array(pair("name", "c_name"), pair("segment", "c_mktsegment"), pair("nation", "c_nationkey"))).alias("f")).select("id", "f.*")
    path = pick(F.col("o_custkey"), "name", "segment", "note", "nation")
    updates = t.orders.groupBy(F.col("o_custkey").alias("id"), path.alias("path")).agg(F.max("o_orderpriority").alias("value"))
    return fields.set_fields(own, updates, ["id"], "path", "value")


@query(
    """WITH e AS (SELECT event_id, event_id % 4 AS f FROM events) SELECT event_id, unnest(CASE f WHEN 1 THEN ['x'] WHEN 2 THEN ['k'] ELSE ['x', 'k'] END) AS key, unnest(CASE f WHEN 1 THEN ['unknown'] WHEN 2 THEN ['missing'] ELSE ['unknown', 'missing'] END) AS problem FROM e WHERE f > 0"""
)
def key_rules(t: Tables) -> DataFrame:
    """Events' records, some with a key more or one less: each must have k and nothing else."""
    props = pick(F.col("event_id"), F.col("props"), F.regexp_replace("props", r"\}$", ', "x": 1}'), F.lit("{}"), F.regexp_replace("props", '"k"', '"x"'))
    rows = t.events.select("event_id", F.json_object_keys(props).alias("keys"))
    return fields.key_rules(rows, F.col("keys"), ["k"], ["k"], F.col("event_id"))


@query("SELECT event_id, sha256('{\"a\":\"é\",\"k\":' || json_extract_string(props, '$.k') || '}') AS digest FROM events")
def canonical_digests(t: Tables) -> DataFrame:
    """Digests of records don't depend on the order of their keys and on blanks."""
    made = F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", r"\}$", ' , "a" : "é"}')).otherwise(F.regexp_replace("props", r"^\{", '{"a":"é", '))
    return t.events.select("event_id", F.sha2(X.canonical_json(made), 256).alias("digest"))


@query(
    """WITH e AS (SELECT DISTINCT o_custkey AS heading, CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) || '-' || (year(o_orderdate) + 1) WHEN 1 THEN year(o_orderdate) || ' – ' || (year(o_orderdate) + 1) ELSE year(o_orderdate) || ' to now' END AS date,
      CASE WHEN o_orderkey % 3 < 2 THEN year(o_orderdate) || '|' || (year(o_orderdate) + 1) ELSE year(o_orderdate) || '|now' END AS normal FROM orders)
    SELECT 'shop ' || heading AS heading, count(DISTINCT normal) AS n_normal, string_agg(DISTINCT date, ',' ORDER BY date) AS "values" FROM e GROUP BY 1 HAVING count(DISTINCT normal) > 1"""
)
def date_conflicts(t: Tables) -> DataFrame:
    """Customers' orders as entries of one heading: ranges agree if their ends do, however they are written."""
    y, z = F.year("o_orderdate").cast("string"), (F.year("o_orderdate") + 1).cast("string")
    date = pick(F.col("o_orderkey"), F.concat(y, F.lit("-"), z), F.concat(y, F.lit(" – "), z), F.concat(y, F.lit(" to now")))
    heading = F.concat(pick(F.col("o_orderkey"), "Shop  ", "SHOP "), F.col("o_custkey").cast("string"))
    return conflicts.entry_date_conflicts(t.orders.select(heading.alias("heading"), date.alias("date"))).withColumn("values", F.array_join("values", ","))


@query(
    f"""WITH l AS (SELECT source, doc_id, line, trim(raw) AS text FROM ({LINES}) JOIN documents USING (doc_id) WHERE trim(raw) <> ''), b AS (
      SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY line) + 1 THEN 0 ELSE 1 END AS begins FROM l), s AS (
      SELECT *, sum(begins) OVER (PARTITION BY source ORDER BY doc_id, line) - 1 AS section, row_number() OVER (PARTITION BY source ORDER BY doc_id, line) AS nth FROM b), g AS (
      SELECT source, section, lower(string_split(arg_min(text, line), ' ')[1]) AS wanted, count(*) AS n FROM s GROUP BY 1, 2), c AS (
      SELECT source, wanted FROM g GROUP BY 1, 2 HAVING count(DISTINCT n) > 1)
    SELECT c.source, c.wanted AS kind, string_agg('claim-' || lpad(CAST(nth AS VARCHAR), 6, '0'), ',' ORDER BY nth) AS fact_ids FROM c JOIN g USING (source, wanted) JOIN s ON s.source = g.source AND s.section = g.section GROUP BY 1, 2"""
)
def conflict_claims(t: Tables) -> DataFrame:
    """Sections of one name whose lengths differ are a conflict: the claims that it rests on."""
    word = F.lower(F.element_at(F.split("title", " "), 1))
    named = claims.assembled_sections(t.documents, "source", "doc_id", word).withColumn("kind", F.regexp_replace("section_id", r"-\d+$", ""))
    path = F.concat(F.lit("sections["), F.col("section"), F.lit("]"))
    disagreeing = named.groupBy("source", "kind").agg(F.count_distinct("n_lines").alias("n"), F.collect_list(path).alias("paths")).filter("n > 1")
    made = claims.assembled_claims(t.documents, "source", "doc_id")
    return fields.claims_of(disagreeing, made, "source").withColumn("fact_ids", F.array_join("fact_ids", ","))


def work(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents' lines as bullets of one entry, their claims, and reports."""
    lines = S.segments(t.documents, keep=["doc_id"]).select("doc_id", (F.col("line_in_block") - 1).alias("bullet"), "text")
    bullets = lines.withColumns({"section_id": pick(F.col("doc_id"), "experience", "projects-2", "skills"), "section": F.lit(0), "entry": F.lit(0), "heading": F.when(F.col("doc_id") % 2 == 0, "Works"), "date": F.when(F.col("doc_id") % 5 > 0, "2019-2021")})
    path = F.concat(F.lit("sections[0].entries[0].bullets["), F.col("bullet"), F.lit("]"))
    made = lines.select("doc_id", F.concat(F.lit("c-"), F.lpad(F.col("bullet").cast("string"), 6, "0")).alias("claim_id"), F.array(path).alias("resume_paths"))
    none = F.lit(None).cast("string")
    reports = t.documents.select("doc_id", none.alias("role"), none.alias("requested_target"), F.when(F.col("doc_id") % 7 > 0, "data").alias("target"), (F.col("doc_id") % 4 == 0).alias("doubtful"))
    return bullets, made, reports


NUMBER_SQL = r"(?i)\d+(\.\d+)?\s*(%|％|家|人|次|倍|hours?|days?|users?|clients?)|提升|增长|降低|improv|increas|reduc"
OWNER_SQL = r"(?i)主导|独立|全面负责|(led|lead|owned)($|[^\p{L}\p{N}_])|solely"
VAGUE_SQL = r"(?i)负责|参与|协助|responsible|participat|assist|help"


@query(
    rf"""WITH l AS (SELECT doc_id, line - 1 AS k, trim(raw) AS text FROM ({LINES}) WHERE trim(raw) <> '' AND doc_id % 3 < 2), a AS (
      SELECT doc_id, min(k) FILTER (WHERE regexp_matches(text, '{NUMBER_SQL}')) AS number, coalesce(min(k) FILTER (WHERE regexp_matches(text, '{OWNER_SQL}')), min(k) FILTER (WHERE regexp_matches(text, '{VAGUE_SQL}')), min(k)) AS action, min(k) AS first FROM l GROUP BY 1), r AS (
      SELECT d.doc_id, list_filter([CASE WHEN d.doc_id % 4 = 0 THEN {{'kind': 'source_review', 'k': CAST(NULL AS BIGINT)}} END, CASE WHEN number IS NOT NULL THEN {{'kind': 'result_scope', 'k': number}} END, CASE WHEN action IS NOT NULL THEN {{'kind': 'personal_action', 'k': action}} END,
        CASE WHEN d.doc_id % 7 = 0 THEN {{'kind': 'target', 'k': CAST(NULL AS BIGINT)}} END, CASE WHEN first IS NOT NULL AND (d.doc_id % 2 = 1 OR d.doc_id % 5 = 0) THEN {{'kind': 'timeline', 'k': first}} END], lambda x: x IS NOT NULL) AS f FROM documents d LEFT JOIN a USING (doc_id)), x AS (
      SELECT doc_id, unnest(range(1, least(len(g), 3) + 1)) AS rank, unnest(g[1:3]) AS i FROM (SELECT doc_id, CASE WHEN len(f) = 0 THEN [{{'kind': 'content', 'k': CAST(NULL AS BIGINT)}}] ELSE f END AS g FROM r))
    SELECT x.doc_id, CAST(rank AS INT) AS rank, i.kind AS kind, 'sections[0].entries[0].bullets[' || i.k || ']' AS path, l.text AS quote, CASE WHEN i.k IS NULL THEN '' ELSE 'c-' || lpad(CAST(i.k AS VARCHAR), 6, '0') END AS fact_ids FROM x LEFT JOIN l ON l.doc_id = x.doc_id AND l.k = i.k"""
)
def improvements(t: Tables) -> DataFrame:
    """What to ask first about each document, by the order of the rules."""
    return coaching.improvements(*work(t)).select("doc_id", "rank", "kind", "path", "quote", F.array_join("fact_ids", ",").alias("fact_ids"))


@query(
    f"""WITH l AS (SELECT doc_id, line - 1 AS k, trim(raw) AS text FROM ({LINES}) WHERE trim(raw) <> '' AND doc_id % 3 < 2)
    SELECT doc_id, 1 AS rank, CASE WHEN doc_id % 2 = 0 THEN 'Works' END AS heading, string_agg(text, chr(10) ORDER BY k) AS quotes, count(*) AS n_claims FROM l GROUP BY doc_id"""
)
def stories(t: Tables) -> DataFrame:
    """The first entries of each document's work, with their quotes and claims."""
    bullets, made, _ = work(t)
    found = coaching.stories(bullets, made)
    return found.select("doc_id", "rank", "heading", F.array_join("quotes", "\n").alias("quotes"), F.size("fact_ids").cast("long").alias("n_claims"))


@query(
    r"""SELECT conv_id, string_agg('## ' || 't-' || lpad(CAST(turn AS VARCHAR), 4, '0') || chr(10) || chr(10) || '> ' || regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_{}\[\]()#+.!|\-])', '\\\1', 'g') || chr(10) || chr(10) || '- b · ' || role || ' · source_only' || chr(10), chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1"""
)
def evidence_texts(t: Tables) -> DataFrame:
    """Conversations' turns as claims in one Markdown text each."""
    made = t.conversations.select("conv_id", F.concat(F.lit("t-"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("claim_id"), "text", F.lit("b").alias("block_id"), F.col("role").alias("interpretation"), F.lit("source_only").alias("status"))
    return render.evidence_markdown(made, "conv_id")


# Files

CONTROL = "[\\x00-\\x08\\x0b\\x0e-\\x1f]"
PARAGRAPHS = f"""n AS ({LINES}), m AS (
      SELECT *, trim(raw, ' ' || chr(9)) = '' AS blank, sum(CASE WHEN trim(raw, ' ' || chr(9)) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS island FROM n
    ), g AS (SELECT doc_id, min(line) AS a, trim(string_agg(raw, chr(10) ORDER BY line), ' ' || chr(9) || chr(10)) AS text FROM m WHERE NOT blank GROUP BY doc_id, island), p AS (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS seq, text FROM g)"""


@query(
    f"""WITH {PARAGRAPHS}, f AS (SELECT doc_id, doc_id % 7 AS f, CASE WHEN doc_id % 7 = 6 THEN 'needs_dependency' WHEN doc_id % 7 = 5 THEN 'unsupported' WHEN doc_id % 7 = 4 THEN 'error' WHEN regexp_matches(text, '{CONTROL}') THEN 'error' WHEN trim(text, ' ' || chr(9) || chr(10)) = '' THEN 'partial' ELSE 'extracted' END AS status FROM documents WHERE text IS NOT NULL)
    SELECT f.doc_id, ['txt', 'md', 'markdown', 'txt', 'json', 'xyz', 'rtf'][f + 1] AS format, status, CASE f WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16' WHEN 3 THEN 'utf-32' WHEN 4 THEN 'utf-8' END AS encoding, CAST(p.seq AS INT) AS seq, p.text
    FROM f LEFT JOIN p ON p.doc_id = f.doc_id AND f.status = 'extracted'"""
)
def source_files(t: Tables) -> DataFrame:
    """Documents as files in several encodings and formats, read back: blocks, or why there are none."""
    mark = lambda name, order: F.concat(F.lit(bytearray(order)), F.encode("text", name))
    f = F.col("doc_id") % 7
    content = F.when(f == 1, F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), F.col("text").cast("binary"))).when(f == 2, mark("UTF-16LE", b"\xff\xfe")).when(f == 3, mark("UTF-32", b"\x00\x00\xfe\xff")).otherwise(F.col("text").cast("binary"))
    files = t.documents.filter("text is not null").select(F.concat(F.col("doc_id"), F.lit("."), pick(F.col("doc_id"), "txt", "md", "markdown", "txt", "json", "xyz", "rtf")).alias("path"), content.alias("content"))
    found = reader.extract_files(files)
    return found.select(F.split("path", r"\.")[0].cast("long").alias("doc_id"), "format", "status", F.get_json_object("details", "$.encoding").alias("encoding"), "seq", "text")


WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(parts: list[tuple[str, str]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts:
            z.writestr(name, content)
    return out.getvalue()


def word_file(lines: list[str], kind: int) -> bytes:
    """Lines as paragraphs of a Word file, with a header and a footer; kind 1 hides a run in each, 2 begins with a declaration, 3 is no package, 4 holds a part twice."""
    if kind == 3:
        return b"PK no package"
    hidden = "<w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r>" if kind == 1 else ""
    paragraph = lambda x: f'<w:p>{hidden}<w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>'
    sides = '<w:sectPr><w:headerReference w:type="default" r:id="r1"/><w:footerReference w:type="default" r:id="r2"/></w:sectPr>'
    head = '<?xml version="1.0" encoding="UTF-8"?>' + ("<!DOCTYPE w>" if kind == 2 else "")
    names = f'xmlns:w="{WORD_NS}" xmlns:r="{REL_NS}"'
    relation = lambda k, part: f'<Relationship Id="r{k}" Target="{part}.xml"/>'
    main = ("word/document.xml", f"{head}<w:document {names}><w:body>{''.join(map(paragraph, lines))}{sides}</w:body></w:document>")
    return zipped(
        [
            ("[Content_Types].xml", '<Types><Override PartName="/word/document.xml"/></Types>'),
            ("word/_rels/document.xml.rels", f"<Relationships>{relation(1, 'header1')}{relation(2, 'footer1')}</Relationships>"),
            ("word/header1.xml", f"<w:hdr {names}>{paragraph('head')}</w:hdr>"),
            ("word/footer1.xml", f"<w:ftr {names}>{paragraph('foot')}</w:ftr>"),
            *[main] * (2 if kind == 4 else 1),
        ]
    )


def open_file(lines: list[str]) -> bytes:
    """Lines as paragraphs of an OpenDocument file."""
    names = "urn:oasis:names:tc:opendocument:xmlns"
    body = "".join(f"<text:p>{escape(x)}</text:p>" for x in lines)
    content = f'<office:document-content xmlns:office="{names}:office:1.0" xmlns:text="{names}:text:1.0"><office:body><office:text>{body}</office:text></office:body></office:document-content>'
    return zipped([("mimetype", "application/vnd.oasis.opendocument.text"), ("content.xml", content)])


def packages(docs: DataFrame) -> DataFrame:
    """path and content: a package of each document's lines, control characters left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import warnings

        for frame in frames:
            rows = []
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")  # a part twice is meant
                for k, lines in zip(frame["doc_id"], frame["lines"], strict=True):
                    rows.append((f"{k}.odt", open_file(list(lines))) if k % 8 in (6, 7) else (f"{k}.docx", word_file(list(lines), max(0, k % 8 - 1))))
            yield pd.DataFrame(rows, columns=["path", "content"])

    lines = T.lines(F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f]", ""))
    return docs.filter("text is not null").select("doc_id", lines.alias("lines")).mapInPandas(run, "path string, content binary")


@query(
    f"""WITH d AS (SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f]', '', 'g') AS text FROM documents WHERE text IS NOT NULL), n AS (
      SELECT doc_id, k, trim(regexp_replace(list_extract(l, k), '\\s+', ' ', 'g')) AS x FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM d))), p AS (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS seq, x AS text FROM (SELECT doc_id, k, x FROM n WHERE x <> '' UNION ALL SELECT doc_id, 0, 'head' FROM d WHERE doc_id % 8 < 3 UNION ALL SELECT doc_id, 1000000000, 'foot' FROM d WHERE doc_id % 8 < 3)), f AS (
      SELECT doc_id, CASE WHEN doc_id % 8 IN (3, 4, 5) THEN 'error' WHEN doc_id NOT IN (SELECT doc_id FROM p) THEN 'partial' ELSE 'extracted' END AS status FROM d)
    SELECT f.doc_id, CASE WHEN f.doc_id % 8 > 5 THEN 'odt' ELSE 'docx' END AS format, status, CAST(p.seq AS INT) AS seq, p.text FROM f LEFT JOIN p ON p.doc_id = f.doc_id AND status = 'extracted'"""
)
def package_lines(t: Tables) -> DataFrame:
    """Documents as Word and OpenDocument files, some hidden, damaged or forbidden in part, read back."""
    found = reader.extract_files(packages(t.documents))
    return found.select(F.split("path", r"\.")[0].cast("long").alias("doc_id"), "format", "status", "seq", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


@query(
    """WITH s AS (SELECT p_partkey AS id, p_partkey * 37 % 11000 + 1 AS w, p_size * 150 + 1 AS h FROM part)
    SELECT id, CASE WHEN w > 10000 OR h > 10000 OR w * h > 40000000 THEN 'error' ELSE 'needs_dependency' END AS status, CASE WHEN NOT (w > 10000 OR h > 10000 OR w * h > 40000000) THEN '[' || w || ',' || h || ']' END AS size FROM s"""
)
def image_headers(t: Tables) -> DataFrame:
    """Parts as pictures of many sizes, told by their headers; those over the limits are errors."""

    @F.pandas_udf("binary")
    def png(w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", a, b, 8, 2, 0, 0, 0) + bytes(4) for a, b in zip(w, h, strict=True)])

    w, h = (F.col("p_partkey") * 37 % 11000 + 1).cast("long"), (F.col("p_size") * 150 + 1).cast("long")
    files = t.part.select(F.concat(F.col("p_partkey"), F.lit(".png")).alias("path"), png(w, h).alias("content"))
    found = reader.extract_files(files)
    return found.select(F.split("path", r"\.")[0].cast("long").alias("id"), "status", F.get_json_object("details", "$.image_dimensions").alias("size"))


def marked_file(key: int, segment: str, nation: int) -> bytes:
    """A link, written in one of three ways, a paragraph that may be a list item, and a table whose first column may be merged."""
    names = f'xmlns:w="{WORD_NS}" xmlns:r="{REL_NS}"'
    run = lambda x: f"<w:r><w:t>{escape(x)}</w:t></w:r>"
    field = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    target = f"https://b.org/{key}"
    links = [
        f'{field("begin")}<w:r><w:instrText>HYPERLINK "{target}" \\o "tip"</w:instrText></w:r>{field("separate")}{run("here")}{field("end")}',
        f'<w:fldSimple w:instr="HYPERLINK &quot;{target}&quot;">{run("here")}</w:fldSimple>',
        f'<w:hyperlink r:id="r1">{run("here")}</w:hyperlink>',
    ]
    numbered = f'<w:pPr><w:numPr><w:ilvl w:val="{nation}"/><w:numId w:val="3"/></w:numPr></w:pPr>' if key % 2 else ""
    cell = lambda x, properties="": f"<w:tc><w:tcPr>{properties}</w:tcPr><w:p>{run(x)}</w:p></w:tc>"
    merge = lambda value: f"<w:vMerge{value}/>" if key % 2 == 0 else ""
    restart, wide = merge(' w:val="restart"'), '<w:gridSpan w:val="2"/>'
    table = f"<w:tbl><w:tr>{cell(segment, restart)}{cell('x', wide)}</w:tr><w:tr>{cell('w', merge(''))}{cell('y')}{cell('z')}</w:tr></w:tbl>"
    body = f"<w:p>{run('see ')}{links[key % 3]}</w:p><w:p>{numbered}{run(segment)}</w:p>{table}"
    return zipped(
        [
            ("[Content_Types].xml", '<Types><Override PartName="/word/document.xml"/></Types>'),
            ("word/_rels/document.xml.rels", f'<Relationships><Relationship Id="r1" Target="{target}" TargetMode="External"/></Relationships>'),
            ("word/document.xml", f"<w:document {names}><w:body>{body}</w:body></w:document>"),
        ]
    )


@query(
    """WITH c AS (SELECT c_custkey AS id, c_mktsegment AS s, c_nationkey AS n, c_custkey % 2 = 0 AS merged FROM customer)
    SELECT id, 1 AS seq, 'see here' AS text, 'https://b.org/' || id AS target, CAST(NULL AS VARCHAR) AS level, CAST(NULL AS VARCHAR) AS place, CAST(NULL AS VARCHAR) AS spans, CAST(NULL AS VARCHAR) AS origin FROM c
    UNION ALL SELECT id, 2, s, NULL, CASE WHEN NOT merged THEN CAST(n AS VARCHAR) END, NULL, NULL, NULL FROM c
    UNION ALL SELECT id, 3, s, NULL, NULL, '1,1', CASE WHEN merged THEN '2,1' ELSE '1,1' END, NULL FROM c
    UNION ALL SELECT id, 4, 'x', NULL, NULL, '1,2', '1,2', NULL FROM c
    UNION ALL SELECT id, 5, 'w', NULL, NULL, '2,1', '1,1', CASE WHEN merged THEN '[1,1]' END FROM c
    UNION ALL SELECT id, 6, 'y', NULL, NULL, '2,2', '1,1', NULL FROM c UNION ALL SELECT id, 7, 'z', NULL, NULL, '2,3', '1,1', NULL FROM c"""
)
def package_places(t: Tables) -> DataFrame:
    """Customers as Word files with a link, a list and a table, read back with the place of every block."""

    @F.pandas_udf("binary")
    def made(key: pd.Series, segment: pd.Series, nation: pd.Series) -> pd.Series:
        return pd.Series([marked_file(*x) for x in zip(key.tolist(), segment, nation.tolist(), strict=True)])

    files = t.customer.select(F.concat(F.col("c_custkey"), F.lit(".docx")).alias("path"), made("c_custkey", "c_mktsegment", "c_nationkey").alias("content"))
    at = lambda name: F.get_json_object("locator", f"$.{name}")
    pair = lambda a, b: F.when(at("row").isNotNull(), F.concat(at(a), F.lit(","), at(b)))
    found = reader.extract_files(files)
    return found.select(F.split("path", r"\.")[0].cast("long").alias("id"), "seq", "text", F.get_json_object("links", "$[0].target").alias("target"), at("numbering_level").alias("level"), pair("row", "column").alias("place"), pair("row_span", "column_span").alias("spans"), at("merge_origin").alias("origin"))


@query(
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>[^<]*</a>', 1)) AS target, unnest(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>([^<]*)</a>', 1)) AS text FROM pages)
    SELECT page_id, replace(target, '&amp;', '&') AS target, replace(text, '&amp;', '&') AS text, count(*) AS n FROM l GROUP BY ALL"""
)
def page_links(t: Tables) -> DataFrame:
    """Every page's links that are shown."""
    links = html.html_blocks(t.pages, keep=["page_id"]).select("page_id", F.explode("links").alias("link"))
    return links.filter(T.readable_link(F.col("link.target"))).groupBy("page_id", F.col("link.target").alias("target"), F.col("link.text").alias("text")).agg(F.count("*").alias("n"))


# Profiles


def profiles(t: Tables) -> DataFrame:
    """A profile per customer: its orders are the entries of the first section, the second is empty."""
    entry = F.struct(F.concat(F.lit("Order "), "o_orderkey").alias("heading"), F.year("o_orderdate").cast("string").alias("date"), F.array("o_orderpriority").alias("bullets"))
    told = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.struct("o_orderkey", entry.alias("e")).alias("o")).groupBy("c_custkey").agg(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["e"]).alias("entries"))
    none = F.array().cast(P.SECTION["entries"].dataType)
    rows = t.customer.join(told, "c_custkey", "left").withColumn("entries", F.coalesce("entries", none))
    section = lambda key, title, entries: F.struct(F.lit(key).alias("id"), F.lit(title).alias("title"), entries.alias("entries"))
    f, text = F.col("c_custkey") % 6, F.lit(None).cast("string")
    values = {
        "language": F.when(f == 4, "fr").otherwise("en"),
        "role": text,
        "name": F.when(f == 2, " ").otherwise(F.col("c_name")),
        "headline": F.when(f == 5, "TBD").when(f == 1, "").otherwise(F.col("c_mktsegment")),
        "contacts": F.array(F.concat(F.lit("c"), "c_custkey", F.lit("@b.org"))),
        "facts_confirmed": f != 1,
        "sections": F.array(section("experience", "Experience", F.col("entries")), section("skills", "Skills", none)),
        "example_notice": text,
    }
    return rows.select(F.col("c_custkey").alias("id"), F.struct(*[c.alias(n) for n, c in values.items()]).alias("profile"))


PROFILES_SQL = """c AS (SELECT c_custkey AS id, c_custkey % 6 AS f, CASE WHEN c_custkey % 6 = 2 THEN ' ' ELSE c_name END AS name, CASE c_custkey % 6 WHEN 5 THEN 'TBD' WHEN 1 THEN '' ELSE c_mktsegment END AS headline, 'c' || c_custkey || '@b.org' AS contact FROM customer), e AS (
      SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, 'Order ' || o_orderkey AS heading, CAST(year(o_orderdate) AS VARCHAR) AS date, o_orderpriority AS bullet FROM orders WHERE o_custkey IN (SELECT id FROM c))"""


@query(
    f"""WITH {PROFILES_SQL}, a AS (SELECT id, 0 AS ord, 'name' AS path, name AS value FROM c UNION ALL SELECT id, 1, 'headline', headline FROM c UNION ALL SELECT id, 2, 'contacts[0]', contact FROM c
      UNION ALL SELECT DISTINCT id, 3, 'sections[0].title', 'Experience' FROM e UNION ALL SELECT id, 4 + 3 * k, 'sections[0].entries[' || k || '].heading', heading FROM e
      UNION ALL SELECT id, 5 + 3 * k, 'sections[0].entries[' || k || '].date', date FROM e UNION ALL SELECT id, 6 + 3 * k, 'sections[0].entries[' || k || '].bullets[0]', bullet FROM e)
    SELECT id, CAST(ord AS INT) AS ord, path, value FROM a"""
)
def visible_fields(t: Tables) -> DataFrame:
    """What a reader of each profile sees, with paths and in order."""
    return P.visible_fields(profiles(t), keep=["id"])


@query(
    f"""WITH {PROFILES_SQL}, t AS (SELECT id, string_agg(chr(10) || chr(10) || heading || ' | ' || date || chr(10) || '- ' || bullet, '' ORDER BY k) AS body FROM e GROUP BY id)
    SELECT id, CASE WHEN trim(name) <> '' THEN name || chr(10) ELSE '' END || CASE WHEN headline <> '' THEN headline || chr(10) ELSE '' END || contact || CASE WHEN body IS NOT NULL THEN chr(10) || chr(10) || 'Experience' || body ELSE '' END || chr(10) AS text FROM c LEFT JOIN t USING (id)"""
)
def rendered_profiles(t: Tables) -> DataFrame:
    """Profiles as plain text; sections without entries are left out."""
    return profiles(t).select("id", render.rendered(F.to_json("profile"), "text").alias("text"))


@query(
    f"""WITH {PROFILES_SQL}, b AS (SELECT id, f, id IN (SELECT id FROM e) AS told FROM c), r AS (
      SELECT id, list_filter(CASE f WHEN 2 THEN [{{'path': 'name', 'rule': 'must be a non-empty string'}}] WHEN 3 THEN [{{'path': 'x', 'rule': 'unknown field'}}] WHEN 4 THEN [{{'path': 'language', 'rule': 'must be zh or en'}}]
        ELSE [CASE WHEN f = 1 THEN {{'path': 'facts_confirmed', 'rule': 'facts not confirmed'}} END, CASE WHEN NOT told THEN {{'path': 'sections', 'rule': 'no content'}} END, CASE WHEN f = 5 THEN {{'path': 'headline', 'rule': 'unresolved placeholder'}} END] END, lambda x: x IS NOT NULL) AS l FROM b)
    SELECT id, CAST(k - 1 AS INT) AS ord, l[k].path AS path, l[k].rule AS rule FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS k FROM r)"""
)
def profile_breaches(t: Tables) -> DataFrame:
    """Every rule that a profile breaks before it may be published, in the order of the rules."""
    text = F.to_json("profile")
    rows = profiles(t).select("id", F.when(F.col("id") % 6 == 3, F.regexp_replace(text, r"^\{", '{"x":1,')).otherwise(text).alias("profile"))
    return P.validate(rows, keep=["id"])


# The classifier


def told_lives(t: Tables) -> DataFrame:
    """A text per customer, as one block: name, contact, its orders under a heading, skills, and a section of no known kind."""
    word = F.initcap(F.lower("c_mktsegment"))
    w = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    y = F.year("o_orderdate").cast("string")
    entry = w("\nWorks ", F.col("o_orderstatus"), "\n", y, "-", (F.year("o_orderdate") + 2).cast("string"), "\n- Sold order ", F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, "\n  and the rest").otherwise(""))
    told = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e")))), lambda o: o["e"]), "").alias("told"))
    rows = t.customer.join(told, "c_custkey", "left")
    text = w("Mira ", word, "\nc", F.col("c_custkey"), "@b.org\nWork Experience", F.coalesce("told", F.lit("")), "\nSkills\n- ", word, "\nAwards\nPrize ", F.col("c_custkey"))
    none = F.lit(None).cast("string")
    return rows.select(F.col("c_custkey").cast("string").alias("source_id"), F.lit(1).alias("seq"), F.lit("b1").alias("block_id"), text.alias("text"), F.lit("{}").alias("locator"), F.lit("[]").alias("links"), F.lit("en").alias("language"), F.array().cast("array<string>").alias("warnings"), none.alias("path"))


LIVES_SQL = """c AS (SELECT c_custkey AS id, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) AS word FROM customer), e AS (
      SELECT o_custkey AS id, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, 'Works ' || o_orderstatus AS heading, year(o_orderdate) || '-' || (year(o_orderdate) + 2) AS date FROM orders WHERE o_custkey IN (SELECT id FROM c))"""


@query(
    f"""WITH {LIVES_SQL}, l AS (
      SELECT id, 0 AS a, 0 AS b, 'name_candidate' AS interpretation, 'name' AS paths, CAST(NULL AS VARCHAR) AS reason FROM c UNION ALL SELECT id, 1, 0, 'contact_candidate', 'contacts[0]', NULL FROM c UNION ALL SELECT id, 2, 0, 'section_candidate', 'sections[0].title', NULL FROM c
      UNION ALL SELECT id, 3 + k, 0, 'entry_heading_candidate', 'sections[0].entries[' || k || '].heading', NULL FROM e UNION ALL SELECT id, 3 + k, 1, 'date_candidate', 'sections[0].entries[' || k || '].date', NULL FROM e
      UNION ALL SELECT id, 3 + k, 2, 'original_bullet', 'sections[0].entries[' || k || '].bullets[0]', NULL FROM e UNION ALL SELECT id, 3 + k, 3, 'continuation_candidate', 'sections[0].entries[' || k || '].bullets[0]', NULL FROM e WHERE o % 2 = 0
      UNION ALL SELECT id, 1000000, 0, 'section_candidate', 'sections[1].title', NULL FROM c UNION ALL SELECT id, 1000000, 1, 'original_bullet', 'sections[1].entries[0].bullets[0]', NULL FROM c
      UNION ALL SELECT id, 1000000, 2, 'unsupported_section_candidate', 'sections[2].title', 'unsupported_section_heading' FROM c UNION ALL SELECT id, 1000000, 3, 'unclassified', 'sections[2].entries[0].bullets[0]', 'not_classified' FROM c)
    SELECT CAST(id AS VARCHAR) AS source_id, CAST(row_number() OVER (PARTITION BY id ORDER BY a, b) AS INT) AS seq, interpretation, paths, reason FROM l"""
)
def classified_lines(t: Tables) -> DataFrame:
    """What the classifier makes of every line of the customers' texts."""
    found = classify.claims(told_lives(t))
    return found.select("source_id", "seq", "interpretation", F.array_join("resume_paths", ",").alias("paths"), F.col("remaining_reason").alias("reason"))


@query(
    f"""WITH {LIVES_SQL}, a AS (
      SELECT id, 'name' AS path, 'Mira ' || word AS value FROM c UNION ALL SELECT id, 'headline', '' FROM c UNION ALL SELECT id, 'contacts[0]', 'c' || id || '@b.org' FROM c
      UNION ALL SELECT DISTINCT id, 'sections[0].title', 'Experience' FROM e UNION ALL SELECT id, 'sections[0].entries[' || k || '].heading', heading FROM e UNION ALL SELECT id, 'sections[0].entries[' || k || '].date', date FROM e
      UNION ALL SELECT id, 'sections[0].entries[' || k || '].bullets[0]', 'Sold order ' || o || CASE WHEN o % 2 = 0 THEN ' and the rest' ELSE '' END FROM e
      UNION ALL SELECT id, unnest(['sections[1].title', 'sections[1].entries[0].heading', 'sections[1].entries[0].date', 'sections[1].entries[0].bullets[0]', 'sections[2].title', 'sections[2].entries[0].heading', 'sections[2].entries[0].date', 'sections[2].entries[0].bullets[0]']),
        unnest(['Skills', '', '', word, 'Awards', '', '', 'Prize ' || id]) FROM c)
    SELECT CAST(id AS VARCHAR) AS source_id, path, value FROM a"""
)
def classified_fields(t: Tables) -> DataFrame:
    """The drafts that come of the customers' texts, field by field."""
    drafts = classify.profiles(told_lives(t)).select("source_id", P.as_struct("profile").alias("profile"))
    return P.visible_fields(drafts, keep=["source_id"]).drop("ord")


@query(
    rf"""WITH {PROFILES_SQL}, x AS (SELECT id, replace(name, '#', '\#') AS name, headline, contact FROM c), t AS (SELECT id, string_agg(chr(10) || '\textbf{{' || heading || '}}\par' || chr(10) || date || '\par' || chr(10) || '\begin{{itemize}}' || chr(10) || '\item ' || bullet || chr(10) || '\end{{itemize}}', '' ORDER BY k) AS body FROM e GROUP BY id)
    SELECT id, '\documentclass[literaltext]{{resume}}' || chr(10) || '\begin{{document}}' || chr(10) || '\pagenumbering{{gobble}}' || chr(10) || '\raggedright' || CASE WHEN trim(name) <> '' THEN chr(10) || '\name{{' || name || '}}' ELSE '' END
      || chr(10) || '{{\centering\small' || chr(10) || contact || '\par' || chr(10) || '}}\vspace{{0.7ex}}' || CASE WHEN headline <> '' THEN chr(10) || '{{\centering ' || headline || '\par}}\vspace{{0.6ex}}' ELSE '' END
      || CASE WHEN body IS NOT NULL THEN chr(10) || '\section{{Experience}}' || body ELSE '' END || chr(10) || '\end{{document}}' || chr(10) AS tex FROM x LEFT JOIN t USING (id)"""
)
def tex_profiles(t: Tables) -> DataFrame:
    """Profiles as TeX, in the plain theme."""
    return profiles(t).select("id", render.rendered(F.to_json("profile"), "tex-plain").alias("tex"))
