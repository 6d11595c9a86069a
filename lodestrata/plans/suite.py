"""The registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T, values as X, vocabulary as V
from ..operators import claims, conflicts, coverage, integrity, presence, reservation, scoring, segments as S
from ..sources import html
from . import derived, evidence  # noqa: F401  they register their queries
from .registry import LINES, ORACLES, QUERIES, Tables, query

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["page_coverage"](spark, sf_dir)


@query(
    f"""WITH n AS ({LINES}), m AS (
      SELECT *, trim(raw, ' ' || chr(9)) = '' AS blank, sum(CASE WHEN trim(raw, ' ' || chr(9)) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS island FROM n
    ), g AS (SELECT doc_id, island, min(line) AS a, max(line) AS b, trim(string_agg(raw, chr(10) ORDER BY line), ' ' || chr(9) || chr(10)) AS text FROM m WHERE NOT blank GROUP BY 1, 2)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) AS INT) AS paragraph, CAST(a AS INT) AS line_start, CAST(b AS INT) AS line_end, text FROM g"""
)
def doc_paragraphs(t: Tables) -> DataFrame:
    return S.paragraphs(t.documents, keep=["doc_id"])


@query(f"SELECT doc_id, CAST(line AS INT) AS line_in_block, trim(raw) AS text, raw AS raw_text FROM ({LINES}) WHERE trim(raw) <> ''")
def doc_segments(t: Tables) -> DataFrame:
    return S.segments(t.documents, keep=["doc_id"]).drop("indent")


@query(f"SELECT doc_id, CAST(line AS INT) AS line_in_block, CAST(length(raw) - length(ltrim(raw)) AS INT) AS indent FROM ({LINES}) WHERE trim(raw) <> ''")
def segment_indent(t: Tables) -> DataFrame:
    return S.segments(t.documents, keep=["doc_id"]).select("doc_id", "line_in_block", "indent")


@query(
    f"""WITH s AS (SELECT source, doc_id, trim(raw) AS text FROM ({LINES}) JOIN documents USING (doc_id) WHERE trim(raw) <> ''), a AS (
      SELECT source, count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(text, '^\\s*(?:[*•●▪◦‣]\\s*|\\d+[.)、]\\s+|-([^\\d.$€£¥]|$)).*$')) AS plain FROM s GROUP BY source), d AS (
      SELECT source, count(*) AS source_blocks, CAST(sum(coalesce(len(regexp_extract_all(text, '[^\\n]*[^\\s][^\\n]*')), 0)) AS BIGINT) AS segments FROM documents GROUP BY source)
    SELECT d.source, source_blocks, segments, coalesce(n, 0) AS accounted_segments, coalesce(plain, 0) AS unclassified_segments, segments = coalesce(n, 0) AS complete FROM d LEFT JOIN a USING (source)"""
)
def coverage_ledger(t: Tables) -> DataFrame:
    """Documents' visible lines against the claims that the assembly makes of them."""
    made = claims.assembled_claims(t.documents, "source", "doc_id").select("doc_id", "line", "text")
    return coverage.ledger(t.documents, made, "source", "doc_id", "text")


@query(
    """SELECT doc_id, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) AS cjk, len(regexp_extract_all(text, '[A-Za-z]')) AS latin,
    CASE WHEN len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) > 0 AND len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) >= len(regexp_extract_all(text, '[A-Za-z]')) / 3.0 THEN 'zh' ELSE 'en' END AS language FROM documents"""
)
def language_heuristic(t: Tables) -> DataFrame:
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    return t.documents.select("doc_id", count(r"[\x{4e00}-\x{9fff}]").alias("cjk"), count("[A-Za-z]").alias("latin"), T.language("text").alias("language"))


PHONE_SQL = r"(^|[^0-9])((\+\d{1,3}[ .\-]?)?(\(?\d{3}\)?[ .\-]?)?\d{3}[ .\-]\d{4}|1[3-9]\d{9})($|[^0-9])"


@query(
    rf"""WITH s AS (SELECT doc_id, CAST(line AS INT) AS line_in_block, trim(raw) AS text FROM ({LINES}) WHERE trim(raw) <> ''), f AS (
      SELECT *, regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{{2,}}($|[^\p{{L}}\p{{N}}_])') AS has_email,
      regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])((https?://|www\.)\S+|(github\.com|linkedin\.com)/\S+|[a-z0-9][a-z0-9.\-]*\.[a-z]{{2,}}/\S+)') AS has_url,
      regexp_matches(text, '{PHONE_SQL}') AS has_phone FROM s)
    SELECT doc_id, line_in_block, has_email, has_url, has_phone, length(text) <= 180 AS contact FROM f WHERE has_email OR has_url OR has_phone"""
)
def contact_candidates(t: Tables) -> DataFrame:
    rows = S.segments(t.documents, keep=["doc_id"]).select("doc_id", "line_in_block", "text", T.has_email("text").alias("has_email"), T.has_url("text").alias("has_url"), T.has_phone("text").alias("has_phone"))
    return rows.filter("has_email or has_url or has_phone").select("doc_id", "line_in_block", "has_email", "has_url", "has_phone", T.contact_candidate("text").alias("contact"))


@query()
def html_blocks(t: Tables) -> DataFrame:
    return html.html_blocks(t.pages, keep=["page_id"])


@query()
def html_links(t: Tables) -> DataFrame:
    links = html.html_blocks(t.pages, keep=["page_id"]).select("page_id", "seq", F.explode("links").alias("link"))
    return links.filter(T.readable_link(F.col("link.target"))).select("page_id", "seq", "link.target", "link.text_start", "link.text_end", "link.text", T.link_contact(F.col("link.target")).alias("contact"))


@query()
def page_coverage(t: Tables) -> DataFrame:
    """Pages to blocks, segments and line kinds, with the count that must agree."""
    return coverage.page_coverage(html.html_blocks(t.pages, keep=["page_id"]), "page_id")


@query(
    """SELECT event_id, '$["' || j.key || '"]' AS path, CASE WHEN j.type = 'VARCHAR' THEN j.atom ->> '$' ELSE CAST(j.atom AS VARCHAR) END AS value
    FROM events, json_tree(props) j WHERE j.atom IS NOT NULL AND j.type NOT IN ('OBJECT', 'ARRAY', 'NULL')"""
)
def json_leaves(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", X.json_leaves("props").alias("j"))
    return rows.select("event_id", F.explode("j.leaves").alias("leaf")).select("event_id", "leaf.*")


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_fingerprint_groups(t: Tables) -> DataFrame:
    return integrity.fingerprint_groups(t.documents, "text", "doc_id")


@query(
    """WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY 1, 2)
    SELECT user_id, string_agg(event_type, '>' ORDER BY first) AS "values" FROM f GROUP BY 1"""
)
def ordered_distinct_values(t: Tables) -> DataFrame:
    return integrity.ordered_distinct(t.events, "user_id", "event_type", "ts", "event_id").select("user_id", F.array_join("values", ">").alias("values"))


@query(
    """SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS chosen,
    string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS "values" FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1"""
)
def value_conflicts(t: Tables) -> DataFrame:
    found = conflicts.value_conflicts(t.orders, "o_custkey", "o_orderstatus")
    return found.select("o_custkey", F.col("n_values").cast("long").alias("n_values"), "chosen", F.array_join("values", ",").alias("values"))


@query(
    """WITH w AS (SELECT lower(string_split(trim(text), ' ')[1]) AS key, string_split(trim(text), ' ')[1] || '/' || role AS value, lower(role) AS normal FROM conversations)
    SELECT key, count(DISTINCT normal) AS n_normal, string_agg(DISTINCT value, ',' ORDER BY value) AS "values" FROM w GROUP BY key HAVING count(DISTINCT normal) > 1"""
)
def normalized_conflicts(t: Tables) -> DataFrame:
    word = F.element_at(F.split(F.trim("text"), " "), 1)
    rows = t.conversations.select(word.alias("word"), F.concat(word, F.lit("/"), "role").alias("value"), "role")
    return conflicts.normalized_conflicts(rows, F.lower("word"), "value", F.lower("role")).select("key", "n_normal", F.array_join("values", ",").alias("values"))


@query(
    """SELECT 'lineitem' AS table_name, l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS part, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'conversations', conv_id, turn, count(*) FROM conversations GROUP BY ALL HAVING count(*) > 1"""
)
def duplicate_ids(t: Tables) -> DataFrame:
    lines = integrity.duplicate_ids(t.lineitem, "l_orderkey", "l_linenumber").select(F.lit("lineitem").alias("table_name"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("part"), "n")
    turns = integrity.duplicate_ids(t.conversations, "conv_id", "turn").select(F.lit("conversations").alias("table_name"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "n")
    return lines.unionByName(turns)


@query(
    """SELECT 'label' AS kind, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'lineitem', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""
)
def unknown_references(t: Tables) -> DataFrame:
    docs = integrity.unknown_references(t.documents, "doc_id", t.labels, "doc_id").select(F.lit("label").alias("kind"), F.col("doc_id").alias("id"))
    return docs.unionByName(integrity.unknown_references(t.orders, "o_orderkey", t.lineitem, "l_orderkey").select(F.lit("lineitem").alias("kind"), F.col("o_orderkey").alias("id")))


@query(
    """WITH c AS (SELECT conv_id, turn, unnest([turn - 1, turn, turn + 1]) AS cited FROM conversations)
    SELECT c.conv_id, c.turn, c.cited, CASE WHEN f.turn IS NULL THEN 'unknown' WHEN f.turn > c.turn THEN 'future' ELSE 'valid' END AS validity
    FROM c LEFT JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = c.cited"""
)
def temporal_validity(t: Tables) -> DataFrame:
    cited = t.conversations.select("conv_id", "turn", F.explode(F.array(F.col("turn") - 1, "turn", F.col("turn") + 1)).alias("cited"))
    facts = t.conversations.select("conv_id", F.col("turn").alias("source_turn"))
    return integrity.temporal_validity(cited, facts, "conv_id", "cited", "turn", "source_turn")


@query("SELECT conv_id, count(*) AS n, min(turn) AS first, max(turn) AS last, count(DISTINCT turn) = count(*) AND max(turn) - min(turn) + 1 = count(*) AS contiguous FROM conversations GROUP BY 1")
def turn_contiguity(t: Tables) -> DataFrame:
    return integrity.contiguity(t.conversations, "conv_id", "turn")


@query(
    """WITH q AS (SELECT conv_id, turn, text AS quote FROM conversations), s AS (SELECT conv_id, turn + 1 AS turn, text FROM conversations WHERE role = 'user')
    SELECT q.conv_id, q.turn, q.quote, coalesce(trim(q.quote) <> '' AND contains(s.text, q.quote), false) AS contained FROM q LEFT JOIN s USING (conv_id, turn)"""
)
def quote_in_turn(t: Tables) -> DataFrame:
    quotes = t.conversations.select("conv_id", "turn", F.col("text").alias("quote"))
    texts = t.conversations.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), "text")
    return integrity.quotes_in(quotes, texts, ["conv_id", "turn"], "quote", "text")


@query(
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS user_turn FROM conversations"""
)
def carry_forward_section(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "role")
    return integrity.carry_forward(rows, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "user_turn").select("conv_id", "turn", "user_turn")


@query(
    f"""WITH l AS (SELECT doc_id, CAST(line AS INT) AS line, length(raw) AS n FROM ({LINES})), w AS (
      SELECT *, lead(n, 1) OVER (PARTITION BY doc_id ORDER BY line) AS next_n, lead(n, 2) OVER (PARTITION BY doc_id ORDER BY line) AS after_n FROM l)
    SELECT doc_id, line, CAST(n AS INT) AS n, CAST(next_n AS INT) AS next_n, CAST(after_n AS INT) AS after_n FROM w WHERE n <= 40"""
)
def short_line_pairs(t: Tables) -> DataFrame:
    return S.short_line_pairs(t.documents, "doc_id")


@query(
    """WITH n AS (SELECT user_id, max((ts, event_id)) AS newest FROM events GROUP BY 1)
    SELECT e.event_id, e.user_id, CASE WHEN e.event_id = n.newest[2] THEN 'CURRENT' ELSE 'STALE' END AS state, CASE WHEN e.event_id <> n.newest[2] THEN n.newest[2] END AS superseded_by FROM events e JOIN n USING (user_id)"""
)
def revision_state(t: Tables) -> DataFrame:
    return integrity.revision_states(t.events.select("event_id", "user_id", "ts"), "user_id", "event_id", "ts").drop("ts")


@query(
    """WITH a AS (SELECT doc_id, sha256(text) AS before FROM documents), b AS (SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS after FROM documents)
    SELECT doc_id, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'missing' ELSE 'changed' END AS state, before, after FROM a FULL JOIN b USING (doc_id) WHERE before IS DISTINCT FROM after"""
)
def stale_fingerprints(t: Tables) -> DataFrame:
    before = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    after = t.documents.select("doc_id", F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256).alias("digest"))
    return integrity.stale(before, after, "doc_id", "digest")


@query(
    """SELECT d.doc_id, CAST(60.0 * l.quality + 40.0 * (1 - l.toxic) AS DOUBLE) AS score, CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 100 END AS BIGINT) AS assessed FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def weighted_score(t: Tables) -> DataFrame:
    dims = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    levels = dims.select("doc_id", F.explode(F.array(F.struct((F.col("quality") * 4).alias("level"), F.lit(60).alias("weight")), F.struct(((1 - F.col("toxic")) * 4).alias("level"), F.lit(40).alias("weight")))).alias("d"))
    return scoring.weighted_score(levels.select("doc_id", "d.*"), ["doc_id"], "level", "weight")


@query(
    """WITH g AS (SELECT c_nationkey AS k, count(*) AS given FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY 1), r AS (SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier)
    SELECT CASE WHEN given IS NULL THEN 'missing' WHEN r.k IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem, coalesce(r.k, g.k) AS nation FROM r FULL JOIN g ON r.k = g.k WHERE given IS NULL OR r.k IS NULL OR given > 1"""
)
def mapping_exhaustive(t: Tables) -> DataFrame:
    required = t.nation.select(F.col("n_nationkey").alias("nation")).unionByName(t.supplier.select(F.col("s_nationkey").alias("nation")))
    given = t.customer.select(F.col("c_nationkey").alias("nation"), "c_mktsegment").distinct()
    return integrity.exhaustive(required, given, "nation")


#: The clues as the other engine writes them: its \\b knows ASCII only.
CLUES_SQL = {role: p.replace("\\b", r"($|[^\p{L}\p{N}_])") for role, p in V.ROLE_CLUES.items()}
NEGATIVE_SQL = r"不(会|懂|熟悉|擅长|负责)|没有|未(使用|掌握|负责)|无经验|(^|[^\p{L}\p{N}_])(no|not|never|without|lack|cannot|can.t)($|[^\p{L}\p{N}_])"


@query(
    f"""WITH t AS (SELECT c_nationkey AS scope, c_name || '; ' || c_mktsegment AS text FROM customer UNION ALL SELECT conv_id % 25, role || ': ' || text FROM conversations UNION ALL SELECT doc_id % 25, text FROM documents), c AS (
      SELECT scope, list_filter(regexp_split_to_array(text, '[。；;\\n]'), lambda x: NOT regexp_matches(x, '(?i){NEGATIVE_SQL}')) AS cl FROM t WHERE regexp_matches(text, '(?i){"|".join(CLUES_SQL.values())}')), r AS (
      SELECT scope, unnest([{", ".join(f"'{r}'" for r in CLUES_SQL)}]) AS role, unnest(range({len(CLUES_SQL)})) AS ord, unnest([{", ".join(f"'{p}'" for p in CLUES_SQL.values())}]) AS p, cl FROM c), h AS (
      SELECT scope, role, ord, count(*) AS n FROM r WHERE len(list_filter(cl, lambda x: regexp_matches(x, '(?i)(' || p || ')'))) > 0 GROUP BY ALL), k AS (
      SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC, ord) AS rank FROM h)
    SELECT scope, CAST(rank AS INT) AS rank, role, n FROM k WHERE rank <= 3"""
)
def top_directions(t: Tables) -> DataFrame:
    """What customers' names, turns with their speakers and documents give clues of, by 25 scopes."""
    names = t.customer.select(F.col("c_nationkey").cast("long").alias("scope"), F.concat("c_name", F.lit("; "), "c_mktsegment").alias("text"))
    turns = t.conversations.select((F.col("conv_id") % 25).alias("scope"), F.concat("role", F.lit(": "), "text").alias("text"))
    docs = t.documents.select((F.col("doc_id") % 25).alias("scope"), "text")
    return scoring.top_directions(names.unionByName(turns).unionByName(docs), "scope", "text")


@query(
    r"""WITH a AS (SELECT doc_id AS id, 'document' AS kind, text FROM documents UNION ALL SELECT conv_id * 1000 + turn, 'turn', text FROM conversations)
    SELECT kind, id, regexp_matches(text, '(?i)\d+(\.\d+)?\s*(%|％|家|人|次|倍|hours?|days?|users?|clients?)|提升|增长|降低|improv|increas|reduc') AS has_number,
      regexp_matches(text, '(?i)主导|独立|全面负责|(led|lead|owned)($|[^\p{L}\p{N}_])|solely') AS has_ownership,
      regexp_matches(text, '(?i)负责|参与|协助|responsible|participat|assist|help') AS is_vague,
      regexp_matches(text, '(?i)不(会|懂|熟悉|擅长|负责)|没有|未(使用|掌握|负责)|无经验|(^|[^\p{L}\p{N}_])(no|not|never|without|lack|cannot|can.t)($|[^\p{L}\p{N}_])') AS is_negative FROM a"""
)
def coaching_flags(t: Tables) -> DataFrame:
    docs = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    turns = t.conversations.select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return docs.unionByName(turns).withColumns(scoring.coaching_flags("text")).drop("text")


@query("SELECT conv_id, min(turn) AS turn, arg_min(text, turn) AS text FROM conversations WHERE regexp_matches(text, '(?i)tion') GROUP BY 1")
def first_match(t: Tables) -> DataFrame:
    return scoring.first_match(t.conversations, "conv_id", "turn", "text", T.found("text", "tion"))


@query(
    """WITH p AS (SELECT p_partkey, replace(lower(p_type), ' ', '.') || '.' || lower(replace(p_brand, '#', '')) AS path FROM part), f AS (SELECT DISTINCT string_split(path, '.')[1] AS prefix FROM p)
    SELECT f.prefix, count(*) AS n, min(p_partkey) AS first_part FROM p JOIN f ON p.path = f.prefix OR starts_with(p.path, f.prefix || '.') GROUP BY 1"""
)
def path_prefix_join(t: Tables) -> DataFrame:
    paths = t.part.select("p_partkey", F.concat(F.regexp_replace(F.lower("p_type"), " ", "."), F.lit("."), F.lower(F.regexp_replace("p_brand", "#", ""))).alias("path"))
    prefixes = paths.select(F.element_at(F.split("path", r"\."), 1).alias("prefix")).distinct()
    return scoring.under_prefix(paths, "path", prefixes, "prefix").groupBy("prefix").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


PRESENT = """SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b
    ON contains(' ' || trim(regexp_replace(d.text, '\\s+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(b.text, '\\s+', ' ', 'g')) || ' ')"""


@query(PRESENT)
def text_presence(t: Tables) -> DataFrame:
    return presence.token_presence(t.documents, t.benchmark, "doc_id", "text", "item_id", "text")


@query(
    f"""WITH RECURSIVE i AS (SELECT item_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS whole FROM benchmark), e AS (
      SELECT item_id, whole, len(l) + 1 AS n_expected, unnest(range(len(l) + 1)) AS k, unnest(list_append(l, whole)) AS want FROM i WHERE whole <> ''
    ), d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS joined FROM documents), c AS MATERIALIZED (
      SELECT doc_id, item_id, n_expected, k, string_split(want, ' ') AS want, string_split(d.joined, ' ') AS have FROM d JOIN e ON contains(' ' || d.joined || ' ', ' ' || e.whole || ' ')
    ), p AS (SELECT doc_id, item_id, k, len(want) AS n, unnest(list_filter(range(1, len(have) - len(want) + 2), lambda x: have[x:x + len(want) - 1] = want)) AS low FROM c), o AS (
      SELECT *, low + n AS high, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, k, low) AS r FROM p
    ), g AS (
      SELECT doc_id, item_id, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(k BIGINT, low BIGINT, high BIGINT)[]) AS taken FROM o GROUP BY ALL
      UNION ALL SELECT o.doc_id, o.item_id, o.r, CASE WHEN len(list_filter(taken, lambda x: x.k = o.k OR (x.low < o.high AND x.high > o.low))) > 0 THEN taken ELSE list_append(taken, {{'k': o.k, 'low': o.low, 'high': o.high}}) END
      FROM g JOIN o ON o.doc_id = g.doc_id AND o.item_id = g.item_id AND o.r = g.r + 1
    ), z AS (SELECT doc_id, item_id, arg_max(taken, r) AS taken FROM g GROUP BY ALL)
    SELECT doc_id, item_id AS ord, any_value(n_expected) AS n_expected, string_agg(CASE WHEN len(list_filter(taken, lambda x: x.k = c.k)) = 0 THEN CAST(k AS VARCHAR) END, ',' ORDER BY k) AS missing FROM c JOIN z USING (doc_id, item_id) GROUP BY ALL"""
)
def text_coverage_exclusive(t: Tables) -> DataFrame:
    """For each document that holds an item: which of the item's lines, and of the item as a whole, have no place of their own."""
    lines = F.filter(F.transform(T.lines(F.col("text")), T.collapse), lambda x: x != "")
    items = t.benchmark.select("item_id", F.array_append(lines, T.collapse("text")).alias("expected")).filter("expected[size(expected) - 1] <> ''")
    hits = presence.token_presence(t.documents, t.benchmark, "doc_id", "text", "item_id", "text")
    wants = items.select("item_id", F.posexplode("expected").alias("k", "want")).select(F.struct("item_id", "k").alias("id"), "want")
    places = presence.token_places(t.documents, wants, "doc_id", "text", "id", "want").select("doc_id", F.col("id.item_id").alias("item_id"), F.col("id.k").alias("k"), "at", "n")
    own = places.join(hits, ["doc_id", "item_id"], "left_semi").select(F.struct("doc_id", "item_id").alias("s"), "k", F.col("at").alias("low"), (F.col("at") + F.col("n")).alias("high"))
    given = reservation.exclusive_places(own, "s", ["k"]).groupBy("s").agg(F.collect_set(F.when(F.col("low").isNotNull(), F.col("k"))).alias("given"))
    wanted = given.select("s.*", "given").join(items.select("item_id", F.size("expected").alias("n")), "item_id")
    missing = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), "given")
    return wanted.select("doc_id", F.col("item_id").alias("ord"), F.col("n").cast("long").alias("n_expected"), F.when(F.size(missing) > 0, F.array_join(missing, ",")).alias("missing"))


@query("SELECT n_nationkey, n_name || ' lies in ' || r_name || ' {' || n_regionkey || '}' AS value, CAST(NULL AS VARCHAR) AS error FROM nation JOIN region ON n_regionkey = r_regionkey")
def template_expand(t: Tables) -> DataFrame:
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    values = F.create_map(F.lit("nation"), "n_name", F.lit("region"), "r_name", F.lit("key"), F.col("n_regionkey").cast("string"))
    return rows.select("n_nationkey", X.render_template(F.lit("{nation} lies in {region} {{{key}}}"), values).alias("e")).select("n_nationkey", "e.*")


@query(
    """SELECT 'documents' AS table_name, doc_id AS id, unnest(list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'text is empty' END, CASE WHEN n_chars <> length(text) THEN 'n_chars differs from the text' END,
      CASE WHEN lang NOT IN ('en', 'de') THEN 'lang is not supported' END, CASE WHEN regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') THEN 'text has control characters' END], lambda x: x IS NOT NULL)) AS rule FROM documents
    UNION ALL SELECT 'customer', c_custkey, unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'balance is negative' END, CASE WHEN trim(c_name) = '' THEN 'name is empty' END, CASE WHEN c_mktsegment IS NULL THEN 'segment is missing' END], lambda x: x IS NOT NULL)) FROM customer"""
)
def validation_violations(t: Tables) -> DataFrame:
    docs = coverage.violations(
        t.documents,
        {
            "text is empty": F.col("text").isNull() | (T.strip("text") == ""),
            "n_chars differs from the text": F.col("n_chars") != F.length("text"),
            "lang is not supported": ~F.col("lang").isin("en", "de"),
            "text has control characters": F.col("text").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"),
        },
        F.lit("documents").alias("table_name"),
        F.col("doc_id").alias("id"),
    )
    customers = coverage.violations(
        t.customer,
        {"balance is negative": F.col("c_acctbal") < 0, "name is empty": T.strip("c_name") == "", "segment is missing": F.col("c_mktsegment").isNull()},
        F.lit("customer").alias("table_name"),
        F.col("c_custkey").alias("id"),
    )
    return docs.unionByName(customers)


@query(
    """SELECT source, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, count(*) > 10000 AS too_many_blocks, sum(length(text)) > 2000000 AS too_many_chars, max(strlen(text)) > 10485760 AS too_large FROM documents GROUP BY 1"""
)
def budget_guards(t: Tables) -> DataFrame:
    return coverage.budgets(t.documents, "source", "text")


@query(
    r"""WITH g AS (SELECT d.doc_id, regexp_matches(text, '(?i)【\s*(待确认|待补充|待填写|待填)[^】]*】|\[TODO[^\]]*\]|(^|[^\p{L}\p{N}_])(TODO|TBD|YYYY)($|[^\p{L}\p{N}_])') AS has_placeholder, coalesce(l.quality = 1, false) AS confirmed FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT doc_id, has_placeholder, confirmed, confirmed AND NOT has_placeholder AS final FROM g"""
)
def final_gate(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", T.placeholder("text").alias("has_placeholder"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("confirmed"))
    return rows.withColumn("final", F.col("confirmed") & ~F.col("has_placeholder"))
