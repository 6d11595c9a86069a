"""Queries of the order- and reference-dependent operators over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T, values as X
from ..operators import chains, claims, headers, islands, overlap, presence, reservation, tolerant
from .registry import LINES, Tables, query

SHORT_LINE, LONG_LINE = 20, 60


def by_length(line):
    """Header rules by length alone: a short line ends a header that one or two longer ones open."""
    n = F.length(line)
    return F.struct((n <= 5).alias("alone"), n.between(SHORT_LINE + 1, LONG_LINE).alias("opens"), n.between(6, SHORT_LINE).alias("closes"))


@query(
    f"""WITH RECURSIVE l AS (SELECT doc_id, line, length(raw) AS n FROM ({LINES})), f AS (
      SELECT doc_id, line, n <= 5 AS alone, n BETWEEN {SHORT_LINE + 1} AND {LONG_LINE} AS opens, n BETWEEN 6 AND {SHORT_LINE} AS closes FROM l
    ), w AS (
      SELECT *, lead(opens) OVER d AS opens1, lead(closes) OVER d AS closes1, lead(closes, 2) OVER d AS closes2 FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY line)
    ), h AS (
      SELECT doc_id, line, CASE WHEN alone THEN 0 WHEN opens AND closes1 THEN 1 WHEN opens AND opens1 AND closes2 THEN 2 END AS reach FROM w
    ), r AS (
      SELECT doc_id, line, reach FROM h WHERE line = 1
      UNION ALL SELECT h.doc_id, h.line, h.reach FROM r JOIN h ON h.doc_id = r.doc_id AND h.line = r.line + 1 + coalesce(r.reach, 0)
    ) SELECT doc_id, CAST(line AS INT) AS line, CAST(reach AS INT) AS reach FROM r WHERE reach IS NOT NULL"""
)
def header_groups(t: Tables) -> DataFrame:
    return headers.header_groups(t.documents, "doc_id", flags=by_length)


EXPECTED = """SELECT item_id, unnest([0, 1, 2]) AS part, unnest([w, w[:len(w) // 2], w[len(w) // 2 + 1:]]) AS want
      FROM (SELECT item_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark WHERE text IS NOT NULL)"""


def expected_parts(t: Tables) -> DataFrame:
    """Each benchmark item as a whole (part 0) and its two halves."""
    words = t.benchmark.select("item_id", F.split(T.collapse("text"), " ").alias("w"))
    half = F.floor(F.size("w") / 2).cast("int")
    parts = F.array(F.col("w"), F.slice("w", F.lit(1), half), F.slice("w", half + 1, F.size("w")))
    rows = words.select("item_id", F.posexplode(parts).alias("part", "want")).filter("size(want) > 0")
    return rows.select((F.col("item_id") * 3 + F.col("part")).alias("want_id"), F.array_join("want", " ").alias("want"))


@query(
    f"""WITH RECURSIVE e AS (SELECT item_id, part, want, array_to_string(want, ' ') AS joined FROM ({EXPECTED}) WHERE len(want) > 0), d AS (
      SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS joined FROM documents
    ), c AS MATERIALIZED (
      SELECT doc_id, item_id, part, want, string_split(d.joined, ' ') AS have FROM d JOIN e ON contains(' ' || d.joined || ' ', ' ' || e.joined || ' ')
    ), p AS (
      SELECT doc_id, item_id, part, len(want) AS n, unnest(list_filter(range(1, len(have) - len(want) + 2), lambda k: have[k:k + len(want) - 1] = want)) - 1 AS low FROM c
    ), o AS (
      SELECT *, low + n AS high, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item_id * 3 + part, low) AS k FROM p
    ), r AS (
      SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(w BIGINT, low BIGINT, high BIGINT)[]) AS taken FROM o GROUP BY doc_id
      UNION ALL SELECT o.doc_id, o.k, CASE WHEN len(list_filter(taken, lambda x: x.w = o.item_id * 3 + o.part OR (x.low < o.high AND x.high > o.low))) > 0 THEN taken
        ELSE list_append(taken, {{'w': o.item_id * 3 + o.part, 'low': o.low, 'high': o.high}}) END FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1
    ), z AS (
      SELECT doc_id, unnest(taken) AS x FROM (SELECT doc_id, arg_max(taken, k) AS taken FROM r GROUP BY doc_id)
    )
    SELECT q.doc_id, q.want AS want_id, CAST(z.x.low AS INT) AS low, CAST(z.x.high AS INT) AS high FROM (SELECT DISTINCT doc_id, item_id * 3 + part AS want FROM o) q LEFT JOIN z ON z.doc_id = q.doc_id AND z.x.w = q.want"""
)
def reserved_spans(t: Tables) -> DataFrame:
    """Benchmark items and their halves in every document that has them: a place serves one text, so a half that only stands within its whole has none."""
    places = presence.token_places(t.documents, expected_parts(t), "doc_id", "text", "want_id", "want")
    return reservation.exclusive_places(places.select("doc_id", "want_id", F.col("at").alias("low"), (F.col("at") + F.col("n")).alias("high")), "doc_id", ["want_id"])


LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
BARE = "regexp_replace({}, '[\\s\\x{{00ad}}-]+', '', 'g')"


@query(
    rf"""WITH i AS (
      SELECT item_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS c, {BARE.format("text")} AS bare FROM benchmark WHERE trim(text) <> ''
    ), p AS (
      SELECT item_id, bare, (CASE WHEN regexp_matches(c[1], '{LETTER}|[0-9]') THEN '(?:^|[^A-Za-z0-9_À-ɏḀ-ỿ])' ELSE '' END) || array_to_string(list_transform(range(1, len(c) + 1), lambda k:
        CASE WHEN c[k] = ' ' THEN CASE WHEN c[k - 1] IN ('–', '—', '’', '”') OR c[k + 1] IN ('–', '—') THEN '\s*' ELSE '\s+' END
          WHEN k > 1 AND regexp_matches(c[k], '{LETTER}') AND regexp_matches(c[k - 1], '{LETTER}') THEN '(?:-[ \t]*\n[ \t]*)?' || c[k]
          WHEN k > 2 AND regexp_matches(c[k], '{LETTER}') AND c[k - 1] = '-' AND regexp_matches(c[k - 2], '{LETTER}') THEN '(?:[ \t]*\n[ \t]*)?' || c[k]
          WHEN regexp_matches(c[k], '[A-Za-z0-9À-ɏ]') THEN c[k] ELSE regexp_escape(c[k]) END), '') ||
        (CASE WHEN regexp_matches(c[len(c)], '[0-9]') THEN '(?:$|[^A-Za-z0-9_À-ɏ.,]|[.,](?:$|[^0-9]))' WHEN regexp_matches(c[len(c)], '{LETTER}') THEN '(?:$|[^A-Za-z0-9_À-ɏḀ-ỿ])' WHEN c[len(c)] IN ('.', ',') AND regexp_matches(c[len(c) - 1], '[0-9]') THEN '(?:$|[^0-9])' ELSE '' END) AS pattern FROM i
    ), d AS (SELECT doc_id, text, {BARE.format("text")} AS bare FROM documents WHERE text IS NOT NULL), m AS MATERIALIZED (
      SELECT doc_id, item_id, text, pattern FROM d JOIN p ON contains(d.bare, p.bare)
    ) SELECT doc_id, item_id FROM m WHERE regexp_matches(text, pattern)"""
)
def tolerant_presence(t: Tables) -> DataFrame:
    """Benchmark items in documents, however their lines were wrapped."""
    return tolerant.tolerant_presence(t.documents, t.benchmark, "doc_id", "text", "item_id", "text")


@query(
    f"""WITH l AS (SELECT doc_id, line, trim(raw) AS x FROM ({LINES})), m AS (
      SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM l
    ), s AS (
      SELECT *, CASE WHEN x <> '' AND (coalesce(before, '') = '' OR regexp_matches(before, '[.!?。！？;；]\\s*$') OR regexp_matches(x, '^(?:[*•●▪◦‣]\\s*|\\d+[.)、]\\s+|-([^\\d.$€£¥]|$)).*$')) THEN 1 ELSE 0 END AS starts FROM m
    ), g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY line) AS island FROM s WHERE x <> '')
    SELECT doc_id, CAST(min(line) AS INT) AS line_start, CAST(max(line) AS INT) AS line_end, CAST(count(*) AS INT) AS n_lines, replace(string_agg(x, chr(1) ORDER BY line), '-' || chr(1), '-') AS text FROM g GROUP BY doc_id, island""".replace("SELECT doc_id, CAST(min", "SELECT doc_id, line_start, line_end, n_lines, replace(text, chr(1), ' ') AS text FROM (SELECT doc_id, CAST(min") + ")"
)
def continued_lines(t: Tables) -> DataFrame:
    return islands.continued_lines(t.documents, "doc_id")


@query(
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_discount, min(l_discount) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM (SELECT l_orderkey, l_linenumber, min(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2)), b AS (
      SELECT *, least IS NULL OR l_discount <= least AS begins FROM m)
    SELECT l_orderkey, l_linenumber, count(*) FILTER (WHERE begins) OVER w AS island, last_value(CASE WHEN begins THEN l_linenumber END IGNORE NULLS) OVER w AS anchor FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def anchored_islands(t: Tables) -> DataFrame:
    """An order's lines under the line whose discount none before undercuts."""
    return islands.anchored_islands(t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_discount").alias("l_discount")), ["l_orderkey"], "l_linenumber", "l_discount").drop("l_discount")


SECTIONS = f"""l AS (
      SELECT source, doc_id, line, trim(raw) AS text FROM ({LINES}) JOIN documents USING (doc_id) WHERE trim(raw) <> ''
    ), b AS (
      SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY line) + 1 THEN 0 ELSE 1 END AS begins FROM l
    ), s AS (
      SELECT *, sum(begins) OVER (PARTITION BY source ORDER BY doc_id, line) - 1 AS section, row_number() OVER (PARTITION BY source ORDER BY doc_id, line) AS nth FROM b
    )"""


@query(
    f"""WITH {SECTIONS} SELECT source, doc_id, CAST(line AS INT) AS line, 'claim-' || lpad(CAST(nth AS VARCHAR), 6, '0') AS claim_id,
      'sections[' || section || '].entries[' || (row_number() OVER (PARTITION BY source, section ORDER BY line) - 1) || ']' AS path, text FROM s"""
)
def assembled_claims(t: Tables) -> DataFrame:
    """Each source's documents as one: claims numbered without a gap, paths re-based."""
    return claims.assembled_claims(t.documents, "source", "doc_id")


@query(
    f"""WITH {SECTIONS}, g AS (SELECT source, doc_id, section, count(*) AS n_lines, lower(string_split(arg_min(text, line), ' ')[1]) AS wanted FROM s GROUP BY ALL), r AS (
      SELECT *, row_number() OVER (PARTITION BY source, wanted ORDER BY section) AS k FROM g)
    SELECT source, doc_id, CAST(section AS BIGINT) AS section, CAST(n_lines AS INT) AS n_lines, CASE WHEN k = 1 THEN wanted ELSE wanted || '-' || k END AS section_id FROM r"""
)
def assembled_sections(t: Tables) -> DataFrame:
    first = F.lower(F.element_at(F.split("title", " "), 1))
    return claims.assembled_sections(t.documents, "source", "doc_id", first)


CELLS = """SELECT l_orderkey AS "table", l_linenumber AS "row", unnest([0, 1, 2]) AS "column", unnest([min(l_returnflag), min(l_linestatus), CAST(min(l_suppkey % 3) AS VARCHAR)]) AS v FROM lineitem GROUP BY l_orderkey, l_linenumber"""


@query(
    f"""WITH c AS ({CELLS}), s AS (
      SELECT *, coalesce(v = lag(v) OVER w AND "row" = lag("row") OVER w + 1, false) AS goes_on FROM c WINDOW w AS (PARTITION BY "table", "column" ORDER BY "row")
    ), g AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY "table", "column" ORDER BY "row") AS island FROM s)
    SELECT "table", "row", "column", min("row") OVER i AS origin_row, "column" AS origin_column, count(*) OVER i AS row_span FROM g WINDOW i AS (PARTITION BY "table", "column", island)"""
)
def row_spans(t: Tables) -> DataFrame:
    """Orders as tables of three columns: a cell that repeats the one above continues it."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("table"), F.col("l_linenumber").alias("row")).agg(F.min("l_returnflag").alias("a"), F.min("l_linestatus").alias("b"), F.min(F.col("l_suppkey") % 3).cast("string").alias("c"))
    cells = lines.select("table", "row", F.posexplode(F.array("a", "b", "c")).alias("column", "v"))
    above = Window.partitionBy("table", "column").orderBy("row")
    same = F.coalesce((F.col("v") == F.lag("v").over(above)) & (F.col("row") == F.lag("row").over(above) + 1), F.lit(False))
    return islands.row_spans(cells.withColumns({"width": F.lit(1), "state": F.when(same, "continue").otherwise("restart")}))


HANDOVER = """n AS (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS following, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
    u AS (SELECT user_id, following FROM n WHERE k = 1)"""


@query(
    f"""WITH RECURSIVE {HANDOVER}, r AS (
      SELECT user_id, user_id AS here, 0 AS hops FROM u UNION ALL SELECT r.user_id, u.following, r.hops + 1 FROM r JOIN u ON u.user_id = r.here WHERE u.following IS NOT NULL AND r.hops < (SELECT count(*) FROM u)
    ), e AS (SELECT user_id, max(hops) AS hops, arg_max(here, hops) AS last FROM r GROUP BY 1), m AS (SELECT count(*) AS n FROM u), c AS (
      SELECT r.user_id AS node, min(r.here) AS least FROM r JOIN e USING (user_id) CROSS JOIN m WHERE e.hops = m.n GROUP BY 1
    ), o AS (SELECT DISTINCT r.user_id FROM r WHERE r.hops > 0 AND r.here = r.user_id)
    SELECT e.user_id, CASE WHEN e.hops = m.n THEN c.least ELSE e.last END AS root, CASE WHEN e.hops < m.n THEN CAST(e.hops AS BIGINT) END AS hops, e.hops = m.n AS cyclic, o.user_id IS NOT NULL AS on_cycle
    FROM e CROSS JOIN m LEFT JOIN c ON c.node = e.last LEFT JOIN o USING (user_id)"""
)
def handover_chains(t: Tables) -> DataFrame:
    """Each user hands over to the user of the event after their last one: where does that lead?"""
    last = t.events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    nexts = following_events(t.events, last.select("last.event_id"))
    return chains.chains(last.select("user_id").join(nexts, "user_id", "left"), "user_id", "following")


def following_events(events: DataFrame, marks: DataFrame) -> DataFrame:
    """For each mark (event_id) its user and the user of the event right after it, by (ts, event_id): user_id and following.

    Time is cut into days; within a day it is a window, and what lies beyond is the first event of the next day that has any.
    """
    rows = events.select("user_id", "ts", "event_id").withColumn("span", F.to_date("ts"))
    inside = F.lead("user_id").over(Window.partitionBy("span").orderBy("ts", "event_id"))
    firsts = rows.groupBy("span").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    after = firsts.select("span", F.lead("first").over(Window.orderBy("span")).alias("beyond"))  # one row a day
    own = rows.withColumn("inside", inside).join(marks.withColumnRenamed("event_id", "_e"), F.col("event_id") == F.col("_e"), "left_semi")
    return own.join(after, "span").select("user_id", F.coalesce("inside", "beyond").alias("following"))


@query(
    """WITH n AS (SELECT event_id, user_id, event_type, ts, lead(event_id) OVER w AS following, lead(ts) OVER w AS then_at, lag(event_id) OVER w AS old FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
    SELECT b.event_id AS id, b.old, 'not_acknowledged' AS problem FROM n b JOIN n a ON a.event_id = b.old WHERE a.then_at - a.ts > INTERVAL 12 HOUR"""
)
def unreciprocated(t: Tables) -> DataFrame:
    """Events replace the user's last one of their kind; that one only knows a successor of the next twelve hours."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = t.events.select("event_id", F.lag("event_id").over(w).alias("old"), F.lead("event_id").over(w).alias("following"), (F.lead("ts").over(w) - F.col("ts")).alias("wait"))
    newer = rows.select(F.col("event_id").alias("id"), "old")
    older = rows.select(F.col("event_id").alias("id"), F.when(F.col("wait") <= F.expr("INTERVAL '12' HOUR"), F.col("following")).alias("superseded_by"))
    return chains.unreciprocated(newer, older)


@query(
    """WITH s AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS e FROM lineitem), l AS (SELECT id, list(e) AS els FROM s GROUP BY 1), p AS (
      SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.e = b.e AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT a, b, CAST(len(list_intersect(x.els, y.els)) AS INT) AS shared, array_to_string(list_sort(list_intersect(x.els, y.els)), ',') AS parts FROM p JOIN l x ON x.id = p.a JOIN l y ON y.id = p.b"""
)
def shared_parts(t: Tables) -> DataFrame:
    """Pairs of orders with two parts or more in common."""
    pairs = overlap.overlapping_sets(t.lineitem, "l_orderkey", "l_partkey", least=2)
    return pairs.select("a", "b", "shared", F.array_join("elements", ",").alias("parts"))


@query(
    """WITH v AS (SELECT event_id, user_id, event_type || '.' || hour(ts) AS path, json_extract_string(props, '$.k') AS value, event_id % 2 = 0 AS field FROM events), f AS (
      SELECT user_id, path, min(value) AS value FROM v WHERE field GROUP BY 1, 2), c AS (SELECT * FROM v WHERE NOT field), x AS (
      SELECT c.event_id, c.user_id, c.path, c.value, f.path AS field FROM c LEFT JOIN f ON f.user_id = c.user_id AND f.path = c.path)
    SELECT event_id, path, value, field, 'key' AS tier FROM x WHERE field IS NOT NULL
    UNION ALL SELECT x.event_id, x.path, x.value, f.path, CASE WHEN f.path IS NOT NULL THEN 'value' END FROM x LEFT JOIN f ON f.user_id = x.user_id AND f.value = x.value WHERE x.field IS NULL"""
)
def leaf_fields(t: Tables) -> DataFrame:
    """Leaves of odd events: the user's field of the same path, or else all of the same value, from the even events."""
    path = F.concat("event_type", F.lit("."), F.hour("ts"))
    leaf = t.events.select("event_id", "user_id", path.alias("path"), F.explode(X.json_leaves("props")["leaves"]["value"]).alias("value"))
    fields = leaf.filter("event_id % 2 = 0").groupBy("user_id", "path").agg(F.min("value").alias("value"))
    return overlap.first_or_equal(leaf.filter("event_id % 2 <> 0"), fields, ["user_id"], "path", "value").drop("user_id")
