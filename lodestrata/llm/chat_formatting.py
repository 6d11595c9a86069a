"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation again and again, each time with a few more turns.
Every turn gets a hash of its position, role and text; the exclusive or of the
first k of them is the rolling hash of the prefix of k turns. A conversation whose
own hash is a proper prefix's hash of another is a snapshot of it and goes; of
equal conversations the smallest id stays. What remains is rendered.

Hashes are worked out once and written without texts; the collapse reads them alone,
and texts are fetched for the conversations that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .columns import numbered, place
from .scratch import Scratch

SPAN = 256  # turns whose rolling hash one task computes
CONV = ["none", "conv"]  # whether the id is null, and the id as text


def distinct_turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(none, conv, block, turn, role, text, id), repeated rows once. ``block`` is a stretch of SPAN turn numbers."""
    own = numbered(conversations)
    c, t = F.col(place(conversations, conv_id)), F.col(place(conversations, turn))
    empty = lambda name: F.coalesce(F.col(place(conversations, name)), F.lit(""))
    block = F.coalesce(F.floor(t / SPAN), F.lit(-(2**40))).cast("long")
    rows = own.select(c.isNull().alias("none"), F.coalesce(c.cast("string"), F.lit("")).alias("conv"), block.alias("block"), t.alias("turn"), empty(role).alias("role"), empty(text).alias("text"), c.alias("id"))
    return rows.distinct()


def rolling(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per turn, without texts: conv, id, pos (from 1), n (turns of the conversation), ha and hb (hash of the prefix up to here).

    A long conversation's turns are dealt to tasks by their blocks; the blocks'
    totals carry number and hash from one to the next.
    """
    part = [*CONV, "block"]
    by_block = Window.partitionBy(*CONV).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = turns.groupBy(*part).agg(F.count("*").alias("cnt"))
    counts = counts.select(*part, F.coalesce(F.sum("cnt").over(by_block), F.lit(0)).alias("before"), F.sum("cnt").over(Window.partitionBy(*CONV)).alias("n"))
    nth = F.row_number().over(Window.partitionBy(*part).orderBy("turn", "role", "text"))
    placed = turns.join(counts, part).withColumn("pos", nth + F.col("before"))
    hashed = placed.select(*part, "id", "n", "pos", F.xxhash64("pos", "role", "text").alias("xa"), F.xxhash64("text", "role", "pos", F.lit(1)).alias("xb"))
    inside = Window.partitionBy(*part).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hashed = scratch.save(hashed.withColumns({"xa": F.bit_xor("xa").over(inside), "xb": F.bit_xor("xb").over(inside)}))

    zero = F.lit(0).cast("long")
    totals = hashed.groupBy(*part).agg(F.max_by(F.struct("xa", "xb"), "pos").alias("t"))
    totals = totals.select(*part, F.coalesce(F.bit_xor("t.xa").over(by_block), zero).alias("ta"), F.coalesce(F.bit_xor("t.xb").over(by_block), zero).alias("tb"))
    out = hashed.join(totals, part).select(*CONV, "id", "pos", "n", F.col("xa").bitwiseXOR(F.col("ta")).alias("ha"), F.col("xb").bitwiseXOR(F.col("tb")).alias("hb"))
    out = scratch.save(out)
    scratch.drop(hashed)
    return out


def maximal(rows: DataFrame) -> DataFrame:
    """(none, conv, n, copies) of the conversations that no other one starts with; equal ones count as copies, and the smallest id stays."""
    whole = rows.filter("pos = n").groupBy("n", "ha", "hb").agg(F.min(F.struct("none", "id", "conv")).alias("first"), F.count("*").alias("copies"))
    starts = rows.filter("pos < n").select(F.col("pos").alias("n"), "ha", "hb").distinct()
    return whole.join(starts, ["n", "ha", "hb"], "left_anti").select("first.none", "first.conv", "n", "copies")


def rendered(turns: Column, open_role: str = "<|", close_role: str = "|>") -> Column:
    """Each turn as its role in marks, a line feed, its text and a line feed."""
    line = lambda t: F.concat(F.lit(open_role), t["role"], F.lit(close_role + "\n"), t["text"], F.lit("\n"))
    return F.array_join(F.transform(turns, line), "")


def collapse_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Keeps maximal conversations and renders them.

    Returns one row per conversation kept: its id, n_turns, n_copies (equal
    conversations, itself included) and chat. Turns go by turn, role, text, nulls
    first; null roles and texts count as empty; repeated rows count once; a null id
    is an id like others and the last choice among equal conversations. Other
    columns are ignored, whatever their names; an empty table gives no rows. Texts may be
    long; a rendered conversation is one string, so it must fit into memory.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    turns = scratch.save(distinct_turns(conversations, conv_id, turn, role, text))
    rows = rolling(turns, scratch)
    kept = scratch.save(maximal(rows))
    scratch.drop(rows)
    said = turns.join(kept.select(*CONV), CONV, "left_semi").groupBy(*CONV).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"), F.first("id").alias("id"))
    out = said.join(kept, CONV)
    return out.select(F.col("id").alias(conv_id), F.col("n").alias("n_turns"), F.col("copies").alias("n_copies"), rendered(F.col("turns")).alias("chat"))


ORACLE_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM turns
), prefixes AS (
  SELECT conv_id, pos, n, sum(md5_number(concat(pos, ':', length(role), ':', role, ':', text))) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS h
  FROM (SELECT conv_id, pos, n, role, text FROM placed)
), whole AS (
  SELECT n, h, min(conv_id) AS conv_id, count(*) AS copies FROM prefixes WHERE pos = n GROUP BY n, h
), kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.pos = w.n AND p.h = w.h AND p.pos < p.n)
)
SELECT k.conv_id, k.n AS n_turns, k.copies AS n_copies, string_agg('<|' || p.role || '|>' || chr(10) || p.text || chr(10), '' ORDER BY p.pos) AS chat
FROM kept k JOIN placed p ON p.conv_id = k.conv_id GROUP BY k.conv_id, k.n, k.copies
"""
