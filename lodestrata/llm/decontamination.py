"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and measures (a number and its unit) become typed placeholders, each
one token however many words it has, so an item whose figures or persons were changed
keeps its template. Windows of ``window`` template tokens are hashed, at every position
of an item and of a document, and joined. Where the items' windows can be broadcast, a document's
window is hashed only if it has the anchor of an item's window - its token that the fewest items
have - in its place, which any equal window has. A hit says where in the document the item
would lie; there the templates are compared token by token. Where a part of the item
lies a few tokens off, its own hits count too. The placeholders must be filled
consistently: one value of the item stands for one value of the document, and the
other way round.

Windows of little but placeholders say nothing, and items shorter than a window have
none. Such items are looked for verbatim besides, by windows of their plain tokens, of
their own length if they are short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .columns import fingerprint, numbered, place
from .scratch import Scratch

# Units of measure that follow a number or are written with it.
UNITS = ["mm", "cm", "m", "km", "mi", "ft", "in", "mg", "g", "kg", "t", "lb", "oz", "ml", "l", "s", "sec", "min", "h", "hr", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "miles", "meters", "metres", "pounds", "dollars", "euros", "percent", "degrees", "mph", "kmh", "kw", "kwh", "w", "v", "hz"]

MARK, JOINT = "\u0001", "\u0002"
NAME = r"(?<=[\p{Ll}\p{N},;] )(?=\p{Lu})"
EDGES = r"(?<=^|[\s\x01])[^\p{L}\p{N}\s$€£%+<>\x01-]+|[^\p{L}\p{N}\s$€£%+<>\x01-]+(?=\s|$)"
FIGURE = r"(?<= |^)[+-]?[$€£]?\p{N}[\p{N}.,:/-]*"
AMOUNT = rf"(?i)({FIGURE}) \x01?(?=(?:{'|'.join(UNITS)})(?: |$))"
NAMES = r"(\x01\S+) (?=\x01)"
NUMBER = rf"{FIGURE}%?(?= |$)"
MEASURE = rf"{FIGURE}\x02?(?:{'|'.join(UNITS)})(?= |$)"
SLOTS = ["<num>", "<name>", "<measure>"]
TEMPLATE, PLAIN = 0, 1
NEAR = 256  # parts of an item at places that differ by up to half of this belong together
RUN = 3  # so many windows of an item in a row count however long the item is
LEAST = 3  # items of fewer plain tokens count only as a whole text
PROBE_BYTES = 96  # of a probe in a broadcast table, besides its anchor


def tokenised(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds raw, template and plain: the tokens of a text, joined by spaces, each in one form.

    raw: white-space tokens without punctuation at their edges; names - capitals after a
    lower-case word - carry a mark, and the words of a name, a figure and its unit, are one
    token. template: the same tokens, lower-cased, with placeholders. plain: the lower-cased
    words without marks. Steps are columns of their own, so that none is worked out twice.
    """
    at = lambda c: F.col(f"_{c}")
    rows = rows.withColumn("_named", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), NAME, MARK))
    rows = rows.withColumn("_bare", F.trim(F.regexp_replace(F.regexp_replace(at("named"), EDGES, ""), r"\s+", " ")))
    rows = rows.withColumn("_joined", F.when(at("bare").rlike(r"\p{N} "), F.regexp_replace(at("bare"), AMOUNT, "$1" + JOINT)).otherwise(at("bare")))
    rows = rows.withColumn("raw", F.regexp_replace(at("joined"), NAMES, "$1" + JOINT))
    rows = rows.withColumn("_lower", F.lower(F.regexp_replace("raw", r"\x01\S+", "<name>")))
    slots = F.regexp_replace(F.regexp_replace(at("lower"), MEASURE, "<measure>"), NUMBER, "<num>")
    rows = rows.withColumn("template", F.when(at("lower").rlike(r"\p{N}"), slots).otherwise(at("lower")))
    rows = rows.withColumn("plain", F.translate(F.lower("raw"), JOINT + MARK, " "))
    return rows.drop(*[f"_{c}" for c in ("named", "bare", "joined", "lower")])


def tokens(joined: Column) -> Column:
    """Of a column, which is read twice."""
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def _starts(toks: Column, length: Column | int) -> Column:
    return F.when(F.size(toks) >= length, F.sequence(F.lit(0), F.size(toks) - length)).otherwise(F.array().cast("array<int>"))


def window_hash(words: Column | str) -> Column:
    return F.xxhash64(F.col("kind"), words)


def _before(toks: Column, start: Column) -> Column:
    """Hash of the token before a window."""
    return F.xxhash64(F.get(toks, start - 1))


def pattern_of(template: Column | str, raw: Column | str) -> Column:
    """For each placeholder the first place of its value, 0 for other tokens."""
    own = F.col(raw) if isinstance(raw, str) else raw
    return F.zip_with(template, own, lambda t, x: F.when(t.isin(SLOTS), F.array_position(own, x)).otherwise(0))


def distinct_items(benchmark: DataFrame, text: str, id_col: str) -> DataFrame:
    """One row per different text: template, plain, raw, its pattern, the smallest item_id and n, the number of items."""
    items = tokenised(benchmark.select(F.col(id_col).alias("item_id"), F.col(text).alias("text"))).filter("raw != ''")
    items = items.groupBy("template", "raw", "plain").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n"))
    split = items.withColumns({"_it": tokens(F.col("template")), "_ir": tokens(F.col("raw"))})
    return split.withColumn("pattern", pattern_of("_it", "_ir")).drop("_it", "_ir")


def known_values(benchmark: DataFrame, text: str, id_col: str) -> DataFrame:
    """(tid, pos, value): the values that texts of a template have in its placeholders, by hash."""
    texts = distinct_items(benchmark, text, id_col).select(F.xxhash64("template").alias("tid"), tokens(F.col("template")).alias("it"), tokens(F.col("raw")).alias("ir"))
    slots = texts.select("tid", "ir", F.posexplode("it").alias("pos", "t")).filter(F.col("t").isin(SLOTS))
    return slots.select("tid", "pos", F.xxhash64(F.get("ir", F.col("pos"))).alias("value")).distinct()


def item_entries(benchmark: DataFrame, text: str, id_col: str, window: int) -> DataFrame:
    """What is looked for: tid, kind, item_id (the smallest with that template), n_items, it (tokens), patterns (for each way in which the texts' values are equal, the first place of each value) and at (where its probes begin).

    Items with one template are one entry. A text whose
    template has too few tokens, or a window of mostly placeholders, is an entry of plain tokens besides.
    """
    texts = distinct_items(benchmark, text, id_col)
    items = texts.groupBy("template", "pattern").agg(F.min("item_id").alias("item_id"), F.sum("n").alias("n"))
    items = items.groupBy("template").agg(F.min("item_id").alias("item_id"), F.sum("n").alias("n_items"), F.collect_list("pattern").alias("patterns"))
    items = items.withColumn("it", tokens(F.col("template")))
    words = lambda i: F.size(F.filter(F.slice("it", i + 1, F.lit(window)), lambda x: ~x.isin(SLOTS)))
    items = items.withColumn("at", F.filter(_starts(F.col("it"), window), lambda i: words(i) * 2 >= window))
    whole = items.filter(F.size("at") > 0).select(F.xxhash64("template").alias("tid"), F.lit(TEMPLATE).alias("kind"), "item_id", "n_items", "it", "patterns", "at")
    rest = items.filter((F.size("it") < window) | (F.size("at") < F.size("it") - window + 1)).select("template", "item_id", "n_items").join(texts.select("template", "plain").distinct(), "template")
    rest = rest.withColumn("it", tokens(F.col("plain")))
    verbatim = rest.select(F.xxhash64("template", "plain").alias("tid"), F.lit(PLAIN).alias("kind"), "item_id", "n_items", "it", F.array(pattern_of("it", "it")).alias("patterns"), _starts(F.col("it"), F.least(F.size("it"), F.lit(window))).alias("at"))
    return whole.unionByName(verbatim)


def probes(entries: DataFrame, window: int) -> DataFrame:
    """One row per hashed window of an entry: h, kind, tid, n (tokens), length, item_at, prev - the hash of the token before if the window one before is a probe too - and words."""
    it, at = F.col("it"), F.col("item_at")
    rows = entries.select("kind", "tid", "it", F.size("it").alias("n"), F.least(F.size("it"), F.lit(window)).alias("length"), "at", F.explode("at").alias("item_at"))
    rows = rows.withColumn("words", F.slice(it, at + 1, F.col("length")))
    return rows.select(window_hash("words").alias("h"), "kind", "tid", "n", "length", "item_at", F.when(F.array_contains("at", at - 1), _before(it, at)).alias("prev"), "words")


def anchors(looked: DataFrame, entries: DataFrame) -> DataFrame:
    """(kind, tok, spots): for each anchor the lengths of the windows that it stands for, and its offset in them."""
    often = entries.select("kind", "tid", F.explode(F.array_distinct("it")).alias("tok")).groupBy("kind", "tok").agg(F.count("*").alias("often"))
    words = looked.select("kind", "tid", "item_at", "length", F.posexplode("words").alias("offset", "tok")).filter((F.col("kind") == PLAIN) | ~F.col("tok").isin(SLOTS))
    best = words.join(often, ["kind", "tok"]).groupBy("kind", "tid", "item_at").agg(F.min(F.struct("often", (-F.length("tok")).alias("short"), "tok", "offset", "length")).alias("a"))
    return best.groupBy("kind", F.col("a.tok").alias("tok")).agg(F.collect_set(F.struct("a.length", "a.offset")).alias("spots"))


def _consistent(pairs: Column) -> Column:
    """No value of one side stands for two of the other."""
    n = F.size(F.array_distinct(pairs))
    return (n == F.size(F.array_distinct(F.transform(pairs, lambda p: p["a"])))) & (n == F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"]))))


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = 8, coverage: float = 0.6, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Documents that hold benchmark items: one row per pair.

    Returns the id, fa and fb (fingerprint of the text), item_id (the smallest with
    that template), n_items, coverage (share of the item's tokens found at its
    best place), n_slots and changed (placeholders there whose value no text with that template
    has there). A pair counts from ``coverage`` on, or if RUN windows' tokens of the item stand in a row, if the
    placeholders are consistent with any of these texts. Parts of an item count together if foreign or dropped tokens between them
    move them by half of NEAR (128) tokens at most; two parts further off count if one by itself does. Every run of ``window``
    template tokens that an item and a document share is found, wherever it stands,
    if half of them are no placeholders; of other items, and of those too short for a
    window, every verbatim run of ``window`` plain tokens, or the whole item. Items of one or
    two plain tokens match only a text that is nothing else. Null and empty texts match nothing.
    Long texts are worked off whole. Repeated rows match alike; equal (id, text) rows
    give one row per item; of equally good places that with fewer changed values counts. Other
    columns are ignored, whatever their names; empty tables give no rows.

    Probes, rows of a few numbers, and anchors are broadcast only if they take at most
    ``broadcast_bytes``; otherwise all windows' hashes are joined by a shuffle and the texts fetched again.
    """
    scratch = Scratch(docs.sparkSession, "benchmark")
    items = numbered(benchmark)
    entries = scratch.save(item_entries(items, place(benchmark, item_text), place(benchmark, item_id), window))
    looked = probes(entries, window)
    marked = scratch.save(anchors(looked, entries))
    looked = scratch.save(looked.drop("words"))
    known = scratch.save(known_values(items, place(benchmark, item_text), place(benchmark, item_id)))
    kinds = {(r.kind, r.length): r.n for r in looked.groupBy("kind", "length").agg(F.count("*").alias("n")).collect()}  # at most ``window`` + 1 rows
    tokens_bytes = marked.agg(F.coalesce(F.sum(F.octet_length("tok") + F.size("spots") * 24), F.lit(0))).first()[0]
    small = sum(kinds.values()) * PROBE_BYTES + tokens_bytes <= broadcast_bytes

    own = numbered(docs)
    t = F.coalesce(F.col(place(docs, text)), F.lit(""))
    fa, fb = fingerprint(t)
    base = tokenised(own.select(F.col(place(docs, id_col)).alias("id"), fa.alias("fa"), fb.alias("fb"), t.alias("text")))
    key = ["id", "fa", "fb"]
    # dw: the tokens that are compared; dr: those that fill the slots
    toks = base.select(*key, F.lit(TEMPLATE).alias("kind"), tokens(F.col("template")).alias("dw"), tokens(F.col("raw")).alias("dr"))
    if any(kind == PLAIN for kind, _ in kinds):
        both = base.select(*key, F.explode_outer(F.array(F.struct(F.lit(TEMPLATE).alias("kind"), F.col("template").alias("w"), F.col("raw").alias("r")), F.struct(F.lit(PLAIN).alias("kind"), F.col("plain").alias("w"), F.col("plain").alias("r")))).alias("k"))
        toks = both.select(*key, "k.*").select(*key, "kind", tokens(F.col("w")).alias("dw"), tokens(F.col("r")).alias("dr"))
    # of a run of hits only the first counts; a very short item must be the whole text
    first = F.col("prev").isNull() | (F.col("at") == 0) | (F.col("before") != F.col("prev"))
    fits = (F.col("n") >= LEAST) | (F.col("size") == F.col("n"))
    on = ["h", "kind", "length"]
    if small:
        # an inner generator would have Spark test the array's size first, and work all tokens out again for that
        met = toks.select("*", F.posexplode_outer("dw").alias("pos", "tok")).join(F.broadcast(marked), ["kind", "tok"])
        seen = met.select(*toks.columns, "pos", F.explode("spots").alias("s")).select(*toks.columns, (F.col("pos") - F.col("s.offset")).alias("at"), F.col("s.length").alias("length"))
        seen = seen.filter((F.col("at") >= 0) & (F.col("at") + F.col("length") <= F.size("dw")))
    else:
        lengths = F.array(*[F.struct(F.lit(kind).alias("of"), F.lit(n).alias("length")) for kind, n in kinds])
        seen = toks.select("*", F.explode(lengths).alias("l")).filter((F.col("l.of") == F.col("kind")) & (F.size("dw") >= F.col("l.length")))
        seen = seen.select(*toks.columns, F.col("l.length").alias("length"), F.explode_outer(F.sequence(F.lit(0), F.size("dw") - F.col("l.length"))).alias("at"))
    seen = seen.withColumn("h", window_hash(F.slice("dw", F.col("at") + 1, F.col("length"))))
    before, size = _before(F.col("dw"), F.col("at")), F.size("dw")
    if small:
        hit = seen.join(F.broadcast(looked), on).withColumns({"before": before, "size": size}).filter(first & fits)
    else:
        hashes = seen.select(*key, *on, "at", before.alias("before"), size.alias("size"))
        found = hashes.join(looked, on).filter(first & fits).drop("h", "length", "before", "size").withColumnsRenamed({k: f"_{k}" for k in [*key, "kind"]})
        same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("fa") == F.col("_fa")) & (F.col("fb") == F.col("_fb")) & (F.col("kind") == F.col("_kind"))
        hit = toks.join(found, same)
    hit = hit.withColumn("shift", F.col("at") - F.col("item_at")).withColumn("skipped", F.greatest(-F.col("shift"), F.lit(0)))  # tokens of the item before the document's first
    there = lambda c: F.slice(c, F.greatest(F.col("shift"), F.lit(0)) + 1, F.col("n") - F.col("skipped"))
    hit = hit.select(*key, "tid", "shift", "skipped", "item_at", there("dw").alias("dt"), there("dr").alias("dr"))
    places = hit.groupBy(*key, "tid", "shift", "skipped").agg(F.collect_set("item_at").alias("ats"), F.any_value("dt").alias("dt"), F.any_value("dr").alias("dr"))
    placed = places.join(entries.drop("at", "kind"), "tid")
    at = F.sequence(F.lit(0), F.size("it") - 1)
    here = lambda c, i: F.get(F.col(c), i - F.col("skipped"))
    same_at = lambda i: F.coalesce(F.get("it", i) == here("dt", i), F.lit(False))
    placed = placed.withColumns(
        {
            "same": F.transform(F.filter(at, same_at), lambda i: F.struct(i.alias("pos"), F.get("it", i).isin(SLOTS).alias("slot"), here("dr", i).alias("b"))),
            "other": F.concat(F.filter(at, lambda i: ~same_at(i)), F.array(F.size("it"))),
        }
    )
    found = F.transform("ats", lambda a: F.sequence(a, F.array_min(F.filter("other", lambda m: m > a)) - 1))
    placed = placed.withColumn("found", found).withColumns({"runs": F.flatten("found"), "longest": F.array_max(F.transform("found", F.size))})
    # any two places that differ by up to half of NEAR share a cell of one grid or the other
    cell = F.explode(F.array(*[F.struct(F.lit(g).alias("grid"), F.floor((F.col("shift") + g * NEAR // 2) / NEAR).alias("cell")) for g in (0, 1)]))
    part = F.struct(F.size("same").alias("size"), (-F.col("shift")).alias("shift"), "same", "runs")
    cells = placed.withColumn("c", cell).groupBy(*key, "tid", "c").agg(F.max("longest").alias("longest"), F.sort_array(F.collect_list(part), asc=False).alias("parts"))  # at most NEAR parts
    own_part = F.transform("parts", lambda x, i: F.when(i == 0, x["same"]).otherwise(F.filter(x["same"], lambda e: F.array_contains(x["runs"], e["pos"]))))
    merged = F.aggregate(F.slice(own_part, 2, NEAR), F.get(own_part, F.lit(0)), lambda acc, x: F.concat(acc, F.filter(x, lambda e: ~F.exists(acc, lambda a: a["pos"] == e["pos"]))))
    cells = cells.select(*key, "tid", "c", "longest", merged.alias("same")).join(entries.select("tid", "kind", "item_id", "n_items", F.size("it").alias("n"), "patterns"), "tid")
    enough = (F.size("same") >= coverage * F.col("n") - 1e-9) | (F.col("longest") >= RUN * window)
    slots = cells.filter(enough).withColumn("slots", F.filter("same", lambda e: e["slot"]))
    pairs = lambda p: F.transform("slots", lambda e: F.struct(F.get(p, e["pos"]).alias("a"), e["b"].alias("b")))
    judged = slots.filter(F.exists("patterns", lambda p: _consistent(pairs(p))))
    # the values of the placeholders, looked up by hash; an item of plain tokens is found as it is
    values = judged.select(*key, "tid", "c", "kind", "item_id", "n_items", (F.size("same") / F.col("n")).alias("coverage"), F.size("slots").alias("n_slots"), F.explode_outer("slots").alias("s"))
    values = values.withColumns({"pos": F.col("s.pos"), "value": F.xxhash64("s.b")}).join(known.withColumn("known", F.lit(1)), ["tid", "pos", "value"], "left")
    new = F.count_if(F.col("known").isNull() & F.col("s").isNotNull() & (F.col("kind") == TEMPLATE))
    judged = values.groupBy(*key, "tid", "c", "item_id", "n_items", "coverage", "n_slots").agg(new.alias("changed"))
    best = judged.groupBy(*key, "item_id").agg(F.max("n_items").alias("n_items"), F.max(F.struct("coverage", (-F.col("changed")).alias("less"), "n_slots")).alias("best"))
    return best.select(F.col("id").alias(id_col), "fa", "fb", "item_id", "n_items", "best.coverage", "best.n_slots", (-F.col("best.less")).alias("changed"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns. Null and empty texts stay; repeated rows stay or go together."""
    found = matches(docs, benchmark, text, id_col, **options).select(F.col(id_col).alias("_id"), F.col("fa").alias("_fa"), F.col("fb").alias("_fb")).distinct()
    own = numbered(docs)
    t = F.coalesce(F.col(place(docs, text)), F.lit(""))
    fa, fb = fingerprint(t)
    same = F.col(place(docs, id_col)).eqNullSafe(F.col("_id")) & (fa == F.col("_fa")) & (fb == F.col("_fb"))
    return own.join(found, same, "left_anti").toDF(*docs.columns)
