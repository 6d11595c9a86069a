"""Text functions as columns: they run in the JVM and take part in whole-stage code generation.

Patterns ask for Unicode classes and Unicode case folding, since the JVM's
defaults are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocabulary as V

I = "(?iuU)"  # noqa: E741  ignore case, Unicode
U = "(?U)"
C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: C) -> Column:
    """Without white space at the ends, in the Unicode sense."""
    return F.regexp_replace(col(c), U + r"^\s+|\s+$", "")


def collapse(c: C) -> Column:
    return F.regexp_replace(strip(c), U + r"\s+", " ")


def found(c: C, pattern: str, flags: str = I) -> Column:
    return col(c).rlike(flags + pattern)


def lines(c: C) -> Column:
    """Lines of a text; a last line end makes no further line."""
    return F.split(F.regexp_replace(col(c), f"(?:{V.LINE_END})\\z", ""), V.LINE_END)


def indent(c: C) -> Column:
    """Leading blanks of a line, tabs reaching to the next multiple of eight."""
    lead = F.regexp_extract(col(c), r"^[ \t]*", 0)
    tabbed = F.aggregate(F.split(lead, ""), F.lit(0), lambda n, x: F.when(x == "\t", n + 8 - n % 8).when(x == " ", n + 1).otherwise(n))
    return F.when(F.contains(lead, F.lit("\t")), tabbed).otherwise(F.length(lead))


def heading_key(c: C) -> Column:
    """Section that a heading names, else null."""
    t = F.regexp_replace(strip(c), U + r"^[\p{P}\p{S}\p{Z}\s\x{E000}-\x{F8FF}]+", "")
    t = F.regexp_replace(t, U + r"[\p{P}\p{S}\p{Z}\s]+$", "")
    t = F.lower(collapse(F.regexp_replace(t, U + r"^\d+[.)、]\s*", "")))
    known = F.create_map(*[F.lit(x) for pair in V.SECTION_OF.items() for x in pair])
    return F.element_at(known, t)


def extra_heading(c: C) -> Column:
    return found(c, rf"\A(?:{V.EXTRA_HEADING})\z")


def unknown_heading(c: C) -> Column:
    """A heading of no known section: marked by #, or one of the extra labels."""
    return found(c, r"\A#+\s+[^\n]{1,80}\z", U) | extra_heading(c)


def has_email(c: C) -> Column:
    """Patterns are tried only where a character that they need is there."""
    return F.contains(col(c), F.lit("@")) & found(c, V.EMAIL)


def has_url(c: C) -> Column:
    return col(c).rlike(r"/|(?i)www\.") & found(c, V.URL)


def has_phone(c: C) -> Column:
    return col(c).rlike(r"\p{Nd}") & found(c, V.PHONE, U)


def has_contact(c: C) -> Column:
    return has_email(c) | has_url(c) | has_phone(c)


def visible_line_count(c: C) -> Column:
    """How many lines show something, counted in one pass over the text."""
    ends = "\\n\\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
    return F.regexp_count(col(c), F.lit(U + rf"[^{ends}]*?[^\s{ends}][^{ends}]*"))


def contact_candidate(c: C) -> Column:
    return (F.length(col(c)) <= 180) & ~F.contains(col(c), F.lit("\n")) & has_contact(c)


def candidate_name(c: C) -> Column:
    """The name a line gives, else null."""
    t = strip(F.regexp_replace(strip(c), r"^[#* ]+|[#* ]+$", ""))
    labelled = strip(F.regexp_extract(t, rf"{I}\A{V.NAME_LABEL}\z", 1))
    words = F.split(t, U + r"\s+")
    latin = F.size(words).between(2, 4) & F.forall(words, lambda w: w.rlike(rf"\A{V.LATIN_NAME_WORD}\z"))
    barred = heading_key(t).isNotNull() | extra_heading(t) | has_contact(t) | found(t, V.NOT_A_NAME)
    return (
        F.when(found(t, rf"\A{V.NAME_LABEL}\z"), F.when(F.length(labelled) <= 100, labelled))
        .when(barred, F.lit(None).cast("string"))
        .when(t.rlike(rf"\A{V.CJK_NAME}\z") | latin, t)
    )


def language(c: C) -> Column:
    """zh if Chinese characters are at least a third as many as Latin letters."""
    cjk, latin = F.regexp_count(col(c), F.lit(r"[\x{4e00}-\x{9fff}]")), F.regexp_count(col(c), F.lit("[A-Za-z]"))
    return F.when((cjk > 0) & (cjk >= latin / 3), "zh").otherwise("en")


def date_span(c: C) -> Column:
    """The first date range, else an empty string."""
    return F.when(col(c).rlike("19|20"), F.regexp_extract(col(c), I + V.DATE_SPAN, 0)).otherwise("")


def date_header(c: C) -> Column:
    """A date range that heads an entry: not one that a sentence uses."""
    before = F.regexp_extract(col(c), rf"(?s){I}\A(.*?){V.DATE_SPAN}", 1)
    after = F.regexp_extract(col(c), rf"(?s){I}\A.*?{V.DATE_SPAN}(.*)\z", 3)
    rest = strip(F.regexp_replace(before, I + V.DATE_CUE, ""))
    cued = found(before, V.DATE_CUE) & (rest != "") & ~rest.rlike(r"[|/]\z")
    zh = found(before, V.DATE_CUE_ZH_BEFORE, U) & ~strip(F.regexp_replace(before, U + V.DATE_CUE_ZH_BEFORE, "")).rlike(r"[|/]\z")
    return (date_span(c) != "") & ~cued & ~zh & ~found(after, V.DATE_CUE_ZH_AFTER, U)


def entry_heading(c: C) -> Column:
    """A header line without its date range."""
    before = F.regexp_extract(col(c), rf"(?s){I}\A(.*?){V.DATE_SPAN}", 1)
    after = F.regexp_extract(col(c), rf"(?s){I}\A.*?{V.DATE_SPAN}(.*)\z", 3)
    before = F.when(date_header(c), F.regexp_replace(before, I + V.DATE_CUE, "")).otherwise(before)
    kept = F.when(date_span(c) != "", F.concat(before, after)).otherwise(col(c))
    return F.regexp_replace(kept, r"^[ |/–—\-\t]+|[ |/–—\-\t]+$", "")


def heading_fragment(c: C) -> Column:
    return ~(found(c, V.SENTENCE_END, U) & ~found(c, V.ORGANISATION_END))


def date_key(c: C) -> Column:
    """Two dates agree if their keys do: a whole range by its end points, anything else as it stands."""
    whole = found(strip(c), rf"\A(?:{V.DATE_SPAN})\z")
    ends = [F.lower(collapse(F.regexp_extract(strip(c), rf"{I}\A{V.DATE_SPAN}\z", k))) for k in (1, 2)]
    return F.when(whole, F.concat_ws("\u0001", *ends)).otherwise(col(c))


def layout_risk(warnings: C) -> Column:
    return found(F.array_join(col(warnings), " "), V.LAYOUT_RISK)


def possible_columns(c: C) -> Column:
    """Some line has a gap of three blanks or more that doesn't just set off a date."""
    dated = rf"{I}\A{V.RIGHT_DATE}(?:\s*(?:[-–—~至到]|to)\s*{V.RIGHT_DATE})?\z"

    def risky(line: Column) -> Column:
        parts = F.filter(F.split(strip(line), r" {3,}"), lambda p: strip(p) != "")
        return (F.size(parts) > 1) & ~strip(F.element_at(parts, -1)).rlike(dated)

    return F.exists(lines(c), risky)


def placeholder(c: C) -> Column:
    return found(c, V.PLACEHOLDER)


def identifier(c: C) -> Column:
    return col(c).rlike(r"\A[a-z][a-z0-9_-]{0,63}\z")


def bad_text(c: C, allow_empty: bool = True) -> Column:
    """Null, blank where that is not allowed, or with control characters."""
    t = col(c)
    bad = t.isNull() | t.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    return bad if allow_empty else bad | (strip(t) == "")


def on_off(c: C) -> Column:
    """Three-valued switch: absent text counts as on, unknown words as null."""
    t = F.lower(F.coalesce(col(c), F.lit("on")))
    return F.when(t.isin("true", "1", "on"), True).when(t.isin("false", "0", "off"), False)


def readable_link(c: C) -> Column:
    return (strip(c) != "") & ~col(c).rlike(r"[\x00-\x1f]") & ~found(strip(c), r"\A(?:javascript|data|vbscript):")


def link_contact(target: C) -> Column:
    """The contact a link leads to: a mail address or a web address with a host, else null."""
    t = strip(target)
    usable = (F.length(t) > 0) & (F.length(t) <= 180) & ~t.rlike(r"\p{Cc}")
    mail = F.try_url_decode(F.regexp_replace(F.regexp_replace(t, r"(?i)\Amailto:|\?.*\z", ""), r"\+", "%2B"))
    return F.when(usable & found(t, r"\Amailto:"), F.when(found(mail, rf"\A(?:{V.EMAIL})\z"), mail)).when(usable & found(t, r"\Ahttps?://[^/?#\s:@]+"), t)


def md_escape(c: C) -> Column:
    return F.regexp_replace(collapse(c), r"([\\`*_{}\[\]<>#!|&+().=~-])", r"\\$1")
