"""Profiles and evidence as text, Markdown and TeX; escaping keeps source text data."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as Y

from ..functions import matching, text as T, values as X

# TeX escapes, the draft notice, section icons.
TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
DRAFT = "DRAFT / 草稿 - 未完成事实与交付确认"
ICONS = {"summary": "faUser", "experience": "faBriefcase", "projects": "faFileTextO", "education": "faGraduationCap", "skills": "faCogs", "certifications": "faFileTextO"}


def plain(value: str) -> str:
    return " ".join(value.split())


def md_escape(value: str) -> str:
    return re.sub(r"[\\`*_{}\[\]<>#!|&+().=~-]", lambda m: "\\" + m[0], plain(value))


def tex_escape(value: str) -> str:
    """Addresses may break after each character; everything stays literal."""
    value = plain(value)
    in_url = {k for m in matching.URL_TEXT.finditer(value) for k in range(m.start() + 1, m.end())}
    return "".join((r"\allowbreak{}" if k in in_url else "") + TEX.get(c, c) for k, c in enumerate(value))


def as_text(profile: dict, markdown: bool = False, draft: bool = False) -> str:
    esc = md_escape if markdown else plain
    mark = (lambda n: "#" * n + " ") if markdown else (lambda n: "")
    head = [DRAFT] * draft + [esc(x) for x in ([profile["headline"]] if profile["headline"] else []) + profile["contacts"]]
    if markdown:  # a soft break would join the lines
        head = [x + "  " for x in head[:-1]] + head[-1:]
    out = [mark(1) + esc(profile["name"])] if profile["name"].strip() else []
    out += head
    for section in profile["sections"]:
        if not section["entries"]:
            continue
        out += ["", mark(2) + esc(section["title"])]
        for entry in section["entries"]:
            title = " | ".join(filter(None, (esc(entry.get(k, "")) for k in ("heading", "date"))))
            out += ["", title] if title else []
            out += ["- " + esc(b) for b in entry.get("bullets", [])]
    return "\n".join(out) + "\n"


def as_tex(profile: dict, plain_theme: bool = False, draft: bool = False) -> str:
    e = tex_escape
    out = [r"\documentclass[literaltext]{resume}", r"\begin{document}", r"\pagenumbering{gobble}", r"\raggedright"]
    out += [rf"\name{{{e(profile['name'])}}}"] if profile["name"].strip() else []
    out += [rf"\headline{{{DRAFT}}}"] if draft else []
    contacts = [e(c) for c in profile["contacts"]]
    out += [r"{\centering\small"] + ([c + r"\par" for c in contacts] if plain_theme else [r" \textperiodcentered\ ".join(contacts) + r"\par"]) + [r"}\vspace{0.7ex}"]
    out += [rf"{{\centering {e(profile['headline'])}\par}}\vspace{{0.6ex}}"] if profile["headline"] else []
    for section in (s for s in profile["sections"] if s["entries"]):
        icon = "" if plain_theme else "\\" + ICONS.get(section["id"], "faFileTextO") + r"\ "
        out.append(rf"\section{{{icon}{e(section['title'])}}}")
        for entry in section["entries"]:
            out += _tex_entry(entry, plain_theme)
    return "\n".join([*out, r"\end{document}", ""])


def _tex_entry(entry: dict, plain_theme: bool) -> list[str]:
    heading, date = (tex_escape(entry.get(k, "")) for k in ("heading", "date"))
    bullets = entry.get("bullets") or []
    if plain_theme:
        out = ([rf"\textbf{{{heading}}}\par"] if heading else []) + ([date + r"\par"] if date else [])
    else:
        out = [rf"\datedsubsection{{{heading}}}{{{date}}}"] if heading or date else []
    return out + ([r"\begin{itemize}", *(r"\item " + tex_escape(b) for b in bullets), r"\end{itemize}"] if bullets else [])


FORMATS = {"text": as_text, "markdown": lambda p, draft: as_text(p, True, draft), "tex": lambda p, draft: as_tex(p, False, draft), "tex-plain": lambda p, draft: as_tex(p, True, draft)}


def rendered(profile: Column | str, form: str, draft: bool = False) -> Column:
    """A profile's JSON text in one of FORMATS."""
    write = FORMATS[form]

    @F.pandas_udf(Y.StringType())
    def one(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: write(X.strict_json(t), draft=draft), na_action="ignore")

    return one(profile)


def text_by_fields(fields: DataFrame, scope: str) -> DataFrame:
    """Visible fields (scope, ord, path, value) as one text per scope, for search and diffs."""
    lines = fields.filter("trim(value) <> ''").groupBy(scope).agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("lines"))
    return lines.select(scope, F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("text"))


def evidence_markdown(claims: DataFrame, scope: str = "source_id") -> DataFrame:
    """Per source one Markdown text with all claims: their text as a quotation, place and reading."""
    quoted = F.concat(F.lit("> "), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), r"([\\`*_{}\[\]()#+.!|\-])", r"\\$1"))
    item = F.concat_ws("\n", F.concat(F.lit("## "), "claim_id"), F.lit(""), quoted, F.lit(""), F.concat(F.lit("- "), "block_id", F.lit(" · "), "interpretation", F.lit(" · "), "status"), F.lit(""))
    return claims.groupBy(scope).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", item.alias("item")))), lambda x: x["item"]), "\n").alias("markdown"))


def quotation(c: Column) -> Column:
    """Source text as a Markdown quotation: every line stays data."""
    safe = c
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(char), F.lit(entity))
    safe = F.regexp_replace(safe, r"([\\`*_{}\[\]()#+.!|\-])", r"\\$1")
    return F.array_join(F.transform(F.split(safe, r"\R"), lambda x: F.concat(F.lit("> "), x)), "\n")


def review_markdown(improvements: DataFrame, stories: DataFrame, directions: DataFrame) -> DataFrame:
    """Per doc_id the coaching results as one Markdown text: asks in order, story material, directions, each with its quotes and sources.

    A document is in the result if it has an improvement, and every one has.
    """
    sources = F.when(F.size("fact_ids") > 0, F.concat(F.lit("Sources: "), F.array_join("fact_ids", ", ")))
    block = lambda *parts: F.concat_ws("\n\n", *parts)
    told = lambda quotes: F.array_join(F.transform(quotes, quotation), "\n\n")
    title = lambda level, c: F.concat(F.lit("#" * level + " "), c)

    def gathered(df: DataFrame, text: Column, name: str) -> DataFrame:
        return df.select("doc_id", "rank", text.alias("t")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), "\n\n").alias(name))

    numbered = title(2, F.concat(F.col("rank").cast("string"), F.lit(". "), F.regexp_replace("kind", "_", " ")))
    asks = gathered(improvements, block(numbered, "ask", quotation(F.col("quote")), sources), "asks")
    heading = F.when(F.coalesce("heading", F.lit("")) == "", F.lit("Candidate experience")).otherwise(T.md_escape("heading"))
    told_stories = gathered(stories, block(title(3, heading), told("quotes"), sources), "stories")
    roles = gathered(directions, block(title(3, F.col("role")), told("quotes"), sources), "directions")
    both = asks.join(told_stories, "doc_id", "left").join(roles, "doc_id", "left")
    text = block(
        F.lit("# Review of imported material: nothing here is confirmed"),
        F.col("asks"),
        F.lit("## Story material"),
        F.coalesce("stories", F.lit("No work was found to tell of.")),
        F.lit("## Directions to explore"),
        F.coalesce("directions", F.lit("No clue was found.")),
    )
    return both.select("doc_id", F.concat(text, F.lit("\n")).alias("markdown"))
