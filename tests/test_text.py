"""Column functions against truth tables, and against the Python predicates of the classifier."""

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import lines as L, text as T

HEADINGS = {"Experience": "experience", "  WORK  EXPERIENCE: ": "experience", "1. Skills": "skills", "• 教育背景": "education", "## Projects ##": "projects", "Experiences": None, "工作经历：": "experience", "": None, " Summary": "summary"}
NAMES = {"Ada Lovelace": "Ada Lovelace", "# Ada Lovelace": "Ada Lovelace", "Name: ada l": "ada l", "姓名：张三": "张三", "张三丰": "张三丰", "ada lovelace": None, "Product Manager": None, "Ada": None, "Ada B. Lovelace": None, "Mary-Jane O'Neil": "Mary-Jane O'Neil", "Skills": None}
CONTACTS = {"a@b.co": True, "see www.x.org now": True, "github.com/u": True, "+1 555-123-4567": True, "13912345678": True, "12345678901234": False, "plain text": False, "x" * 181 + " a@b.co": False}
DATES = {
    "Acme 2019-2021": True, "2019.01 – present": True, "Jan 2019 to Mar. 2020": True, "2023年7月-2026年8月": True, "I worked there from 2019 to 2021 on it": False, "Acme | from 2019-2021": True,
    "在2019-2021期间": False, "2019-2021 年间负责": False, "2019 - Current": False, "Acme": False, "from 2019-2021": True,
}
INDENTS = {"x": 0, "  x": 2, "\tx": 8, " \tx": 8, "  \t x": 9, "\t\tx": 16}


def table(spark, values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "n int, t string")


@pytest.mark.parametrize(
    ("cases", "column", "python"),
    [
        (HEADINGS, T.heading_key, L.heading_key),
        (NAMES, T.candidate_name, L.candidate_name),
        (CONTACTS, T.contact_candidate, L.contact_candidate),
        (DATES, T.date_header, lambda x: bool(L.date_header(x))),
    ],
    ids=["heading", "name", "contact", "date"],
)
def test_columns_and_predicates_agree(spark, cases, column, python):
    assert {k: python(k) for k in cases} == cases
    got = {r.t: r.v for r in table(spark, cases).select("t", column("t").alias("v")).collect()}
    assert got == cases


def test_indent_and_lines(spark):
    got = {r.t: r.v for r in table(spark, INDENTS).select("t", T.indent("t").alias("v")).collect()}
    assert got == INDENTS
    row = spark.createDataFrame([("a\r\nb\x0bc d\n",)], "t string").select(T.lines("t").alias("v")).first()
    assert row.v == "a\r\nb\x0bc d\n".splitlines()


def test_language_and_dates(spark):
    rows = table(spark, ["abc", "工作abc", "abc工", "", "Acme 2019-2021 | Lead", "2021-2024", "2021 – 2024", "2021.01-2024.01"])
    got = [r.asDict() for r in rows.orderBy("n").select(T.language("t").alias("lang"), T.entry_heading("t").alias("head"), T.date_key("t").alias("key")).collect()]
    assert [g["lang"] for g in got[:4]] == ["en", "zh", "zh", "en"]
    assert got[4]["head"] == L.entry_heading("Acme 2019-2021 | Lead")
    assert got[5]["key"] == got[6]["key"] != got[7]["key"]


def test_layout(spark):
    rows = spark.createDataFrame([(["The tool does not establish semantic reading order"], False), (["possible columns on page 1"], True), (["多列"], True), ([], False)], "w array<string>, want boolean")
    assert all(r.want == r.got for r in rows.select("want", T.layout_risk("w").alias("got")).collect())
    rows = table(spark, ["left   right", "Acme     2019-2021", "plain line", "a    Present"])
    assert [r.v for r in rows.orderBy("n").select(T.possible_columns("t").alias("v")).collect()] == [True, False, False, False]


def test_links(spark):
    cases = {"mailto:a@b.co": "a@b.co", "mailto:a%40b.co?subject=x": "a@b.co", "https://x.org/y": "https://x.org/y", "http://": None, "javascript:alert(1)": None, "ftp://x.org": None, " https://x.org ": "https://x.org"}
    got = {r.t: r.v for r in table(spark, cases).select("t", T.link_contact("t").alias("v")).collect()}
    assert got == cases == {k: L.link_contact(k) for k in cases}
    readable = {r.t: r.v for r in table(spark, cases).select("t", T.readable_link("t").alias("v")).collect()}
    assert not readable["javascript:alert(1)"] and readable["ftp://x.org"]


def test_markdown_escape(spark):
    assert spark.createDataFrame([("a*b  [c]",)], "t string").select(T.md_escape("t").alias("v")).first().v == r"a\*b \[c\]"
    assert spark.range(1).select(T.on_off(F.lit(None).cast("string")).alias("a"), T.on_off(F.lit("0")).alias("b"), T.on_off(F.lit("maybe")).alias("c")).first() == (True, False, None)
