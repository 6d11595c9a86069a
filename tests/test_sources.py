"""Readers on generated files."""

import io
import json
import struct
import zipfile

import pytest

from lodestrata.functions import values as X
from lodestrata.sources import images, reader
from lodestrata.sources.docx import hyperlink
from lodestrata.sources.html import visible_blocks
from lodestrata.sources.package import ReadError

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def package(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def docx(body, styles=None, **more):
    files = {"[Content_Types].xml": '<Types><Override PartName="/word/document.xml"/></Types>', "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"} | more
    if styles:
        files["word/styles.xml"] = f"<w:styles {W}>{styles}</w:styles>"
    return package(**files)


def read(name, raw):
    return reader.extract("s", name, raw)


def run(text, props=""):
    return f"<w:r><w:rPr>{props}</w:rPr><w:t>{text}</w:t></w:r>"


def test_text_and_encodings():
    out = read("a.txt", "one\r\n\r\ntwo\nthree".encode("utf-16"))
    assert [(b["text"], b["locator"]["line_start"], b["locator"]["line_end"]) for b in out.blocks] == [("one", 1, 1), ("two\nthree", 3, 4)]
    assert X.decode("中文".encode("gb18030"))[1] == "gb18030" and X.decode("é".encode("utf-8"))[1:] == ("utf-8", None)
    assert read("a.txt", b"\x00\x01").status == "error" and read("a.md", b"  ").status == "partial" and read("a.xyz", b"x").status == "unsupported"
    assert read("a.txt", b"x" * (reader.MOST_BYTES + 1)).status == "error"


def test_html():
    blocks = visible_blocks("<p>One <b>two</b>\n three<script>no</script><span hidden>no</span><p style='display: none'>no</p><ul><li>a<ul><li>b</ul><li>c</ul><pre> x\n  y</pre><a href='https://x.org'>go</a>")
    assert [b.text for b in blocks] == ["One two three", "a", "b", "c", "x\n  y", "go"]
    assert [(b.list_depth, b.item_index) for b in blocks[1:4]] == [(1, 1), (2, 1), (1, 2)]
    assert blocks[5].links == [("https://x.org", 0, 2, "go")]
    cells = visible_blocks("<table><tr><td rowspan=2>a<td colspan=2>b<tr><td>c</table>")
    assert [(c.row, c.column, c.column_span, c.row_span) for c in cells] == [(1, 1, 1, 2), (1, 2, 2, 1), (2, 2, 1, 1)]
    for bad in ("no tags", "<table><tr><td colspan=2000>x</table>"):
        with pytest.raises(ValueError):
            visible_blocks(bad)


def test_docx_text_lists_and_hidden_runs():
    styles = '<w:style w:type="character" w:styleId="H"><w:rPr><w:vanish/></w:rPr></w:style><w:style w:type="character" w:styleId="HH"><w:basedOn w:val="H"/><w:rPr><w:vanish/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="L"><w:pPr><w:numPr><w:numId w:val="4"/></w:numPr></w:pPr></w:style>'
    body = (
        f"<w:p>{run('seen')}{run('direct', '<w:vanish/>')}{run('style', '<w:rStyle w:val=' + chr(34) + 'H' + chr(34) + '/>')}{run(' twice', '<w:rStyle w:val=' + chr(34) + 'HH' + chr(34) + '/>')}</w:p>"
        f'<w:p><w:pPr><w:pStyle w:val="L"/></w:pPr>{run("item")}</w:p><w:p><w:pPr><w:pStyle w:val="L"/><w:numPr><w:numId w:val="0"/></w:numPr></w:pPr>{run("no item")}</w:p><w:p><w:del>{run("gone")}</w:del>{run("kept")}</w:p>'
    )
    out = read("a.docx", docx(body, styles))
    assert [b["text"] for b in out.blocks] == ["seen twice", "item", "no item", "kept"]
    assert [b["locator"].get("numbering_status") for b in out.blocks] == [None, "list", "cancelled", None]
    assert out.status == "extracted" and out.needs_review


def test_docx_tables_and_links():
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p>{run(text)}</w:p></w:tc>"
    body = f"<w:tbl><w:tr>{cell('a', '<w:vMerge w:val=' + chr(34) + 'restart' + chr(34) + '/>')}{cell('b', '<w:gridSpan w:val=' + chr(34) + '2' + chr(34) + '/>')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('c')}{cell('d')}</w:tr></w:tbl>"
    out = read("a.docx", docx(body))
    assert [(c["row"], c["column"], c["column_span"], c["row_span"]) for c in out.cells] == [(1, 1, 1, 2), (1, 2, 2, 1), (2, 1, 1, 1), (2, 2, 1, 1), (2, 3, 1, 1)]
    assert out.cells[2]["merge_origin"] == [1, 1]
    link = f'<w:p><w:hyperlink r:id="r1">{run("site")}</w:hyperlink><w:fldSimple w:instr="HYPERLINK &quot;https://y.org&quot;">{run(" more")}</w:fldSimple></w:p>'
    rels = '<Relationships><Relationship Id="r1" Target="https://x.org"/></Relationships>'
    out = read("a.docx", docx(link, **{"word/_rels/document.xml.rels": rels}))
    assert [(x["target"], x["text"]) for x in out.blocks[0]["links"]] == [("https://x.org", "site"), ("https://y.org", " more")]


@pytest.mark.parametrize(("code", "target"), [('HYPERLINK "https://x.org"', "https://x.org"), ('HYPERLINK \\l "top"', "#top"), ('HYPERLINK "https://x.org" \\o "tip"', "https://x.org"), ("INCLUDETEXT x", None), ('HYPERLINK "a" "b"', None)])
def test_hyperlink_fields(code, target):
    assert hyperlink(code) == target


def test_hostile_packages():
    assert read("a.docx", b"no zip").status == "error"
    assert read("a.docx", package(**{"../x": "1"})).status == "error"
    assert read("a.docx", package(**{"[Content_Types].xml": "<!DOCTYPE x><Types/>"})).status == "error"
    assert read("a.docx", package(**{"[Content_Types].xml": "<Types/>"})).status == "error"


def test_odt():
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'
    body = '<text:h>Head</text:h><text:p>a<text:s text:c="3"/>b</text:p><text:list><text:list-item><text:p>x</text:p></text:list-item><text:list-item><text:p>y</text:p></text:list-item></text:list><table:table><table:table-row><table:table-cell table:number-columns-spanned="2"><text:p>c</text:p></table:table-cell><table:covered-table-cell/></table:table-row></table:table>'
    out = read("a.odt", package(mimetype="application/vnd.oasis.opendocument.text", **{"content.xml": f"<office:document-content {ns}><office:body><office:text>{body}</office:text></office:body></office:document-content>"}))
    assert [b["text"] for b in out.blocks] == ["Head", "a   b", "x", "y", "c"]
    assert [b["locator"].get("item_index") for b in out.blocks] == [None, None, 1, 2, None]
    assert out.cells[1].get("merge_continuation")


def test_json():
    out = read("a.json", b'{"a": [1, "x", null], "b": {"c": true}}')
    assert [(b["locator"]["json_path"], b["text"]) for b in out.blocks] == [('$["a"][0]', "1"), ('$["a"][1]', "x"), ('$["b"]["c"]', "true")]
    assert read("a.json", b'{"a": 1, "a": 2}').status == "error" and read("a.json", b'{"a": NaN}').status == "error"


def test_images():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 30, 20)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 20, 30) + b"\x00" * 8
    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHH", 256, 3, 1, 30, 0) + struct.pack("<HHII", 257, 4, 1, 20) + struct.pack("<I", 0)
    assert [images.dimensions(x) for x in (png, jpeg, tiff)] == [(30, 20, False)] * 3
    for bad in (b"GIF89a", png[:18], b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 30_000, 20)):
        with pytest.raises(ReadError):
            images.dimensions(bad)


def test_files_to_claims(spark, tmp_path):
    from lodestrata.operators import classify
    from lodestrata.streaming import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Ada Lovelace\nExperience\n- built it")
    (tmp_path / "in/b.docx").write_bytes(b"broken")
    blocks = reader.read_files(spark, str(tmp_path / "in"))
    assert sorted((r.format, r.status, r.seq) for r in blocks.collect()) == [("docx", "error", None), ("txt", "extracted", 1)]
    assert classify.claims(reader.classifier_input(blocks)).count() == 3
    query = watch.ledger_stream(watch.watch_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert json.loads(blocks.filter("seq = 1").first().locator)["line_end"] == 3


LINKS = [
    ('HYPERLINK "https://a.b/c"', "https://a.b/c"), ('hyperlink a.b \\o "tip" \\t _blank', "a.b"), ('HYPERLINK "a#x" \\l "y"', "a#y"), ('HYPERLINK \\l "top"', "#top"), ('HYPERLINK "a" \\* MERGEFORMAT', "a"), ('HYPERLINK "a \\"b\\""', 'a "b"'),
    ('HYPERLINK "a" \\n', None), ('HYPERLINK "a" \\l "x" \\l "y"', None), ('HYPERLINK "u', None), ('HYPERLINK "a" \\* Evil', None), ('HYPERLINK "a" \\l \\o', None), ('HYPERLINK "a" "b"', None), ("HYPERLINK", None), ('HYPERLINK ""', None), ('HYPERLINK "a"b', None), ('HYPERLINK a"b', None), ('QUOTE "a"', None), ("", None),
]


@pytest.mark.parametrize(("field", "target"), LINKS)
def test_hyperlink_grammar(field, target):
    assert hyperlink(field) == target


def seen(html):
    return [(b.text, b.item_index, b.list_depth, [(x[0], x[3]) for x in b.links]) for b in visible_blocks(html)]


def test_html_items_are_one_block_each():
    assert seen("<ul><li>one<p>two<br>three</p></li><li>four<ul><li>five</li></ul></li></ul><p>six</p>") == [("one\ntwo\nthree", 1, 1, []), ("four", 2, 1, []), ("five", 1, 2, []), ("six", None, None, [])]


def test_html_links_without_text():
    assert seen('<p><a href="mailto:a@b.co"><img src="x"></a></p>') == [("", None, None, [("mailto:a@b.co", "")])]
    icon = visible_blocks('<p>Contact: <a href="mailto:a@b.co"><img src="x"></a></p>')[0]
    assert icon.links == [("mailto:a@b.co", 8, 8, "")]
    assert seen('<div>before<a href="https://a.b/w"><div>label</div></a>after</div>') == [("before", None, None, []), ("label", None, None, [("https://a.b/w", "label")]), ("after", None, None, [])]
    assert seen('<p><a href="java&#x09;script:alert(1)">x</a> <a href="javascript:y">y</a></p>') == [("x y", None, None, [])]
    assert seen('<p hidden><a href="https://a.b">z</a></p><p>t</p>') == [("t", None, None, [])]


def test_scanned_pages():
    head = "page   num  type   width height color comp bpc  enc interp  object ID x-ppi y-ppi size ratio\n" + "-" * 40
    rows = ["   1     0 image    1654  2339  rgb     3   8  jpeg   no        10  0   200   200  100K 1.0%", "   2     1 image     100   100  rgb     3   8  jpeg   no        11  0   200   200  100K 1.0%", "   3     2 smask    1654  2339  rgb     3   8  jpeg   no        12  0   200   200  100K 1.0%", "   4     3 image    1654  2339  rgb     3   8  jpeg   no        13  0     x   200  100K 1.0%"]
    assert reader.image_pages("\n".join([head, *rows]), reader.A4_AREA) == {1}
    long = "a page with enough text to stand for itself, surely"
    assert [reader.page_kind(t, c) for t, c in [(long, False), (long, True), ("Page 1", False), (" \n", True)]] == ["text", "mixed_or_sparse", "mixed_or_sparse", "no_text"]


def test_program_output_is_bounded(monkeypatch):
    import sys

    assert reader.command([sys.executable, "-c", "print('x' * 100)"]) == b"x" * 100 + b"\n"
    monkeypatch.setattr(reader, "MOST_OUTPUT", 50)
    with pytest.raises(ReadError, match="more than the limit"):
        reader.command([sys.executable, "-c", "print('x' * 100)"])
    with pytest.raises(ReadError, match="failed"):
        reader.command([sys.executable, "-c", "import sys; sys.exit('no')"])
