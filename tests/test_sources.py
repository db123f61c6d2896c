"""Readers of bytes and geometry on small hand-made inputs."""

import io
import zipfile
import zlib

from pyspark.sql import functions as F

from parchmint.sources import layouts, sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def _ooxml():
    return _zip(
        xl__workbook_dot_xml=f'<workbook {MAIN}><sheets><sheet name="One" sheetId="1" r:id="a"/></sheets></workbook>',
        xl___rels__workbook_dot_xml_dot_rels='<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/></Relationships>',
        xl__sharedStrings_dot_xml=f"<sst {MAIN}><si><t>Name</t></si><si><r><t>To</t></r><r><t>tal</t></r></si></sst>",
        xl__worksheets__s1_dot_xml=f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>12.5</v></c><c r="AA3" t="b"><v>1</v></c></row><row r="4"><c r="A4" t="inlineStr"><is><t> </t></is></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>',
    )


def _odf():
    ns = " ".join(f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{n}:1.0"' for p, n in (("office", "office"), ("table", "table"), ("text", "text")))
    body = '<table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="2"><text:p>r</text:p></table:table-cell><table:table-cell office:value="7"/></table:table-row><table:table-row table:number-rows-repeated="1048000"><table:table-cell table:number-columns-repeated="16000"/></table:table-row>'
    return _zip(mimetype="application/vnd.oasis.opendocument.spreadsheet", content_dot_xml=f'<office:document-content {ns}><office:body><office:spreadsheet><table:table table:name="T">{body}</table:table></office:spreadsheet></office:body></office:document-content>')


def test_workbooks(spark):
    one = {r["row"]: r["cells"] for r in sheets.workbook_rows(_ooxml())}
    assert one[1][:3] == ["Name", None, "x"] and one[3][0] == "Total" and one[3][1] == "12.5" and one[3][26] == "TRUE" and set(one) == {1, 2, 3}
    assert [r["cells"] for r in sheets.workbook_rows(_odf())] == [["r", "r", "7"]] * 2
    files = spark.createDataFrame([("a", bytearray(_ooxml())), ("b", bytearray(b"no zip")), ("c", None), ("d", bytearray(_odf()))], "path string, content binary")
    done = sheets.workbooks(files)
    assert {r["path"]: (len(r["rows"]), r["error"] is None) for r in done.collect()} == {"a": (3, True), "b": (0, False), "c": (0, False), "d": (2, True)}
    assert {r["status"]: r["files"] for r in sheets.conversion_report(done).collect()} == {"read": 2, "failed": 2}


def test_text_layers(spark):
    deflated = b"%PDF\nstream\n" + zlib.compress(b"BT /F1 12 Tf (Hello) Tj ET") + b"\nendstream"
    rows = [("a", b"%PDF /Font << /ToUnicode 1 0 R >>", "text"), ("b", b"%PDF /XObject image", "none"), ("c", deflated, "text"), ("d", None, "none"), ("e", b"stream\nbroken\nendstream", "none")]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c, _ in rows], "path string, content binary")
    assert {r["path"]: r["layer"] for r in layouts.text_layers(df).collect()} == {p: w for p, _, w in rows}


def test_artifacts_keep_what_is_well_formed(spark):
    kind = "spans array<struct<id:string,kind:string,text:string,bounds:struct<x:double,y:double,width:double,height:double>>>, tables array<struct<id:string,columns:array<struct<x0:double,x1:double>>,rows:array<struct<y0:double,y1:double>>>>"
    spans = [("1", "number", "5", (0.1, 0.1, 0.2, 0.2)), ("2", "number", " ", (0.1, 0.1, 0.2, 0.2)), ("3", None, "5", (0.1, 0.1, 0.2, 0.2)), ("4", "date", "x", (1.5, 0.1, 0.2, 0.2)), ("5", "date", "x", None)]
    tables = [("t", [(0.1, 0.2), (0.3, 0.4)], [(0.1, 0.2)]), ("u", [(0.1, 0.2)], [(0.1, 0.2)]), ("v", [(0.2, 0.1), (0.3, 0.4)], [(0.1, 0.2)]), (None, [], [])]
    r = spark.createDataFrame([(spans, tables)], kind).select(layouts.valid_spans(F.col("spans")).alias("s"), layouts.valid_tables(F.col("tables")).alias("t")).first()
    assert [s["id"] for s in r["s"]] == ["1"] and [t["id"] for t in r["t"]] == ["t"]


def test_turned_and_cropped_pages(spark):
    g = spark.createDataFrame([("d", 1, "a", 0.1, 0.2, 0.3, 0.05), ("d", 2, "b", 0.1, 0.2, 0.3, 0.05)], "doc string, page int, char string, x double, y double, w double, h double")
    turns = spark.createDataFrame([("d", 1, 4)], "doc string, page int, turns int")
    assert layouts.turned_pages(g, turns).collect() == g.collect()
    clips = spark.createDataFrame([("d", 2, 0.5, 0.0, 0.5, 1.0)], "doc string, page int, cx double, cy double, cw double, ch double")
    got = {r["page"]: (round(r["x"], 6), round(r["w"], 6), r["char"]) for r in layouts.uncropped(g, clips).collect()}
    assert got == {1: (0.1, 0.3, "a"), 2: (0.55, 0.15, "b")}


def test_nested_geometry_and_hocr(spark):
    schema = "doc string, geometry struct<pages:array<struct<pageIndex:int,characters:array<struct<char:string,x:double,y:double,width:double,height:double,lineIndex:int>>>>>"
    e = layouts.entries(spark.createDataFrame([("d", ([(0, [("a", 0.1, 0.2, 0.1, 0.1, 0), ("b", 0.2, 0.2, 0.1, 0.1, 0)]), (1, [])],))], schema)).collect()
    assert [(r["page"], r["i"], r["char"], round(r["x1"], 6)) for r in e] == [(0, 0, "a", 0.2), (0, 1, "b", 0.3)]
    h = spark.createDataFrame([("d", 1, "<span class='ocrx_word' id='w' title='bbox 10 20 50 40; x_wconf 91'>Net</span>", 100, 100)], "doc string, page int, hocr string, width int, height int")
    assert [(r["char"], round(r["x0"], 4), r["confidence"]) for r in layouts.hocr_glyphs(h).orderBy("i").collect()] == [("N", 0.1, 91), ("e", 0.2333, 91), ("t", 0.3667, 91)]


def test_inline_images():
    got = sheets.with_inline_images('<img src="cid:a@b"> <img src=cid:zz>', {"a@b": ("image/png", b"\x01")})
    assert got == '<img src="data:image/png;base64,AQ=="> <img src=cid:zz>'


def test_mail_with_an_image_and_a_long_sheet():
    from parchmint.sources import decoders

    mail = b"""From: a@x.org\nSubject: Hi\nMIME-Version: 1.0\nContent-Type: multipart/related; boundary=B\n\n--B\nContent-Type: text/html\n\n<img src="cid:p1">\n--B\nContent-Type: image/png\nContent-ID: <p1>\nContent-Transfer-Encoding: base64\n\nAQ==\n--B--\n"""
    assert 'src="data:image/png;base64,AQ=="' in decoders.mail_parts(mail)["body"]
    cells, cut = decoders.delimited("a,b\n" * 5001)
    assert cut and len(cells) == 10_000 and decoders.delimited("a,b\n1,2\n")[1] is False and decoders.delimited(",".join("x" * 300))[1] is True
