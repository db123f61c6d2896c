"""Operators on small hand-made inputs."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from parchmint.functions import scalars
from parchmint.operators import geometry, library, reconcile, windows
from parchmint.sources import decoders


def _foot(spark, cells, total):
    df = spark.createDataFrame([([D(c) for c in cells], None if total is None else D(total))], "cells array<decimal(38,2)>, total decimal(38,2)")
    return reconcile.footed(df).first()


@pytest.mark.parametrize(
    "cells,total,outcome,reason,diagnosis",
    [
        (["1", "2", "3"], "6", "confirmed", None, None),
        (["10", "2", "3"], "5", "confirmed", None, None),
        (["1", "2"], "3", "unresolved", "run-too-short", None),
        (["1", "2", "3"], None, "unresolved", "no-total", None),
        (["1", "2", "3"], "60", "unresolved", "no-plausible-run", None),
        (["100", "200", "300"], "600.02", "unresolved", "rounding-indeterminate", None),
        (["100", "200", "300"], "609", "break", None, "transposition"),
        (["100", "200", "300"], "700", "break", None, "single-glyph"),
        (["100", "200", "300"], "604.50", "break", None, None),
        (["100", "200", "300"], "400", "break", None, "sign"),
        (["100", "200", "300"], "612.50", "break", None, None),
    ],
)
def test_footing(spark, cells, total, outcome, reason, diagnosis):
    r = _foot(spark, cells, total)
    assert (r["outcome"], r["reason"], r["diagnosis"]) == (outcome, reason, diagnosis)


def test_run_predicates(spark):
    df = spark.createDataFrame([(1, [D(1), D(2), D(3)]), (2, [D(1), D(-1), D(5)]), (3, [D(1), D(2), D(4)])], "id int, c array<decimal(38,2)>")
    got = {r["id"]: (r["double"], r["cancel"]) for r in df.select("id", reconcile.double_counts(F.col("c")).alias("double"), reconcile.cancels(F.col("c")).alias("cancel")).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, False)}


def test_proportional(spark):
    df = spark.createDataFrame([(1, [D(1), D(2)], [D(3), D(6)]), (2, [D(1), D(2)], [D(3), D(7)])], "id int, a array<decimal(18,2)>, b array<decimal(18,2)>")
    assert [r[0] for r in df.orderBy("id").select(reconcile.proportional(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_best_outcomes(spark):
    df = spark.createDataFrame([("v", "s1", "break", 1), ("v", "s1", "confirmed", 2), ("c", "s1", "unresolved", 3), ("v", "s1", "confirmed", 4)], "axis string, span string, outcome string, ord int")
    assert sorted((r["axis"], r["ord"]) for r in reconcile.best_outcomes(df).collect()) == [("c", 3), ("v", 2)]


def test_scalars(spark):
    def one(expr):
        return spark.range(1).select(expr.alias("x")).first()["x"]

    assert one(scalars.decimal_identifier(F.lit("03.02"))) == "3.2"
    assert one(scalars.decimal_identifier(F.lit("1000.1"))) is None
    assert one(scalars.roman_identifier(F.lit("xiv"))) == "XIV"
    assert one(scalars.roman_identifier(F.lit("iiii"))) is None
    assert one(scalars.number_format(F.lit(True), F.lit(False), F.lit(True), F.lit(2))) == "$#,##0.00;($#,##0.00)"
    assert one(scalars.literal_cell(F.lit("=A1"))) == "'=A1"
    assert one(scalars.looks_like_title(F.lit("Commitments and Contingencies"))) is True
    assert one(scalars.looks_like_title(F.lit("the quick brown fox"))) is False
    assert one(scalars.skeleton(F.lit(" Page  12 of 30 "))) == "Page # of #"
    assert one(scalars.is_opening_balance(F.lit("Cash, beginning of year"))) is True
    assert one(scalars.calibrated(F.lit(0.42))) == 0.5
    assert one(scalars.iou(*(F.lit(float(v)) for v in (0, 0, 2, 2, 1, 1, 3, 3)))) == pytest.approx(1 / 7)


def test_running_clusters():
    assert geometry.running_clusters([1.0, 1.1, 1.25, 3.0, 3.05], 0.2) == [0, 0, 0, 1, 1]
    assert geometry.running_clusters([], 0.2) == []


def _box(i, x0, y0, x1, y1, **more):
    return {"id": i, "x0": x0, "y0": y0, "x1": x1, "y1": y1} | more


def test_suppression():
    boxes = [_box(1, 0, 0, 2, 2, confidence=0.9), _box(2, 0.1, 0, 2.1, 2, confidence=0.8), _box(3, 0, 0, 1, 1, confidence=0.95), _box(4, 5, 5, 6, 6, confidence=0.1)]
    assert [b["id"] for b in geometry.suppress(boxes)] == [3, 4]


def test_copies():
    lines = [_box(1, 0, 0, 10, 1, text="a"), _box(2, 0.5, 0.1, 10, 1, text="a"), _box(3, 0, 0, 10, 1, text="b"), _box(4, 5, 0, 20, 1, text="a")]
    assert [r["id"] for r in geometry.first_copies(lines)] == [1, 3, 4]


def test_one_to_one():
    g = [_box(1, 0, 0, 2, 2, side="expected", page=7), _box(2, 0.1, 0, 2, 2, side="expected", page=7), _box(9, 0, 0, 2, 2, side="predicted", page=7)]
    assert [(m["expected"], m["predicted"]) for m in geometry.one_to_one(g, 0.5)] == [(1, 9)]


def test_rule_groups():
    g = [_box(1, 0, 0, 10, 0, page=1), _box(2, 5, 0, 5, 9, page=1), _box(3, 20, 0, 30, 0, page=1)]
    assert {r["id"]: r["component"] for r in geometry.rule_groups(g)} == {1: 1, 2: 1, 3: 3}


def test_span_ids_count_alike_spans(spark):
    df = spark.createDataFrame([("d", "value", 1, "5", "b", 1), ("d", "value", 1, "5", "b", 2), ("d", "value", 2, "5", "b", 3)], "doc string, category string, page int, text string, box string, ord int")
    ids = [r["span_id"] for r in windows.span_ids(df, ["ord"]).collect()]
    assert len(set(ids)) == 3 and all(len(i) == 20 and i.startswith("val-") for i in ids)


def test_links_find_parts_of_words_and_short_keys(spark):
    pages = spark.createDataFrame([(1, 1, "Invoice INV-2210 for Acme"), (1, 2, "x"), (2, 1, "acme inv-2210x due")], "doc int, page int, text string")
    keys = spark.createDataFrame([(1, 0, "nv-221"), (1, 1, "due"), (2, 0, "x"), (3, 0, "absent"), (4, 0, " ")], "row int, ord int, key string")
    got = {r["row"]: (r["doc"], r["page"], r["keys"]) for r in library.link_rows(keys, pages).collect()}
    assert got == {1: (2, 1, 2), 2: (1, 2, 1)}


def test_search_overlaps(spark):
    lines = spark.createDataFrame([(1, 1, "anana an")], "doc int, line int, text string")
    assert sorted((r["at"], r["exact"]) for r in library.search_lines(lines, "ana").collect()) == [(1, False), (3, False)]
    ranked = library.exact_first(library.search_lines(lines, "an"), limit=1).collect()
    assert [(r["at"], r["exact"]) for r in ranked] == [(7, True)]


def test_descendants_show_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "parent int, child int")
    got = {(r["parent"], r["child"]) for r in library.descendants(spark, edges).collect()}
    assert (1, 1) in got and (4, 5) in got and (4, 4) not in got


def test_decoding(spark):
    rows = [(1, b"\xef\xbb\xbfabc"), (2, "é".encode()), (3, b"caf\xe9"), (4, "ab".encode("utf-16"))]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id int, content binary")
    assert {r[0]: r[1] for r in df.select("id", decoders.decoded(F.col("content"))).collect()} == {1: "abc", 2: "é", 3: "café", 4: "ab"}


def test_sheets_mail_artifacts():
    assert decoders.sniffed("a;b;c\n1,5;2;3\n") == ";"
    assert decoders.sheet_cells("a,b\n1,2\n,\n")[-1] == (2, 2, "2")
    mail = b"From: a@x.org\nTo: b@x.org\nSubject: Hi\nContent-Type: text/plain\n\nBody\n"
    got = decoders.mail_parts(mail)
    assert (got["from"], got["subject"], got["body"].strip(), got["attachments"]) == ("a@x.org", "Hi", "Body", [])
    assert decoders.read_artifact(decoders.artifact({"a": [1, "é"]})) == {"a": [1, "é"]}


def test_markdown_and_hocr(spark):
    df = spark.createDataFrame([("# **Head**\n\n- one\n2. two\npara [l](u)", "<span class='ocrx_word' id='w' title='bbox 1 2 3 4; x_wconf 91'>Net</span>")], "md string, hocr string")
    r = df.select(decoders.markdown_lines(F.col("md")).alias("m"), decoders.hocr_words(F.col("hocr")).alias("h")).first()
    assert [(x["kind"], x["text"]) for x in r["m"]] == [("heading", "Head"), ("bullet", "one"), ("item", "two"), ("paragraph", "para l")]
    assert [(x["text"], x["x0"], x["y1"]) for x in r["h"]] == [("Net", 1, 4)]
