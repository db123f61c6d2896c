"""Queries on the apparatus of documents: catalogues, lists, footnotes, furniture, boxes and contexts, over printed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.operators import catalog, evidence, lists, search
from parchmint.sources.tables import dealt, grouped, money, table

CHAR, TALL = 0.006, 0.01


def _printed(rows: DataFrame, doc: Column, lines: list[tuple], when: dict[int, Column] | None = None) -> DataFrame:
    """Lines (page, text, left, top[, height]) of each row's document; ``when`` keeps some lines for some documents only."""
    made = []
    for i, (page, text, left, top, *tall) in enumerate(lines):
        made.append(F.struct(F.lit(page).cast("long").alias("page"), F.lit(i).cast("long").alias("line"), (F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(float(left)).alias("left"),
            F.lit(float(top)).alias("top"), F.lit(float(tall[0] if tall else TALL)).alias("height"), (when or {}).get(i, F.lit(True)).alias("shown")))
    out = dealt(rows, doc).select(doc.alias("doc"), F.explode(F.filter(F.array(*made), lambda x: x["shown"])).alias("l"))
    return out.select(F.col("doc").cast("long").alias("doc"), "l.page", "l.line", "l.text", "l.left", (F.col("l.left") + F.length("l.text") * CHAR).alias("right"), "l.top", (F.col("l.top") + F.col("l.height")).alias("bottom"), F.lit(CHAR).alias("char"), "l.height")


#: A report that indexes itself: contents on its first page, headings, and citations of both.
_REPORT = [
    (0, "TABLE OF CONTENTS", 0.4, 0.05), (0, "PART I", 0.1, 0.08), (0, "Item 1.", 0.1, 0.10), (0, "Business", 0.2, 0.10), (0, "3", 0.85, 0.10),
    (0, "Item 01A.", 0.1, 0.12), (0, "Risk Factors", 0.2, 0.12), (0, "7", 0.85, 0.12), (0, "PART II", 0.1, 0.14), (0, "Item 7.", 0.1, 0.16), (0, "Discussion and Analysis of Financial", 0.2, 0.16),
    (0, "Condition ........", 0.2, 0.175), (0, "31", 0.85, 0.175), (0, "Item 8. Statements ......", 0.1, 0.20), (0, "40", 0.85, 0.20), (0, "Signatures", 0.1, 0.22),
    (1, "PART I", 0.1, 0.05), (1, "Item 1. Business", 0.1, 0.10), (1, "We sell things, and Item 1A lists risks.", 0.1, 0.12), (1, "Item 1A — Risk Factors and", 0.1, 0.20), (1, "Their Effects", 0.154, 0.214),
    (1, "as Item 601 of Regulation S-K asks, see Item 7, “Discussion” above", 0.1, 0.30), (2, "Part II", 0.1, 0.05), (2, "Item 7. Discussion (Continued)", 0.1, 0.10), (2, "nothing of Item 9 is here", 0.1, 0.30),
]


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    with_contents = k % 3 != 0
    return _printed(table(spark, sf_dir, "part"), k, _REPORT, {i: with_contents for i in range(16)})


def item_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of a report per part number; every third report has no contents page and is known by its headings alone."""
    lines = _report(spark, sf_dir)
    contents = catalog.contents_rows(lines)
    return catalog.item_catalogue(contents, catalog.item_headings(lines, contents))


_ITEMS = (
    ("true", "1", "I", "Business", "contents", 1, 1), ("true", "1A", "I", "Risk Factors", "contents", 1, 1), ("true", "7", "II", "Discussion and Analysis of Financial Condition", "contents", 1, 1), ("true", "8", "II", "Statements", "contents", 1, 0),
    ("false", "1", "I", "Business", "heading", 0, 1), ("false", "1A", "I", "Risk Factors and Their Effects", "heading", 0, 1), ("false", "7", "II", "Discussion", "heading", 0, 1),
)
ITEM_CATALOGUE = "SELECT p_partkey AS doc, id, v.part, title, title_source, in_contents::BIGINT AS in_contents, in_body::BIGINT AS in_body FROM part p JOIN (VALUES " + ", ".join(f"({a}, '{b}', '{c}', '{d}', '{e}', {f}, {g})" for a, b, c, d, e, f, g in _ITEMS) + ") v(toc, id, part, title, title_source, in_contents, in_body) ON (p_partkey % 3 <> 0) = v.toc"


def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of contents pages, under the part printed above them, a wrapped title folded upward."""
    return catalog.contents_rows(_report(spark, sf_dir)).select("doc", "id", "part", "title", "printed_page", F.size("lines").cast("long").alias("lines"))


CONTENTS_PAGES = """
SELECT p_partkey AS doc, id, v.part, title, printed_page, n::BIGINT AS lines FROM part, (VALUES ('1', 'I', 'Business', '3', 3), ('1A', 'I', 'Risk Factors', '7', 3),
  ('7', 'II', 'Discussion and Analysis of Financial Condition', '31', 4), ('8', 'II', 'Statements', '40', 2)) v(id, part, title, printed_page, n) WHERE p_partkey % 3 <> 0
"""


def item_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _report(spark, sf_dir)
    contents = catalog.contents_rows(lines)
    heads = catalog.item_headings(lines, contents)
    return catalog.item_citations(lines, catalog.item_catalogue(contents, heads), contents, heads).select("doc", "line", "id", F.col("entry_part").alias("part"), "title", "start", "end")


ITEM_CITATIONS = """
SELECT p_partkey AS doc, line::BIGINT AS line, id, v.part, title, s::INTEGER AS start, e::INTEGER AS "end" FROM part, (VALUES (18, '1A', 'I', '', 20, 27), (21, '7', 'II', 'Discussion', 40, 60)) v(line, id, part, title, s, e)
"""

_NOTES = [
    (1, "NOTES TO CONSOLIDATED FINANCIAL STATEMENTS", 0.1, 0.05), (1, "Note 1 — Leases and Other", 0.1, 0.10), (1, "Obligations", 0.154, 0.114), (1, "1. Leases", 0.1, 0.20), (1, "2. Income Taxes", 0.1, 0.30),
    (2, "Note 1: Leases and Other Obligations (continued)", 0.1, 0.10), (2, "NOTE 02 – Income Taxes", 0.1, 0.20), (2, "D. Signature", 0.1, 0.30), (3, "as told in Notes 1, 2 and 9, and in Note 2, Income Taxes, there are few", 0.1, 0.30),
]


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    named = k % 2 == 1
    return _printed(table(spark, sf_dir, "supplier"), k, _NOTES, {1: named, 2: named, 5: named, 6: named, 3: ~named, 4: ~named})


def note_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of a report per supplier: odd ones write "Note 1", even ones head notes by bare numbers."""
    return catalog.note_catalogue(catalog.note_headings(_notes(spark, sf_dir)))


NOTE_ENTRIES = """
SELECT s_suppkey AS doc, id, title, n::BIGINT AS headings FROM supplier JOIN (VALUES (1, '1', 'Leases and Other Obligations', 2), (1, '2', 'Income Taxes', 1), (0, '1', 'Leases', 1), (0, '2', 'Income Taxes', 1)) v(odd, id, title, n) ON s_suppkey % 2 = odd
"""


def note_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _notes(spark, sf_dir)
    heads = catalog.note_headings(lines)
    return catalog.note_citations(lines, catalog.note_catalogue(heads), heads).select("doc", "line", F.array_join("ids", ",").alias("ids"), "title", "start", "end")


NOTE_MENTIONS = """
SELECT s_suppkey AS doc, CAST(8 AS BIGINT) AS line, ids, title, s::INTEGER AS start, e::INTEGER AS "end" FROM supplier, (VALUES ('1,2', '', 11, 27), ('2', 'Income Taxes', 36, 56)) v(ids, title, s, e)
"""


def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document is a filing with items, a statement with notes, or neither, explicit for every document."""
    items, notes = _report(spark, sf_dir), _notes(spark, sf_dir)
    shift = lambda df, by: df.withColumn("doc", F.col("doc") + by)
    plain = _printed(table(spark, sf_dir, "nation"), F.col("n_nationkey"), [(0, "Nothing is headed here", 0.1, 0.1)])
    lines = items.union(shift(notes, 10**9)).union(shift(plain, 2 * 10**9))
    contents = catalog.contents_rows(lines)
    catalogue = catalog.item_catalogue(contents, catalog.item_headings(lines, contents))
    told = catalog.applicability(lines, catalogue, catalog.note_catalogue(catalog.note_headings(lines)))
    return told.groupBy("kind").agg(F.count("*").alias("documents"), F.sum("items").alias("items"), F.sum("notes").alias("notes"))


DOCUMENT_KINDS = """
SELECT 'filing' AS kind, count(*) AS documents, sum(CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 4 END)::BIGINT AS items, CAST(0 AS BIGINT) AS notes FROM part
UNION ALL SELECT 'statement', count(*), 0, 2 * count(*) FROM supplier UNION ALL SELECT 'neither', count(*), 0, 0 FROM nation
"""

_LISTS = [
    (1, "1. first of the items", 0.1, 0.10), (1, "2. second of the items", 0.1, 0.12), (1, "3.", 0.1, 0.14), (1, "third item beside it", 0.2, 0.14), (1, "5. fifth has no place here", 0.1, 0.16),
    (1, "we sell (1) books to all; (2) music of sorts; (3) tools of trade", 0.1, 0.20), (1, "China (1)", 0.1, 0.30), (1, "(2)", 0.3, 0.30, 0.005), (1, "(3)", 0.5, 0.30), (1, "Japan (2)(1)", 0.1, 0.32),
    (1, "(1) China includes two more", 0.1, 0.80), (1, "(2) Japan has none other", 0.1, 0.82), (1, "(3) Nobody knows them", 0.1, 0.84), (2, "Peru (1)", 0.1, 0.10), (2, "(7) One note alone here", 0.1, 0.80), (2, "(5) % of all the sales", 0.1, 0.85),
    (3, "Mali (7)", 0.1, 0.1), (3, "(7) Mali is on its own", 0.1, 0.5),
    *[(1, "a line of ordinary text", 0.1, 0.4 + i / 100) for i in range(12)],
]


def list_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals of lists and footnotes, and the marks that refer to them, on three pages per supplier."""
    return lists.list_marks(_printed(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), _LISTS)).select("doc", "line", "start", "text", "kind")


_MARKS = [
    (0, 0, "1.", "list-marker"), (1, 0, "2.", "list-marker"), (2, 0, "3.", "list-marker"), (5, 8, "(1)", "list-marker"), (5, 26, "(2)", "list-marker"), (5, 46, "(3)", "list-marker"), (6, 6, "(1)", "footnote-reference"), (7, 0, "(2)", "footnote-reference"),
    (9, 6, "(2)", "footnote-reference"), (9, 9, "(1)", "footnote-reference"), (10, 0, "(1)", "footnote-marker"), (11, 0, "(2)", "footnote-marker"), (12, 0, "(3)", "footnote-marker"), (16, 5, "(7)", "footnote-reference"), (17, 0, "(7)", "footnote-marker"),
]
LIST_MARKS = "SELECT s_suppkey AS doc, line::BIGINT AS line, s::INTEGER AS start, text, kind FROM supplier, (VALUES " + ", ".join(f"({a}, {b}, '{c}', '{d}')" for a, b, c, d in _MARKS) + ") v(line, s, text, kind)"


def wrapped_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates whose year stands under the month and day, in two columns; too far below for every fifth order."""
    d = F.col("o_orderdate")
    head = F.concat(F.rpad(F.concat(F.date_format(d, "MMMM d"), F.lit(",")), 30, " "), F.date_format(F.date_add(d, 40), "MMM d"))
    year = F.concat(F.rpad(F.concat(F.lit("   "), F.date_format(d, "yyyy")), 31, " "), F.date_format(F.date_add(d, 40), "yyyy"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.array(head, year)).alias("line", "text"))
    top = F.when((F.col("line") == 1) & (F.col("o_orderkey") % 5 == 0), 0.2).otherwise(0.1 + F.col("line") * 0.012)
    lines = rows.select(F.col("o_orderkey").alias("doc"), F.lit(1).alias("page"), "line", "text", top.alias("top"), (top + 0.01).alias("bottom"), F.lit(0.01).alias("height"), F.lit(0.1).alias("left"), F.lit(CHAR).alias("char"))
    return evidence.wrapped_dates(lines).select("doc", F.col("start").cast("long").alias("start"), "normalized")


WRAPPED_DATES = """
SELECT o_orderkey AS doc, v.s::BIGINT AS start, strftime(o_orderdate + INTERVAL 1 DAY * v.d, '%Y-%m-%d') AS normalized FROM orders, (VALUES (0, 0), (30, 40)) v(s, d) WHERE o_orderkey % 5 <> 0
"""


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pages per nation with a running head, a caption of a date on each, a body line that repeats and a page number."""
    n, page = F.col("n_nationkey"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("page")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", page)
    p = F.col("page").cast("string")
    texts = F.array(F.concat(F.lit("Annual Report of "), F.col("n_name")), F.lit("As of December 31, 2025"), F.concat(F.lit("Body "), F.translate(p, "0123456789", "abcdefghij"), F.lit(" text")), F.lit("Payable within 30 days"), F.concat(F.lit("more "), F.translate(p, "0123456789", "jihgfedcba")), F.concat(F.lit("Form 10-K | "), p))
    lines = rows.select(n.alias("doc"), "page", F.posexplode(texts).alias("line", "text")).withColumn("top", F.col("line") * 0.1)
    return evidence.edge_furniture(lines).select("doc", F.col("page").cast("long").alias("page"), F.col("line").cast("long").alias("line"))


PAGE_EDGES = "SELECT n_nationkey AS doc, p AS page, l::BIGINT AS line FROM nation, range(1, 11) r(p), (VALUES (0), (5)) v(l)"


def page_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Currency and scale of a page per customer, and the currency of its nation's pages."""
    k = F.col("c_custkey")
    code = F.element_at(F.array(*map(F.lit, ("USD", "EUR", "GBP"))), (k % 3 + 1).cast("int"))
    mark = F.element_at(F.array(*map(F.lit, ("$", "€", "£"))), ((k + 1) % 3 + 1).cast("int"))
    scale = F.element_at(F.array(*map(F.lit, ("(in millions)", "Amounts in thousands, but a few in billions", "all told"))), (k % 3 + 1).cast("int"))
    text = F.concat(scale, F.lit(" "), F.repeat(F.concat(code, F.lit(" 5 ")), 2), F.repeat(F.concat(mark, F.lit("7 ")), F.when(k % 2 == 0, 3).otherwise(1)))
    return evidence.page_contexts(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), k.alias("page"), text.alias("text")))


PAGE_CONTEXTS = """
WITH c AS (SELECT c_nationkey AS doc, c_custkey AS page, ['USD', 'EUR', 'GBP'][CASE WHEN c_custkey % 2 = 0 THEN (c_custkey + 1) % 3 ELSE c_custkey % 3 END + 1] AS currency, CASE c_custkey % 3 WHEN 0 THEN 1000000 WHEN 1 THEN 1000000000 END::BIGINT AS scale FROM customer),
v AS (SELECT doc, currency, count(*) n, min(page) f FROM c GROUP BY ALL), d AS (SELECT doc, currency AS doc_currency FROM v QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, f) = 1)
SELECT c.doc, page, currency, scale, doc_currency FROM c JOIN d ON d.doc = c.doc
"""


def figure_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box, height and white space of a figure's glyphs: set apart in a column for even suppliers, in prose for odd."""
    k = F.col("s_suppkey")
    glyph = lambda i, x, h: F.struct(F.lit(i).alias("i"), (F.lit(x) if isinstance(x, float) else x).alias("x"), F.lit(0.5).alias("y"), F.lit(0.01).alias("w"), F.lit(h).alias("h"))
    gap = F.when(k % 2 == 0, 0.05).otherwise(0.01)
    made = F.array(glyph(0, 0.10, 0.02), glyph(1, 0.11, 0.02), glyph(3, F.lit(0.12) + gap, 0.012), glyph(4, F.lit(0.13) + gap, 0.014), glyph(6, F.lit(0.14) + gap * 2, 0.02))
    keys = [k.alias("doc"), F.lit(1).alias("page"), F.lit(1).alias("line")]
    glyphs = table(spark, sf_dir, "supplier").select(*keys, F.explode(made).alias("g")).select("doc", "page", "line", F.lit("5").alias("char"), "g.*")
    spans = table(spark, sf_dir, "supplier").select(*keys, F.lit(3).alias("start"), F.lit(5).alias("end"))
    b = evidence.span_boxes(spans, glyphs)
    return b.select("doc", *(F.round(c, 6).alias(c) for c in ("x", "y", "w", "h", "height")), "isolated")


FIGURE_BOXES = "SELECT s_suppkey AS doc, CASE WHEN s_suppkey % 2 = 0 THEN 0.17 ELSE 0.13 END::DOUBLE AS x, 0.5::DOUBLE AS y, 0.02::DOUBLE AS w, 0.014::DOUBLE AS h, 0.013::DOUBLE AS height, s_suppkey % 2 = 0 AS isolated FROM supplier"


def second_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recognition passes of a page per supplier: the second adds a line, and replaces a weaker one for even suppliers."""
    s = table(spark, sf_dir, "supplier")
    line = lambda i, y, c, t: F.struct(F.lit(i).alias("id"), F.lit(0.1).alias("x0"), F.lit(y).alias("y0"), F.lit(0.5).alias("x1"), F.lit(y + 0.02).alias("y1"), (F.lit(c) if isinstance(c, float) else c).alias("confidence"), F.lit(t).alias("text"))
    page = lambda *ls: s.select(F.col("s_suppkey").alias("page"), F.explode(F.array(*ls)).alias("l")).select("page", "l.*")
    weak = F.when(F.col("s_suppkey") % 2 == 0, 0.4).otherwise(0.9)
    merged = evidence.merged_reading(page(line(1, 0.1, 0.8, "kept"), line(2, 0.2, weak, "weak")), page(line(11, 0.105, 0.7, "no better"), line(12, 0.201, 0.6, "surer"), line(13, 0.4, 0.3, "new")))
    return merged.select("page", "text", F.col("pass").cast("long").alias("pass"))


SECOND_READINGS = "SELECT s_suppkey AS page, t AS text, p::BIGINT AS pass FROM supplier JOIN (VALUES (0, 'kept', 1), (0, 'surer', 2), (0, 'new', 2), (1, 'kept', 1), (1, 'weak', 1), (1, 'new', 2)) v(odd, t, p) ON s_suppkey % 2 = odd"


def matched_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed totals found by a bare figure, whatever brackets and commas they were printed with."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", money("o_totalprice").alias("p"))
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit("due ("), grouped(F.col("p")), F.lit("), net"))).when(k == 1, F.concat(F.lit("due "), grouped(F.col("p")), F.lit("; see 1,2,3"))).when(k == 2, F.lit("due $ — in all")).otherwise(F.lit("due 1,21"))
    one = search.found(o.select(F.col("o_orderkey").alias("doc"), F.lit(1).alias("line"), text.alias("text")), "1,2")
    zero = search.found(o.select(F.col("o_orderkey").alias("doc"), F.lit(2).alias("line"), text.alias("text")).where(k == 2), "0")
    return one.groupBy("doc").agg(F.count("*").alias("hits"), F.count_if("exact").alias("exact")).union(zero.groupBy("doc").agg(F.count("*"), F.count_if("exact")))


MATCHED_FORMS = """
WITH t AS (SELECT o_orderkey AS doc, o_orderkey % 4 AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM orders),
f AS (SELECT doc, CASE k WHEN 0 THEN p WHEN 1 THEN p || ' 123' WHEN 3 THEN '121' END AS s FROM t WHERE k <> 2)
SELECT doc, ((length(s) - length(replace(s, '12', ''))) // 2)::BIGINT AS hits, CAST(0 AS BIGINT) AS exact FROM f WHERE contains(s, '12')
UNION ALL SELECT doc, 1, 1 FROM t WHERE k = 2
"""

QUERIES = {
    "item_catalogue": (item_catalogue, ITEM_CATALOGUE),
    "contents_pages": (contents_pages, CONTENTS_PAGES),
    "item_citations": (item_citations, ITEM_CITATIONS),
    "note_entries": (note_entries, NOTE_ENTRIES),
    "note_mentions": (note_mentions, NOTE_MENTIONS),
    "document_kinds": (document_kinds, DOCUMENT_KINDS),
    "list_marks": (list_marks, LIST_MARKS),
    "wrapped_dates": (wrapped_dates, WRAPPED_DATES),
    "page_edges": (page_edges, PAGE_EDGES),
    "page_contexts": (page_contexts, PAGE_CONTEXTS),
    "figure_boxes": (figure_boxes, FIGURE_BOXES),
    "second_readings": (second_readings, SECOND_READINGS),
    "matched_forms": (matched_forms, MATCHED_FORMS),
}
