"""Queries on page geometry and sheets as readers give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.operators import evidence
from parchmint.sources import layouts, sheets
from parchmint.sources.tables import dealt, table


def typeset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents set on pages: lines wrapped at a hundred characters, sixty lines a page."""
    t = layouts.text_pages(table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), "text"))
    return t.groupBy("doc").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("lines"), F.round(F.max("y1"), 6).alias("bottom"))


TYPESET_PAGES = r"""
WITH l AS (SELECT doc_id AS doc, unnest(regexp_split_to_array(text, '\r?\n')) t FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc, sum(greatest(1, (length(replace(t, chr(13), '')) + 99) // 100)) AS lines FROM l GROUP BY doc)
SELECT doc, ((lines + 59) // 60)::BIGINT AS pages, lines::BIGINT AS lines, round(0.05 + (least(lines, 60) - 1) * 0.015 + 0.012, 6)::DOUBLE AS bottom FROM n
"""


def placed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text items placed by a page's matrix: upright ones and ones turned a quarter, per supplier."""
    s = F.col("s_suppkey").cast("double")
    turned = F.col("s_suppkey") % 2 == 1
    m = F.when(turned, F.array(*map(F.lit, (0.0, 1.0, -1.0, 0.0)), F.lit(300.0), s + 100)).otherwise(F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0)), s + 10, F.lit(700.0)))
    item = F.struct(m.alias("m"), F.lit(50.0).alias("width"), F.lit(10.0).alias("height"))
    box = layouts.item_box(item, F.array(*map(F.lit, (1.0, 0.0, 0.0, -1.0, 0.0, 800.0))), F.lit(600.0), F.lit(800.0), F.lit(0.9), F.lit(-0.2))
    return table(spark, sf_dir, "supplier").select("s_suppkey", box.alias("b")).select("s_suppkey", *(F.round("b." + c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")))


PLACED_ITEMS = """
SELECT s_suppkey, round(CASE WHEN t THEN 291 / 600.0 ELSE (s_suppkey + 10) / 600.0 END, 9)::DOUBLE AS x0, round(CASE WHEN t THEN (650 - s_suppkey) / 800.0 ELSE 91 / 800.0 END, 9)::DOUBLE AS y0,
  round(CASE WHEN t THEN 302 / 600.0 ELSE (s_suppkey + 60) / 600.0 END, 9)::DOUBLE AS x1, round(CASE WHEN t THEN (700 - s_suppkey) / 800.0 ELSE 102 / 800.0 END, 9)::DOUBLE AS y1
FROM (SELECT s_suppkey, s_suppkey % 2 = 1 AS t FROM supplier)
"""


def selection_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a rectangle over two lines per customer: the second comes first in the source, the first ends in a small
    raised mark on a line of its own, a third line lies mostly outside."""
    k = F.col("c_custkey")
    line = lambda n, text, x, y, h: F.struct(F.lit(n).alias("line"), text.alias("text"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), (F.lit(x) + F.length(text) * h / 2).alias("x1"), F.lit(y + h).alias("y1"))
    name = F.concat(F.lit("No"), F.lpad(k.cast("string"), 8, "0"))
    words = dealt(table(spark, sf_dir, "customer"), k).select(k.alias("page"), F.explode(F.array(line(1, F.lit("second"), 0.1, 0.2, 0.02), line(2, F.lit("2"), 0.2015, 0.098, 0.008), line(3, name, 0.1, 0.1, 0.02), line(4, F.lit("outside"), 0.1, 0.245, 0.02))).alias("l")).select("page", "l.*")
    glyphs = layouts.word_glyphs(words, ("page", "line"))
    regions = table(spark, sf_dir, "customer").select(k.alias("region"), k.alias("page"), F.lit(0.05).alias("x0"), F.lit(0.05).alias("y0"), F.lit(0.5).alias("x1"), F.lit(0.25).alias("y1"))
    return layouts.selected_texts(glyphs, regions)


SELECTION_TEXTS = "SELECT c_custkey AS region, 'second' || chr(10) || 'No' || lpad(c_custkey::VARCHAR, 8, '0') || '2' AS text FROM customer"


def recognised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to recognise, by why, and which second readings are taken, per supplier."""
    s = F.col("s_suppkey")
    page = lambda n, chars, share, bad, garbled, image, drawn: F.struct(F.lit(n).alias("page"), F.lit(chars).alias("chars"), F.lit(share).alias("letter_share"), F.lit(bad).alias("invalid_share"), F.lit(garbled).alias("garbled"), F.lit(image).alias("image_share"), F.lit(drawn).alias("drawings"))
    made = F.array(page(1, 900, 0.8, 0.0, False, 0.0, 0), page(2, 900, 0.8, 0.0, True, 0.0, 0), page(3, 20, 0.8, 0.0, False, 0.0, 0), page(4, 900, 0.8, 0.1, False, 0.0, 0), page(5, 0, 0.0, 0.0, False, 0.9, 0), page(6, 0, 0.0, 0.0, False, 0.0, 5), page(7, 0, 0.0, 0.0, False, 0.0, 1))
    t = table(spark, sf_dir, "supplier").select(s.alias("doc"), F.explode(made).alias("p")).select("doc", "p.*")
    why = evidence.pages_to_recognise(t)
    read = lambda c, w, n: F.struct(F.lit(c).alias("confidence"), F.lit(w).alias("words"), F.lit(n).alias("chars"))
    first, poor = read(80.0, 100, 500), read(40.0, 100, 500)
    turned = evidence.takes_turned(F.when(F.col("doc") % 2 == 0, first).otherwise(poor), read(79.0, 60, 300))
    cleaned = evidence.takes_cleaned(first, F.when(F.col("doc") % 2 == 0, read(66.0, 106, 530)).otherwise(read(64.0, 106, 530)))
    few = evidence.sparse_text(F.lit(3), F.lit(61), F.lit(12), F.when(F.col("doc") % 2 == 0, 6).otherwise(5))
    return why.select("doc", F.col("page").cast("long").alias("page"), "why", turned.alias("turned"), cleaned.alias("cleaned"), few.alias("sparse"))


RECOGNISED_PAGES = "SELECT s_suppkey AS doc, p::BIGINT AS page, why, true AS turned, s_suppkey % 2 = 0 AS cleaned, s_suppkey % 2 = 1 AS sparse FROM supplier, (VALUES (2, 'garbled'), (3, 'weak'), (4, 'weak'), (5, 'image'), (6, 'image')) v(p, why)"


def sheet_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and their nations as a sheet in HTML: short rows padded, text escaped, the first row bold."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    rows = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.lit("a").alias("path"), F.lit("s").alias("sheet"), (F.col("r_regionkey") + 2).alias("row"), F.concat(F.array(F.concat(F.lit("<"), F.col("r_name"), F.lit(">&"))), F.slice("names", 1, 2)).alias("cells"))
    head = spark.range(1).select(F.lit("a").alias("path"), F.lit("s").alias("sheet"), F.lit(1).cast("long").alias("row"), F.array(F.lit("Region")).alias("cells"))
    every = head.unionByName(rows.withColumn("row", F.col("row").cast("long"))).withColumn("cells", sheets.padded(F.col("cells"), F.lit(3)))
    return sheets.html_tables(every).select("sheet", "html")


SHEET_HTML = """
WITH n AS (SELECT n_regionkey, list_sort(list(n_name))[1:2] AS names FROM nation GROUP BY 1)
SELECT 's' AS sheet, '<table><tr><th>Region</th><th></th><th></th></tr>' || string_agg('<tr><td>&lt;' || r_name || '&gt;&amp;</td><td>' || names[1] || '</td><td>' || names[2] || '</td></tr>', '' ORDER BY r_regionkey) || '</table>' AS html FROM region JOIN n ON n_regionkey = r_regionkey
"""

QUERIES = {
    "typeset_pages": (typeset_pages, TYPESET_PAGES),
    "placed_items": (placed_items, PLACED_ITEMS),
    "selection_texts": (selection_texts, SELECTION_TEXTS),
    "recognised_pages": (recognised_pages, RECOGNISED_PAGES),
    "sheet_html": (sheet_html, SHEET_HTML),
}
