"""Queries on lines, pages, bands and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import scalars
from parchmint.operators import geometry, windows
from parchmint.sources.tables import table


def furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight pages per supplier: a constant header, a page-number footer, a body line with free figures on each page and
    one without a word of its own. Only header and footer are furniture."""
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), "s_name", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("page"))
    lines = F.array(
        F.concat(F.lit("Annual report of "), F.col("s_name")), F.concat(F.lit("Page  "), F.col("page").cast("string"), F.lit(" of 8")),
        F.concat(F.lit("Shipment "), (F.col("page") * F.col("page")).cast("string"), F.lit(" weighed")), F.lit("of the year"), F.concat(F.lit("Only page "), F.when(F.col("page") == 1, F.lit("one"))),
    )
    return windows.repeating_skeletons(pages.select("doc", "page", F.explode(lines).alias("text")).where("text is not null"))


FURNITURE = """
SELECT s_suppkey AS doc, 'Annual report of ' || regexp_replace(s_name, '[0-9]+', '#', 'g') AS skeleton, CAST(8 AS BIGINT) AS pages FROM supplier
UNION ALL SELECT s_suppkey, 'Page # of #', 8 FROM supplier
"""


def page_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve pages per supplier with a bare figure at the foot: counting on for two suppliers in three, else scattered;
    pages 5 and 9 miss theirs, and a second figure at another height is no page number."""
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("page"))
    pages = pages.where(~F.col("page").isin(5, 9))
    foot = F.when(F.col("doc") % 3 > 0, F.col("page") + F.col("doc") % 50).otherwise(F.col("page") * F.col("page") + 3)
    feet = pages.select("doc", "page", foot.cast("string").alias("text"), F.lit(0.95).alias("top"))
    other = pages.where("page in (2, 7)").select("doc", "page", (F.col("page") + 900).cast("string").alias("text"), F.lit(0.4).alias("top"))
    return windows.page_numbers(feet.union(other)).select("doc", F.col("page").cast("long").alias("page"), F.col("value").cast("long").alias("value"))


PAGE_NUMBERING = """
SELECT s_suppkey AS doc, CAST(p.page AS BIGINT) AS page, CAST(p.page + s_suppkey % 50 AS BIGINT) AS value
FROM supplier, range(1, 13) p(page) WHERE s_suppkey % 3 > 0 AND p.page NOT IN (5, 9)
"""


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return geometry.quality(docs).withColumn("ratio", F.round("ratio", 3))


TEXT_QUALITY = r"""
SELECT doc_id AS doc, length(regexp_replace(coalesce(text, ''), '[\t\n\v\f\r ]', '', 'g'))::BIGINT AS chars, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]'))::BIGINT AS letters,
  len(regexp_extract_all(coalesce(text, ''), '[^\t\n\v\f\r ]+'))::BIGINT AS words, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''))::BIGINT AS lines,
  len(regexp_extract_all(coalesce(text, ''), '[\x{FFFD}\x{0}-\x{8}]'))::BIGINT AS garbled,
  CASE WHEN chars > 0 THEN round(round_even(letters / chars, 4), 3) ELSE 0 END::DOUBLE AS ratio
FROM documents
"""


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events without a gap over six hours: the shape of bands of lines and of blocks of rows."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    seconds = lambda c: c.cast("timestamp").cast("double")
    gap = seconds(F.col("ts")) - seconds(windows.lagged("ts", ["user_id"], ["ts", "event_id"])) > 6 * 3600
    runs = windows.islands(e, ["user_id"], ["ts", "event_id"], gap)
    return runs.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.round(F.sum("value"), 2).alias("value"))


LINE_RUNS = """
WITH m AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 21600 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM m)
SELECT user_id, island, count(*) AS n, min(event_id) AS first_id, round(sum(value), 2) AS value FROM i GROUP BY user_id, island
"""


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as points on fifty pages, by quantity and discount, in a grid of ten columns and four rows."""
    pages = spark.range(50).withColumnRenamed("id", "page")
    band = lambda n, size: pages.select("page", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx")).withColumn("lo", F.col("idx") * size).withColumn("hi", (F.col("idx") + 1) * size)
    points = table(spark, sf_dir, "lineitem").select(F.pmod("l_orderkey", F.lit(50)).alias("page"), F.col("l_quantity").cast("double").alias("x"), F.round(F.col("l_discount") * 100).cast("double").alias("y"), F.col("l_orderkey").alias("value"))
    out = geometry.cells_of_points(points, band(10, 5.0), band(4, 3.0))
    return out.select("page", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "n", "value")


GRID_CELLS = """
WITH p AS (SELECT l_orderkey % 50 AS page, CAST(floor(l_quantity / 5) AS BIGINT) AS col, CAST(floor(round(l_discount * 100) / 3) AS BIGINT) AS row, l_orderkey k FROM lineitem)
SELECT page, row, col, count(*) AS n, CASE WHEN count(*) = 1 THEN min(k) END AS value FROM p WHERE col < 10 AND row < 4 GROUP BY page, row, col
"""


def nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of each purchase, the user's latest earlier event of another type: the label to the left of a figure."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    kinds = e.withColumn("label", F.when(F.col("event_type") != "purchase", F.concat_ws(":", "event_type", F.col("event_id").cast("string"))))
    seen = windows.carried_forward(kinds, ["user_id"], ["ts", "event_id"], "label", "nearest")
    return seen.where("event_type = 'purchase'").select("event_id", "nearest")


NEAREST_LABEL = """
SELECT event_id, nearest FROM (
  SELECT event_id, event_type, last_value(CASE WHEN event_type <> 'purchase' THEN event_type || ':' || event_id END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nearest FROM events)
WHERE event_type = 'purchase'
"""


def white_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two to four columns whose cells jitter within bounds; the corridors between them are known."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), (F.lit(2) + F.col("s_suppkey") % 3).cast("int").alias("k"))
    lines = s.select("page", "k", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("line"))
    cells = lines.select("page", "k", "line", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c"))
    x0 = (F.col("c") * 100 + 4 + (F.col("page") * 7 + F.col("line") * 3) % 5 + 0.5) / 400
    x1 = (F.col("c") * 100 + 80 - (F.col("page") * 5 + F.col("line") * 7) % 5 + 0.5) / 400
    got = geometry.corridors(cells.select("page", "line", x0.alias("x0"), x1.alias("x1"), (F.col("c") < 0).alias("numeric")), support=1.0)
    return got.select("page", F.col("start").cast("long").alias("first"), F.col("end").cast("long").alias("last"))


WHITE_CORRIDORS = """
WITH l AS (SELECT s_suppkey page, 2 + s_suppkey % 3 k, i FROM supplier, range(1, 13) r(i)),
e AS (SELECT page, k, max(80 - (page * 5 + i * 7) % 5) hi, min(104 + (page * 7 + i * 3) % 5) lo FROM l GROUP BY page, k)
SELECT page, CAST(c * 100 + hi + 1 AS BIGINT) AS first, CAST(c * 100 + lo AS BIGINT) AS last FROM e, range(0, 3) g(c) WHERE c < k - 1
"""


def turned_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (d("l_quantity") / 128).alias("x"), d("l_tax").alias("y"), (d("l_discount") + 0.125).alias("w"), F.lit(0.25).alias("h"))
    box = scalars.rotated(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("l_orderkey").cast("int"))
    b = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", box.alias("b"))
    return b.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(F.round("b." + n, 9).alias(n) for n in "xywh"))


TURNED_BOXES = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(CASE t WHEN 0 THEN x WHEN 1 THEN 1 - y - h WHEN 2 THEN 1 - x - w ELSE y END, 9) AS x,
  round(CASE t WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 1 - y - h ELSE 1 - x - w END, 9) AS y,
  round(CASE WHEN t % 2 = 0 THEN w ELSE h END, 9) AS w, round(CASE WHEN t % 2 = 0 THEN h ELSE w END, 9) AS h
FROM (SELECT *, l_orderkey % 4 AS t, l_quantity / 128 AS x, l_tax AS y, l_discount + 0.125 AS w, 0.25::DOUBLE AS h FROM lineitem)
"""


def glyph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names laid out as glyphs on a fixed pitch and read back as text by position and gap."""
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.lit(1).alias("line"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return geometry.text_of_glyphs(geometry.glyphs_of_lines(lines)).select(F.col("doc").alias("p_partkey"), "text")


GLYPH_ROUND_TRIP = "SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part"

_PHRASES = (
    "Total net sales", "(3) Total assets", "Net income", "Network costs", "Totally fine", "Gross profit", "Balance at December 31", "Subtotal", "Sub-total fees",
    "Operating income", "Balances at start", "1. Balance", "— Gross margin", "Grosses", "Effective tax rate", "Corporate", "Average shares", "Per share data", "Margin %", "Useful life (years)",
    "Consolidated", "Combined ratio", "Net", "Net cash provided by operating activities", "Cash used in investing activities", "Net income attributable to noncontrolling interests",
    "Net loss attributable to redeemable noncontrolling interest", "Opening balance", "Cash, beginning of year", "2024", "Q3 2025",
)


def label_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What statement labels say, for a list of labels by each part brand."""
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    rows = brands.select("p_brand", F.explode(F.array(*map(F.lit, _PHRASES))).alias("label"))
    t = F.col("label")
    return rows.select("p_brand", "label", scalars.is_total_label(t).alias("total"), scalars.is_total_column(t).alias("total_column"), scalars.is_non_additive(t).alias("non_additive"),
                       scalars.is_noncontrolling(t).alias("noncontrolling"), scalars.cash_flow_activity(t).alias("activity"), scalars.period_in(t).alias("period"))


def _label_sql() -> str:
    values = ", ".join("('" + p.replace("'", "''") + "')" for p in _PHRASES)
    total = ("Total net sales", "(3) Total assets", "Net income", "Gross profit", "Balance at December 31", "Subtotal", "Sub-total fees", "Balances at start", "1. Balance", "— Gross margin", "Net",
             "Net cash provided by operating activities", "Net income attributable to noncontrolling interests", "Net loss attributable to redeemable noncontrolling interest")
    column = ("Total net sales", "Net income", "Consolidated", "Combined ratio", "Net", "Net cash provided by operating activities", "Net income attributable to noncontrolling interests", "Net loss attributable to redeemable noncontrolling interest")
    off = ("Effective tax rate", "Average shares", "Per share data", "Margin %", "— Gross margin", "Useful life (years)")
    some = lambda names: "label IN (" + ", ".join(f"'{n}'" for n in names) + ")"
    return f"""
SELECT p_brand, label, {some(total)} AS total, {some(column)} AS total_column, {some(off)} AS non_additive, label LIKE 'Net %attributable%' AS noncontrolling,
  CASE WHEN label LIKE '%operating activities' THEN 'operating' WHEN label LIKE '%investing activities' THEN 'investing' END AS activity,
  CASE label WHEN '2024' THEN '2024' WHEN 'Q3 2025' THEN 'Q3' END AS period
FROM (SELECT DISTINCT p_brand FROM part), (VALUES {values}) v(label)
"""


def span_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids of spans, with a count for those alike: an event's type on a page at a place."""
    e = table(spark, sf_dir, "events").select(F.lit("d").alias("doc"), F.lit("value").alias("category"), F.pmod("user_id", F.lit(40)).alias("page"), F.col("event_type").alias("text"), F.lit("0.100|0.200").alias("box"), "event_id")
    return windows.span_ids(e, ["event_id"]).select("event_id", "span_id")


SPAN_IDENTITY = """
SELECT event_id, 'val-' || substr(sha256('val|' || (user_id % 40) || '|' || event_type || '|0.100|0.200|' || (row_number() OVER (PARTITION BY user_id % 40, event_type ORDER BY event_id) - 1)), 1, 16) AS span_id FROM events
"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a box, a page per eight order numbers; ids count a page's lines."""
    d = lambda c: F.col(c).cast("double")
    base = table(spark, sf_dir, "lineitem").withColumn("page", F.floor(F.col("l_orderkey") / 8))
    order = windows.Window.partitionBy("page").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    base = base.select("page", F.row_number().over(order).cast("long").alias("id"), d("l_quantity").alias("q"), d("l_discount").alias("disc"))
    return base.select("page", "id", (F.col("q") / 64).alias("x0"), (F.col("disc") * 5).alias("y0"), (F.col("q") / 64 + 0.2).alias("x1"), (F.col("disc") * 5 + 0.2).alias("y1"), (F.col("q") / 50).alias("confidence"))


def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.without_overlaps(_boxes(spark, sf_dir), ["page"])


def matched_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    moved = b.select("page", F.lit("predicted").alias("side"), "id", *((F.col(c) + 0.01).alias(c) for c in ("x0", "y0", "x1", "y1")))
    return geometry.matched(b.select("page", F.lit("expected").alias("side"), "id", "x0", "y0", "x1", "y1").union(moved))


def value_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).select("page", "id", F.col("x0").alias("v"))
    return geometry.clustered(rows, ["page"], 0.03)


def crossing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.rule_components(_boxes(spark, sf_dir))


def coincident_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).withColumn("text", F.concat(F.lit("line "), (F.col("id") % 4).cast("string")))
    return geometry.without_copies(b).select("page", "text", "id")


QUERIES = {
    "furniture": (furniture, FURNITURE),
    "page_numbering": (page_numbering, PAGE_NUMBERING),
    "text_quality": (text_quality, TEXT_QUALITY),
    "line_runs": (line_runs, LINE_RUNS),
    "grid_cells": (grid_cells, GRID_CELLS),
    "nearest_label": (nearest_label, NEAREST_LABEL),
    "white_corridors": (white_corridors, WHITE_CORRIDORS),
    "turned_boxes": (turned_boxes, TURNED_BOXES),
    "glyph_round_trip": (glyph_round_trip, GLYPH_ROUND_TRIP),
    "label_readings": (label_readings, _label_sql()),
    "span_identity": (span_identity, SPAN_IDENTITY),
    "suppressed_boxes": (suppressed_boxes, None),
    "matched_boxes": (matched_boxes, None),
    "value_clusters": (value_clusters, None),
    "crossing_rules": (crossing_rules, None),
    "coincident_lines": (coincident_lines, None),
}
