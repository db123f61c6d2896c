"""Queries on what spans, lines and cells say, over printed lines with a known meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import spans
from parchmint.operators import reading
from parchmint.sources.tables import grouped, money, table


def classified_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One printed line per order in seven contexts; each figure's category by the context alone."""
    k = F.col("o_orderkey")
    n = (k % 800 + 100).cast("string")
    shape = k % 7
    line = (
        F.when(shape == 0, F.concat(F.lit("Revenue was $"), grouped(money("o_totalprice")), F.lit(" this year")))
        .when(shape == 1, F.concat(F.lit("Call (408) 996-1"), n))
        .when(shape == 2, F.concat(F.lit("Commission file number "), n))
        .when(shape == 3, F.concat(F.lit("Securities Act 19"), (k % 60 + 33).cast("string")))
        .when(shape == 4, F.concat(F.lit("the board met about "), n, F.lit(" matters that were of some concern to all")))
        .when(shape == 5, F.concat(F.lit("the notes shown here in this table are due "), n))
        .otherwise(F.concat(F.lit("Suite "), n))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    s = spans.with_spans(rows, "line", ("o_orderkey", "line")).select("o_orderkey", "line", F.explode("spans").alias("s"))
    flat = s.select("o_orderkey", "line", *(F.col("s." + c).alias(c) for c in ("start", "end", "kind", "text", "date_precision")))
    flat = flat.withColumn("furniture", F.lit(False)).withColumn("height", F.lit(None).cast("double")).withColumn("page_height", F.lit(None).cast("double")).withColumn("isolated", F.lit(False))
    return reading.classified(flat).select("o_orderkey", "category", "reason")


CLASSIFIED_SPANS = """
SELECT o_orderkey, CASE WHEN s IN (0, 5) THEN 'value' WHEN s IN (3, 4) THEN 'noise' ELSE 'reference' END AS category,
  CASE s WHEN 1 THEN 'phone' WHEN 2 THEN 'identifier' WHEN 3 THEN 'citation-year' WHEN 4 THEN 'unsupported' WHEN 6 THEN 'identifier' END AS reason
FROM (SELECT o_orderkey, o_orderkey % 7 AS s FROM orders)
"""


def list_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines per order: chains of its line numbers; short orders have none, every third prints in brackets."""
    numbered = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    mark = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("("), F.col("l_linenumber").cast("string"), F.lit(")"))).otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit(".")))
    lines = numbered.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.col("l_linenumber").alias("line"), F.concat(mark, F.lit(" item text")).alias("text"), F.lit(0.1).alias("left"))
    return reading.ordinal_chains(lines).select("doc", F.col("line").cast("long").alias("line"), "kind")


LIST_CHAINS = """
WITH l AS (SELECT DISTINCT l_orderkey doc, l_linenumber n FROM lineitem), r AS (SELECT *, n - row_number() OVER (PARTITION BY doc ORDER BY n) g FROM l),
c AS (SELECT *, count(*) OVER (PARTITION BY doc, g) k FROM r)
SELECT doc, n::BIGINT AS line, CASE WHEN doc % 3 = 0 THEN 'footnote-marker' ELSE 'list-marker' END AS kind FROM c WHERE k >= 3
"""


def note_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note headings printed per part, some wrapped over two lines, some continued, some not titles."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand")
    n = (F.col("k") % 900 + 1).cast("string")
    first = (
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("Note 0"), n, F.lit(" — Income Taxes"))).when(F.col("k") % 4 == 1, F.concat(F.lit("NOTE "), n, F.lit(": Commitments and")))
        .when(F.col("k") % 4 == 2, F.concat(F.lit("Note "), n, F.lit(" – Leases (Continued)"))).otherwise(F.concat(F.lit("note "), n, F.lit(" that we were not able to find")))
    )
    lines = p.select(F.col("k").alias("doc"), F.posexplode(F.array(first, F.lit("Contingencies"))).alias("line", "text"))
    return reading.note_headings(lines).select("doc", "id", "title", "continued")


NOTE_CATALOGUE = """
SELECT p_partkey AS doc, CAST(p_partkey % 900 + 1 AS VARCHAR) AS id, CASE p_partkey % 4 WHEN 0 THEN 'Income Taxes' WHEN 1 THEN 'Commitments and Contingencies' ELSE 'Leases' END AS title,
  p_partkey % 4 = 2 AS continued FROM part WHERE p_partkey % 4 < 3
"""


def cited_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.lit(1).alias("line"), F.concat(F.lit("for more, see Notes "), (F.col("p_partkey") % 30 + 1).cast("string"), F.lit(", 4.1 and "), (F.col("p_size") + 40).cast("string"), F.lit(" below")).alias("text"))
    return reading.note_citations(p).select("doc", "raw")


CITED_NOTES = """
SELECT p_partkey AS doc, unnest([CAST(p_partkey % 30 + 1 AS VARCHAR), '4.1', CAST(p_size + 40 AS VARCHAR)]) AS raw FROM part
"""


def cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are one printed number in six forms, and one that isn't."""
    p, q, k = money("l_extendedprice"), F.col("l_quantity").cast("int").cast("string"), F.col("l_orderkey") + F.col("l_linenumber")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("$"), grouped(p))).when(k % 6 == 1, F.concat(F.lit("$ ("), grouped(p), F.lit(")"))).when(k % 6 == 2, F.concat(F.lit("("), q, F.lit(")%")))
        .when(k % 6 == 3, F.concat(q, F.lit(" million"))).when(k % 6 == 4, F.concat(F.lit("−"), q, F.lit(".5"))).otherwise(F.concat(q, F.lit(" to 9")))
    )
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", reading.whole_number(text).alias("n"))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("n.value", 6).alias("value"), "n.percent", "n.currency", "n.brackets", F.col("n.places").cast("long").alias("places"))


CELL_VALUES = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE s WHEN 0 THEN l_extendedprice WHEN 1 THEN -l_extendedprice WHEN 2 THEN round(-q / 100.0, 6) WHEN 3 THEN q * 1000000.0 WHEN 4 THEN -q - 0.5 END::DOUBLE AS value,
  CASE WHEN s < 5 THEN s = 2 END AS percent, CASE WHEN s < 5 THEN s <= 1 END AS currency, CASE WHEN s < 5 THEN s IN (1, 2) END AS brackets,
  CASE s WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 1 END::BIGINT AS places
FROM (SELECT *, (l_orderkey + l_linenumber) % 6 AS s, CAST(l_quantity AS INT) AS q FROM lineitem)
"""


def wrapped_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.lit(1).alias("page"))
    words = F.array(*map(F.lit, ("Million in cash", "thousands of them", "nothing more", "billionaires came")))
    follow = F.element_at(words, (F.col("doc") % 4 + 1).cast("int"))
    lines = s.select("doc", "page", F.posexplode(F.array(F.concat(F.lit("we paid $"), F.col("doc").cast("string")), follow)).alias("line", "text"))
    return reading.with_wrapped_magnitude(lines).where("line = 0").select("doc", "magnitude")


WRAPPED_MAGNITUDES = "SELECT s_suppkey AS doc, CASE s_suppkey % 4 WHEN 0 THEN 1000000 WHEN 1 THEN 1000 END::BIGINT AS magnitude FROM supplier"


def queued_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open equations of each page in reading order."""
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("unreviewed").alias("status"), F.lit("vertical").alias("axis"),
        F.col("o_custkey").alias("page"), F.col("o_totalprice").alias("y"), F.lit(0.0).alias("x"))
    return reading.review_queue(e).select("id", F.col("place").cast("long").alias("place"))


QUEUED_REVIEWS = "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)::BIGINT AS place FROM orders WHERE o_orderstatus <> 'F'"


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words on lines with a wide gap after every third: three words a segment."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.lit(1).alias("line"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    x0 = F.col("i") * 0.05 + F.floor(F.col("i") / 3) * 0.06
    words = s.select("page", "line", x0.alias("x0"), (x0 + 0.045).alias("x1"), F.lit(0.009).alias("char"), F.concat(F.lit("w"), F.col("i").cast("string")).alias("text"))
    return reading.segments(words).select("page", F.col("segment").cast("long").alias("segment"), "text")


LINE_SEGMENTS = "SELECT s_suppkey AS page, v.s::BIGINT AS segment, v.t AS text FROM supplier, (VALUES (1, 'w0 w1 w2'), (2, 'w3 w4 w5'), (3, 'w6 w7')) v(s, t)"

_WORDS = {"•": "bullet", "$": "currency", "EUR": "currency", "2024": "period", "Q2": "period", "9/27/25": "date", "(4.1)%": "percent", "1,234.50": "numeric", "$(12)": "numeric", "(a)": "ordinal", "12.": "ordinal", "†": "marker", "—": "symbol", "Assets": "word", "x12": "word"}


def word_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, _WORDS))).alias("word"))
    return rows.select("n_nationkey", "word", reading.word_class(F.col("word")).alias("kind"))


WORD_CLASSES = "SELECT n_nationkey, word, kind FROM nation, (VALUES " + ", ".join(f"('{w}', '{k}')" for w, k in _WORDS.items()) + ") v(word, kind)"

QUERIES = {
    "classified_spans": (classified_spans, CLASSIFIED_SPANS),
    "list_chains": (list_chains, LIST_CHAINS),
    "note_catalogue": (note_catalogue, NOTE_CATALOGUE),
    "cited_notes": (cited_notes, CITED_NOTES),
    "cell_values": (cell_values, CELL_VALUES),
    "wrapped_magnitudes": (wrapped_magnitudes, WRAPPED_MAGNITUDES),
    "queued_reviews": (queued_reviews, QUEUED_REVIEWS),
    "line_segments": (line_segments, LINE_SEGMENTS),
    "word_classes": (word_classes, WORD_CLASSES),
}
