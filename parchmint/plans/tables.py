"""Queries on tables: planted grids read back from their words, rules, rectangles and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.operators import tables
from parchmint.operators.grouping import kept
from parchmint.sources.tables import grouped, money, table

CHAR = 0.008


def _set(text: str) -> list[tuple[float, str]]:
    """Words of a line of prose and where they begin."""
    at, out = 0.1, []
    for t in text.split():
        out.append((at, t))
        at += (len(t) + 1) * CHAR
    return out


def _page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per order: a line of prose, a header of two periods, one row per line number, the label of every third wrapped
    onto a second line, figures at the right of their columns with a currency mark apart, and prose below."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_quantity").cast("int")).alias("q"), F.max(money("l_extendedprice")).alias("p"))
    nth = F.row_number().over(tables.Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    li = li.withColumn("i", nth).withColumn("n", F.count("*").over(tables.Window.partitionBy("l_orderkey")))
    word = lambda line, x, text, y, right=False: F.struct(F.lit(line).alias("line") if isinstance(line, int) else line.alias("line"), (F.lit(x) - F.length(text) * CHAR if right else F.lit(x) + F.length(text) * 0).alias("x0"), text.alias("text"), y.alias("y0"))
    y = 0.2 + F.col("i") * 0.04
    label = F.concat(F.lit("Row"), F.col("i").cast("string"))
    body = [word(F.col("i") * 2 + 10, 0.1, label, y), word(F.col("i") * 2 + 10, 0.5, grouped(F.col("p")), y, True), word(F.col("i") * 2 + 10, 0.38, F.lit("$"), y), word(F.col("i") * 2 + 10, 0.8, F.col("q").cast("string"), y, True)]
    tail = [word(F.col("i") * 2 + 11, 0.12, F.lit("continued"), y + 0.0135)]
    prose = [word(1, x, F.lit(t), F.lit(0.1)) for x, t in _set("these are the figures of one single order of this customer as we have printed them for him")]
    below = [word(900, x, F.lit(t), 0.24 + F.col("n") * 0.04) for x, t in _set("nothing that is said below of the table belongs to it or to any of its rows at all")]
    heads = [word(5, 0.5, F.lit("2024"), F.lit(0.2), True), word(5, 0.8, F.lit("2023"), F.lit(0.2), True)]
    # one pass over the rows, not a union of passes: the words of a page stay where the window put its rows
    every = F.concat(F.array(*body), F.when(F.col("i") % 3 == 0, F.array(*tail)).otherwise(F.array()), F.when(F.col("i") == 1, F.array(*prose, *heads, *below)).otherwise(F.array()))
    return li.select("l_orderkey", F.explode(every).alias("w")).select(F.col("l_orderkey").alias("page"), F.col("w.line").cast("int").alias("line"), "w.text", "w.x0", F.col("w.y0").alias("y0"), (F.col("w.x0") + F.length("w.text") * CHAR).alias("x1"), (F.col("w.y0") + 0.012).alias("y1"), F.lit(CHAR).alias("char"))


def planted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the tables found on the pages that show one table each (orders of three lines or more)."""
    cells = tables.detected(_page_words(spark, sf_dir), placed=True).where("accepted")
    return cells.select("page", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "header", "text").where("text <> ''")


PLANTED_TABLES = """
WITH l AS (SELECT l_orderkey AS page, l_linenumber, max(CAST(l_quantity AS INT)) AS q, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS p FROM lineitem GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY l_linenumber) AS i, count(*) OVER (PARTITION BY page) AS n FROM l)
SELECT page, i AS row, CAST(0 AS BIGINT) AS col, false AS header, 'Row' || i || CASE WHEN i % 3 = 0 THEN ' continued' ELSE '' END AS text FROM i
UNION ALL SELECT page, i, 1, false, '$ ' || format('{:,.2f}', p::DOUBLE) FROM i UNION ALL SELECT page, i, 2, false, q::VARCHAR FROM i
UNION ALL SELECT page, 0, c, true, t FROM i, (VALUES (1, '2024'), (2, '2023')) v(c, t) WHERE i = 1
"""


def table_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column labels and the periods they name, and a viewer's row numbers, of the planted tables."""
    cells = kept(tables.detected(_page_words(spark, sf_dir), placed=True).where("accepted"))
    labels = tables.column_labels(cells).groupBy("page").agg(F.concat_ws(",", F.sort_array(F.collect_list("period"))).alias("periods"))
    rows = tables.shown_rows(cells).groupBy("page").agg(F.max("shown").cast("long").alias("rows"))
    splits = tables.value_signatures(cells).groupBy("page").agg(F.count_if("splits").alias("splits"))
    again = tables.repeated_headers(cells).groupBy("page").agg(F.count("*").alias("again"))
    return labels.join(rows, "page").join(tables.table_counts(cells).select("page", "tables"), "page").join(splits, "page").join(again, "page", "left").na.fill(0, ["again"])


TABLE_PERIODS = "SELECT l_orderkey AS page, '2023,2024' AS periods, count(DISTINCT l_linenumber) AS rows, CAST(1 AS BIGINT) AS tables, CAST(0 AS BIGINT) AS splits, CAST(0 AS BIGINT) AS again FROM lineitem GROUP BY 1"


def ruled_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertical and horizontal rules of a region per supplier: pieces merged, stray ones dropped, boundaries and edges read."""
    s = F.col("s_suppkey")
    rule = lambda i, v, at, lo, hi: F.struct(F.lit(i).cast("long").alias("id"), F.lit(v).alias("vertical"), F.lit(at).alias("at"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    made = [rule(1, True, 0.1, 0.1, 0.5), rule(2, True, 0.3, 0.1, 0.32), rule(3, True, 0.302, 0.3, 0.5), rule(4, True, 0.6, 0.1, 0.5), rule(5, True, 0.9, 0.1, 0.5), rule(6, True, 0.75, 0.1, 0.2), rule(7, True, 0.97, 0.6, 0.9),
            rule(11, False, 0.1, 0.1, 0.9), rule(12, False, 0.25, 0.1, 0.9), rule(13, False, 0.5, 0.1, 0.9), rule(14, False, 0.4, 0.1, 0.35)]
    rules = table(spark, sf_dir, "supplier").select(s.alias("page"), F.explode(F.array(*made)).alias("r")).select("page", "r.*")
    kept = rules.join(tables.coherent_rules(rules), ["page", "id"])
    lines = tables.parallel_rules(kept.where("vertical"))
    region = table(spark, sf_dir, "supplier").select(s.alias("region"), s.alias("page"), F.lit(0.1).alias("x0"), F.lit(0.1).alias("y0"), F.lit(0.9).alias("x1"), F.lit(0.5).alias("y1"))
    xs = tables.ruled_boundaries(lines.select("page", F.col("at").alias("x"), F.col("lo").alias("y0"), F.col("hi").alias("y1")), region)
    ys = tables.ruled_rows(kept.where("not vertical").select("page", F.col("at").alias("y"), F.col("lo").alias("x0"), F.col("hi").alias("x1")), region)
    shown = lambda c: F.array_join(F.transform(c, lambda v: F.format_string("%.3f", v)), ",")
    n = kept.groupBy("page").agg(F.count("*").alias("kept"))
    return xs.join(ys, "region").join(n, F.col("region") == F.col("page")).select("region", shown("xs").alias("xs"), shown("ys").alias("ys"), "kept")


RULED_GRIDS = "SELECT s_suppkey AS region, '0.301,0.600' AS xs, '0.100,0.250,0.500' AS ys, CAST(9 AS BIGINT) AS kept FROM supplier"


def pointed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table a rectangle points at, per supplier: the one that covers more, else the surer, else the smaller."""
    s = F.col("s_suppkey")
    box = lambda i, c, x0, x1: F.struct(F.lit(i).alias("table"), F.lit(c).alias("confidence"), F.lit(x0).alias("x0"), F.lit(0.1).alias("y0"), F.lit(x1).alias("x1"), F.lit(0.9).alias("y1"))
    t = table(spark, sf_dir, "supplier").select(s.alias("page"), F.explode(F.array(box(1, 0.9, 0.1, 0.4), box(2, 0.6, 0.35, 0.9), box(3, 0.9, 0.3, 0.9), box(4, 0.902, 0.32, 0.8))).alias("t")).select("page", "t.*")
    r = table(spark, sf_dir, "supplier").select(s.alias("region"), s.alias("page"), F.when(s % 2 == 0, 0.12).otherwise(0.5).alias("x0"), F.lit(0.2).alias("y0"), F.when(s % 2 == 0, 0.38).otherwise(0.7).alias("x1"), F.lit(0.8).alias("y1"))
    return tables.best_table(r, t).select("region", F.col("table").cast("long").alias("table"), "cover")


POINTED_TABLES = "SELECT s_suppkey AS region, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 4 END::BIGINT AS table, 1.0::DOUBLE AS cover FROM supplier"


def glyph_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names as glyphs, their parts joined to words by the gaps between them, and the cells their centres lie in."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.posexplode(F.split(F.regexp_replace("c_name", "#", " "), "")).alias("i", "char"))
    g = c.where("trim(char) <> ''").select("page", F.lit(1).alias("line"), "char", F.col("i"), (F.col("i") * 0.01).alias("x0"), (F.col("i") * 0.01 + 0.009).alias("x1"), F.lit(0.1).alias("y0"), F.lit(0.12).alias("y1"))
    words = tables.words(g).select("page", F.col("word").cast("long").alias("word"), "text")
    grids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.array(F.lit(0.085)).alias("xs"), F.array(F.lit(0.05), F.lit(0.2)).alias("ys"))
    cells = tables.glyph_cells(g, grids).groupBy("page").agg(F.count_if(F.col("col") == 1).alias("right"), F.max("row").cast("long").alias("row"))
    return words.join(cells, "page")


GLYPH_WORDS = """
SELECT c_custkey AS page, v.w::BIGINT AS word, split_part(c_name, '#', v.w) AS text, len(split_part(c_name, '#', 2)) AS right, CAST(1 AS BIGINT) AS row FROM customer, (VALUES (1), (2)) v(w)
"""


def cell_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a cell per part: a well-formed one wins over a surer odd one; two well-formed ones are ambiguous."""
    k = F.col("p_partkey")
    read = lambda t, c, f: F.struct((F.lit(t) if isinstance(t, str) else t).alias("text"), F.lit(c).alias("confidence"), F.lit(f).alias("well_formed"))
    other = F.when(k % 2 == 0, "1,235").otherwise("l,234")
    rows = F.array(read("1,234", 80.0, True), read("1,234", 70.0, True), F.struct(other.alias("text"), F.lit(88.0).alias("confidence"), (k % 2 == 0).alias("well_formed")))
    t = table(spark, sf_dir, "part").select(k.alias("cell"), F.explode(rows).alias("r")).select("cell", "r.*")
    return tables.chosen_reading(t)


CELL_READINGS = "SELECT p_partkey AS cell, '1,234' AS text, p_partkey % 2 = 0 AS ambiguous FROM part"

QUERIES = {
    "planted_tables": (planted_tables, PLANTED_TABLES),
    "table_periods": (table_periods, TABLE_PERIODS),
    "ruled_grids": (ruled_grids, RULED_GRIDS),
    "pointed_tables": (pointed_tables, POINTED_TABLES),
    "glyph_words": (glyph_words, GLYPH_WORDS),
    "cell_readings": (cell_readings, CELL_READINGS),
}
