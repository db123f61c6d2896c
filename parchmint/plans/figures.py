"""Queries that print known figures, read them back with the recogniser, and prove totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import scalars, spans
from parchmint.operators import reconcile, windows
from parchmint.sources.tables import grouped, money, table

# Statement blocks: one per order; every line printed as an amount, and a total with a planted defect by order key:
# 1 in 7 is nine units of a hundred off (a swap of digits), 1 in 7 has the first line's sign turned, 1 in 7 is 100 off, 1 in 7 is 4.50 off.
_PLANT = "pmod(l_orderkey, 7)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money("l_extendedprice").alias("price"))
    return lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "price"))).alias("rows"))


def statement_footing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = F.transform("rows", lambda r: r["price"])
    total = reconcile.scalars.exact_sum(F.col("prices"), "decimal(18,2)")
    plant = F.pmod("l_orderkey", F.lit(7))
    planted = total + F.when(plant == 1, F.lit(900).cast("decimal(18,2)")).when(plant == 2, F.get("prices", F.lit(0)) * -2).when(plant == 3, F.lit(100).cast("decimal(18,2)")).when(plant == 4, F.lit("4.50").cast("decimal(18,2)")).otherwise(0)
    shown = lambda c: F.when(c < 0, F.concat(F.lit("("), grouped(c), F.lit(")"))).otherwise(F.concat(F.lit("$"), grouped(c)))
    blocks = _blocks(spark, sf_dir).withColumn("prices", prices).withColumn("total", planted.cast("decimal(18,2)"))
    page = blocks.select("l_orderkey", F.array_join(F.concat(F.transform("prices", shown), F.array(shown(F.col("total")))), " | ").alias("text"))
    # from here on only what the recogniser read of the printed page is used
    read = spans.with_spans(page, "text", ("l_orderkey",))
    values = F.transform(spans.only(F.col("spans"), "number"), lambda s: s["normalized"].cast("decimal(38,2)"))
    cells = read.withColumn("v", values).select("l_orderkey", F.slice("v", F.lit(1), F.size("v") - 1).alias("cells"), F.element_at("v", -1).alias("total"))
    out = reconcile.footed(cells)
    return out.select("l_orderkey", F.size("cells").cast("long").alias("members"), F.col("sum").cast("double").alias("run_sum"), F.col("total").cast("double").alias("printed"),
                      F.col("delta").cast("double").alias("delta"), "outcome", "reason", "diagnosis", F.coalesce("reversed", F.lit(-1)).cast("long").alias("reversed"))


STATEMENT_FOOTING = """
WITH l AS (
  SELECT l_orderkey k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) i,
         CAST(l_extendedprice AS DECIMAL(18,2)) p FROM lineitem),
b AS (SELECT k, count(*) n, sum(p) s, max(CASE WHEN i = 1 THEN p END) p1 FROM l GROUP BY k),
t AS (SELECT *, s + CASE k % 7 WHEN 1 THEN 900 WHEN 2 THEN -2 * p1 WHEN 3 THEN 100 WHEN 4 THEN 4.50 ELSE 0 END AS total FROM b),
d AS (SELECT *, total - s AS delta FROM t),
suf AS (SELECT l.k, l.i, sum(p) OVER (PARTITION BY l.k ORDER BY i DESC) tail FROM l),
rev AS (SELECT d.k, min(d.n - suf.i + 1) r FROM d JOIN suf ON suf.k = d.k WHERE suf.i > 1 AND suf.tail * 2 = d.s - d.total GROUP BY d.k),
sg AS (SELECT d.k, bool_or(l.p * -2 = d.delta) hit FROM d JOIN l ON l.k = d.k GROUP BY d.k),
o AS (SELECT d.*, CASE WHEN delta = 0 THEN 0 ELSE r END r, sg.hit,
        CASE WHEN n < 3 THEN 'run-too-short' WHEN delta = 0 OR r IS NOT NULL THEN NULL
             WHEN abs(delta) * 200 <= n + 1 THEN 'rounding-indeterminate'
             WHEN abs(CAST(delta AS DOUBLE)) > 0.5 * greatest(abs(CAST(total AS DOUBLE)), abs(CAST(s AS DOUBLE))) THEN 'no-plausible-run' END AS reason
      FROM d LEFT JOIN rev ON rev.k = d.k LEFT JOIN sg ON sg.k = d.k),
p AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'unresolved' WHEN r IS NOT NULL THEN 'confirmed' ELSE 'break' END AS outcome FROM o)
SELECT k AS l_orderkey, n AS members, CAST(s AS DOUBLE) AS run_sum, CAST(total AS DOUBLE) AS printed, CAST(delta AS DOUBLE) AS delta, outcome, reason,
  CASE WHEN outcome <> 'break' THEN NULL WHEN hit THEN 'sign' WHEN CAST(abs(delta) * 100 AS BIGINT) % 900 = 0 THEN 'transposition'
       WHEN length(rtrim(CAST(CAST(abs(delta) * 100 AS BIGINT) AS VARCHAR), '0')) = 1 THEN 'single-glyph' END AS diagnosis,
  CAST(coalesce(r, -1) AS BIGINT) AS reversed
FROM p
"""


def printed_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in five printed shapes, read back."""
    p, q = money("l_extendedprice"), F.col("l_quantity").cast("int")
    shape = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(6))
    text = (
        F.when(shape == 0, F.concat(F.lit("Paid $"), grouped(p), F.lit(" in cash")))
        .when(shape == 1, F.concat(F.lit("loss of ("), grouped(p), F.lit(")")))
        .when(shape == 2, F.concat(F.lit("USD "), grouped(p)))
        .when(shape == 3, F.concat(q.cast("string"), F.lit(".5 million shares")))
        .when(shape == 4, F.concat(F.lit("rose ("), q.cast("string"), F.lit(")%")))
        .otherwise(F.concat(grouped(p), F.lit(" EUR")))
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"))
    read = spans.with_spans(rows, "text", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    s = F.get("spans", F.lit(0))
    return read.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size("spans").cast("long").alias("n"), s["kind"].alias("kind"),
                       s["normalized"].cast("double").alias("value"), s["currency"].alias("currency"), s["magnitude"].alias("magnitude"), s["confidence"].alias("confidence"))


PRINTED_AMOUNTS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(1 AS BIGINT) AS n,
  CASE WHEN s = 4 THEN 'percent' ELSE 'number' END AS kind,
  CASE s WHEN 1 THEN -l_extendedprice WHEN 3 THEN (CAST(l_quantity AS INT) + 0.5) * 1000000 WHEN 4 THEN -CAST(l_quantity AS INT) ELSE l_extendedprice END::DOUBLE AS value,
  CASE WHEN s IN (0, 2) THEN 'USD' WHEN s = 5 THEN 'EUR' END AS currency,
  CASE WHEN s = 3 THEN 1000000 END::BIGINT AS magnitude,
  CASE s WHEN 1 THEN CASE WHEN l_extendedprice >= 1000 THEN 0.94 ELSE 0.82 END WHEN 3 THEN 0.82 ELSE 0.99 END::DOUBLE AS confidence
FROM (SELECT *, (l_orderkey + l_linenumber) % 6 AS s FROM lineitem)
"""


def printed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in seven printed forms, read back at the precision printed."""
    d = F.col("o_orderdate")
    shape = F.pmod("o_orderkey", F.lit(7))
    f = lambda p: F.date_format(d, p)
    text = (
        F.when(shape == 0, f("MMMM d, yyyy")).when(shape == 1, f("d MMM yyyy")).when(shape == 2, f("yyyy-MM-dd")).when(shape == 3, f("M/d/yyyy"))
        .when(shape == 4, f("MMMM yyyy")).when(shape == 5, F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), f("yyyy"))).otherwise(F.concat(F.lit("fiscal "), f("yyyy")))
    )
    read = spans.with_spans(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text", ("o_orderkey",))
    s = F.get("spans", F.lit(0))
    return read.select("o_orderkey", F.size("spans").cast("long").alias("n"), s["normalized"].alias("normalized"), s["date_precision"].alias("date_precision"), s["date_order"].alias("date_order"))


PRINTED_DATES = """
SELECT o_orderkey, CAST(1 AS BIGINT) AS n,
  CASE WHEN s <= 2 OR (s = 3 AND NOT amb) THEN strftime(o_orderdate, '%Y-%m-%d') WHEN s = 3 THEN NULL WHEN s = 4 THEN strftime(o_orderdate, '%Y-%m')
       WHEN s = 5 THEN strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) ELSE strftime(o_orderdate, '%Y') END AS normalized,
  CASE WHEN s <= 3 THEN 'day' WHEN s = 4 THEN 'month' WHEN s = 5 THEN 'quarter' ELSE 'year' END AS date_precision,
  CASE WHEN s = 3 AND amb THEN 'ambiguous' END AS date_order
FROM (SELECT *, o_orderkey % 7 AS s, day(o_orderdate) <= 12 AS amb FROM orders)
"""


def page_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer segment (a document) and nation (a page): the currency its amounts show most, ties to the first of
    the list; the document's is that of most pages, ties to the first page."""
    codes = ("USD", "EUR", "GBP", "JPY")
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("doc"), F.col("c_nationkey").alias("page"),
        F.concat(F.element_at(F.array(*map(F.lit, codes)), (F.pmod(F.col("c_custkey") * 7 + F.col("c_nationkey"), F.lit(4)) + 1).cast("int")), F.lit(" "), grouped(money("c_acctbal"))).alias("text"))
    read = spans.with_spans(rows, "text", ("doc", "page")).select("doc", "page", F.explode("spans").alias("s")).select("doc", "page", "s.currency").where("currency is not null")
    place = F.array_position(F.array(*map(F.lit, codes)), F.col("currency"))
    page = read.groupBy("doc", "page", "currency").agg(F.count("*").alias("n")).groupBy("doc", "page").agg(F.max_by("currency", F.struct("n", -place)).alias("currency"))
    whole = page.groupBy("doc", "currency").agg(F.count("*").alias("n"), F.min("page").alias("first")).groupBy("doc").agg(F.max_by("currency", F.struct("n", -F.col("first"))).alias("doc_currency"))
    return page.join(whole, "doc").select("doc", "page", "currency", "doc_currency")


PAGE_CURRENCY = """
WITH r AS (SELECT c_mktsegment doc, c_nationkey page, 1 + (c_custkey * 7 + c_nationkey) % 4 AS c FROM customer),
n AS (SELECT doc, page, c, count(*) n FROM r GROUP BY ALL),
p AS (SELECT doc, page, c FROM n QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY n DESC, c) = 1),
w AS (SELECT doc, c, count(*) n, min(page) f FROM p GROUP BY ALL),
d AS (SELECT doc, c FROM w QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, f) = 1)
SELECT p.doc, p.page, ['USD','EUR','GBP','JPY'][p.c] AS currency, ['USD','EUR','GBP','JPY'][d.c] AS doc_currency FROM p JOIN d ON d.doc = p.doc
"""


def structure_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of order lines whose sum is the figure below them; each third line is replaced by the sum of the two above."""
    w = windows.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), F.row_number().over(w).alias("row"), money("l_extendedprice").alias("p"),
        (F.lag(money("l_extendedprice"), 1).over(w) + F.lag(money("l_extendedprice"), 2).over(w)).alias("two"))
    cells = rows.select(F.col("l_orderkey").alias("block"), "row", F.when(F.col("row") == 3, F.col("two")).otherwise(F.col("p")).cast("decimal(18,2)").alias("value"))
    return windows.contiguous_ties(cells).select("block", F.col("total_row").cast("long").alias("total_row"), F.col("top_row").cast("long").alias("top_row"), F.col("bottom_row").cast("long").alias("bottom_row"))


STRUCTURE_TIES = """
WITH l AS (SELECT l_orderkey block, row_number() OVER w AS i, CAST(l_extendedprice AS DECIMAL(18,2)) p,
    lag(CAST(l_extendedprice AS DECIMAL(18,2)), 1) OVER w + lag(CAST(l_extendedprice AS DECIMAL(18,2)), 2) OVER w AS two
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
c AS (SELECT block, i, CASE WHEN i = 3 THEN two ELSE p END v FROM l)
SELECT t.block, t.i AS total_row, a.i AS top_row, t.i - 1 AS bottom_row
FROM c t JOIN c a ON a.block = t.block AND a.i <= t.i - 2
JOIN c m ON m.block = t.block AND m.i BETWEEN a.i AND t.i - 1
GROUP BY t.block, t.i, a.i, t.v HAVING sum(m.v) = t.v
"""


def cross_footing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by region (columns) and month (rows) with a Total column, a rate column, and every fifth total wrong."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", money("l_extendedprice").alias("p"))
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    sums = li.join(places.select("s_suppkey", "r_name"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(month.alias("row"), F.col("r_name").alias("header")).agg(F.sum("p").cast("decimal(18,2)").alias("value"))
    totals = sums.groupBy("row").agg(F.sum("value").alias("t")).select("row", F.lit("Total regions").alias("header"), (F.col("t") + F.when(F.col("row") % 5 == 0, 9).otherwise(0)).cast("decimal(18,2)").alias("value"))
    rates = totals.select("row", F.lit("Average rate").alias("header"), F.lit(3).cast("decimal(18,2)").alias("value"))
    return reconcile.cross_footed(sums.union(totals).union(rates).withColumn("block", F.lit(1))).select("row", F.col("sum").cast("double").alias("run_sum"), F.col("total").cast("double").alias("printed"), "outcome")


CROSS_FOOTING = """
SELECT row, CAST(s AS DOUBLE) AS run_sum, CAST(s + CASE WHEN row % 5 = 0 THEN 9 ELSE 0 END AS DOUBLE) AS printed,
       CASE WHEN n >= 2 AND row % 5 <> 0 THEN 'confirmed' ELSE 'unresolved' END AS outcome
FROM (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS row, sum(CAST(l_extendedprice AS DECIMAL(18,2))) s, count(DISTINCT r_regionkey) n
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
"""


def span_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans the recogniser finds in whole documents, and how many tokens it refused to cut."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.col("text").rlike("[0-9]"))
    found = spans.with_spans(lines, "text", ("doc_id", "line")).select("doc_id", "line", F.explode("spans").alias("s"))
    return found.select("doc_id", F.col("line").cast("long").alias("line"), *(F.col("s." + f).alias(f) for f in ("start", "end", "kind", "normalized", "confidence")))


QUERIES = {
    "statement_footing": (statement_footing, STATEMENT_FOOTING),
    "printed_amounts": (printed_amounts, PRINTED_AMOUNTS),
    "printed_dates": (printed_dates, PRINTED_DATES),
    "page_currency": (page_currency, PAGE_CURRENCY),
    "structure_ties": (structure_ties, STRUCTURE_TIES),
    "cross_footing": (cross_footing, CROSS_FOOTING),
    "span_text": (span_text, None),
}
