"""Queries on what printed texts become in cells, and cells in print."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import headings, printed
from parchmint.sources.tables import grouped, money, table


def typed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in eight forms a user may link, and one that is none."""
    d, k = F.col("o_orderdate"), F.pmod("o_orderkey", F.lit(9))
    f = lambda p: F.date_format(d, p)
    text = (
        F.when(k == 0, F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), f("yyyy"))).when(k == 1, F.concat(f("yyyy"), F.lit("-Q"), F.quarter(d).cast("string"))).when(k == 2, f("yyyy-M-d"))
        .when(k == 3, f("yyyyMMdd")).when(k == 4, f("M/d/yy")).when(k == 5, f("MMM. d, yyyy")).when(k == 6, f("d MMMM yyyy")).when(k == 7, f("MMMM yyyy")).otherwise(F.concat(f("yyyy"), F.lit("-02-30")))
    )
    x = printed.auto_date(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", x["kind"].alias("kind"), printed.sheet_day(x["value"]).cast("long").alias("day"))


TYPED_DATES = """
SELECT o_orderkey, CASE WHEN s < 2 THEN 'quarter' WHEN s < 7 THEN 'day' WHEN s = 7 THEN 'month' END AS kind,
  date_diff('day', DATE '1899-12-30', CASE WHEN s < 2 THEN date_trunc('quarter', o_orderdate)::DATE WHEN s < 7 THEN o_orderdate::DATE WHEN s = 7 THEN date_trunc('month', o_orderdate)::DATE END) AS day
FROM (SELECT *, o_orderkey % 9 AS s FROM orders)
"""


def typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven texts a line gives a cell: numbers in five forms, a date, and text that a sheet would take for a formula."""
    p, q, k = money("l_extendedprice"), F.col("l_quantity").cast("int").cast("string"), F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(7))
    text = (
        F.when(k == 0, F.concat(F.lit("$ "), grouped(p))).when(k == 1, F.concat(F.lit("("), grouped(p), F.lit(")"))).when(k == 2, F.concat(F.lit("("), q, F.lit(".5%)")))
        .when(k == 3, F.concat(q, F.lit(".25 million"))).when(k == 4, F.concat(F.lit("EUR "), q)).when(k == 5, F.lit("March 1st, 2024")).otherwise(F.concat(F.lit("=  total "), q))
    )
    key = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    t = table(spark, sf_dir, "lineitem").select(*key, text.alias("t")).withColumn("v", printed.auto_value(F.col("t"))).withColumn("n", printed.one_number(F.col("t")))
    return t.select(*key, "v.kind", F.round("v.number", 6).alias("number"), "v.text", F.col("n.places").cast("long").alias("places"), "n.grouped")


TYPED_CELLS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN s < 5 THEN 'number' WHEN s = 5 THEN 'date' ELSE 'text' END AS kind,
  round(CASE s WHEN 0 THEN l_extendedprice WHEN 1 THEN -l_extendedprice WHEN 2 THEN -(q + 0.5) / 100 WHEN 3 THEN (q + 0.25) * 1000000 WHEN 4 THEN q WHEN 5 THEN 45352 END::DOUBLE, 6) AS number,
  CASE WHEN s = 6 THEN '''= total ' || q END AS text, CASE s WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 0 END::BIGINT AS places,
  CASE WHEN s < 2 THEN l_extendedprice >= 1000 WHEN s = 2 THEN false WHEN s = 3 THEN true WHEN s = 4 THEN false END AS grouped
FROM (SELECT *, (l_orderkey + l_linenumber) % 7 AS s, CAST(l_quantity AS INT) AS q FROM lineitem)
"""


def summed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a sentence that are added: grouped ones, bracketed ones, percentages and magnitudes, none twice."""
    q = F.col("l_quantity").cast("int").cast("string")
    text = F.concat(F.lit("sold "), grouped(money("l_extendedprice")), F.lit(" less ("), q, F.lit(") and (1.5%) of "), q, F.lit("k, or 25% - "), q)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"))
    n = printed.with_numbers(rows, "text", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    f = printed.shared_format(F.col("numbers"))
    return n.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size("numbers").cast("long").alias("n"), F.round(printed.number_sum(F.col("numbers")), 4).alias("total"), f["places"].cast("long").alias("places"), f["brackets"].alias("brackets"), f["percent"].alias("percent"))


SUMMED_TEXTS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(6 AS BIGINT) AS n, round(l_extendedprice - q - 0.015 + q * 1000 + 0.25 + q, 4) AS total, CAST(2 AS BIGINT) AS places, true AS brackets, true AS percent
FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem)
"""

_READINGS = {
    "ocr_date": {"03112024": "03/11/2024", "3/1l/2024": "3/1/2024", "o3/11/2024": "3/11/2024", "13/1/2024": None, " 2/9/1899": None, "2/30/2020": None, "12/31/2100.": "12/31/2100"},
    "kind": {"Due Date": "date", "No. of Units": "number", "Tax rate": "percentage", "Total Cost": "currency", "STATUS": "status", "City": "city", "Name": "text"},
    "separators": {"$1.234.56": "$1,234.56", "$12.345.678.90": "$12,345,678.90", "$1.23": "$1.23", "1.234.56": "1.234.56"},
    "clean": {"| Net  income _": "Net income", "a — b": "a - b", "x , y .": "x, y.", "--": ""},
}


def cleaned_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised cells repaired or refused, per nation."""
    rows = [(k, t) for k, cases in _READINGS.items() for t in cases]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.lit(t).alias("reading")) for k, t in rows])).alias("r")
    r = table(spark, sf_dir, "nation").select("n_nationkey", each).select("n_nationkey", "r.what", "r.reading")
    out = F.when(F.col("what") == "ocr_date", printed.ocr_date(F.col("reading"))).when(F.col("what") == "kind", printed.column_kind(F.col("reading"))).when(F.col("what") == "separators", printed.repaired_separators(F.col("reading"))).otherwise(printed.cleaned_reading(F.col("reading")))
    return r.select("n_nationkey", "what", "reading", out.alias("repaired"))


_quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
CLEANED_READINGS = "SELECT n_nationkey, what, reading, repaired FROM nation, (VALUES " + ", ".join(f"('{k}', {_quoted(t)}, {_quoted(v)})" for k, cases in _READINGS.items() for t, v in cases.items()) + ") v(what, reading, repaired)"


def sheet_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances as five sheet formats print them."""
    v = money("c_acctbal").cast("double")
    k = F.pmod("c_custkey", F.lit(5))
    fmt = F.when(k == 0, "#,##0.00").when(k == 1, "$#,##0.00;($#,##0.00)").when(k == 2, "0.0%").when(k == 3, "[$€-407]0.00").otherwise("General")
    t = printed.shown_number(v, fmt)
    return table(spark, sf_dir, "customer").select("c_custkey", t.alias("shown"), printed.looks_numeric(t).alias("numeric"), printed.shown_time(F.make_timestamp(F.lit(2024), F.lit(3), F.lit(5), F.lit(14), (F.col("c_custkey") % 60).cast("int"), F.lit(7)), F.when(k == 0, "h:mm:ss").when(k == 1, "yyyy-mm-dd hh:mm").otherwise("d mmm yy")).alias("time"))


SHEET_NUMBERS = """
SELECT c_custkey, CASE s WHEN 0 THEN format('{:,.2f}', v) WHEN 1 THEN CASE WHEN v < 0 THEN '-$' ELSE '$' END || format('{:,.2f}', abs(v)) WHEN 2 THEN format('{:.1f}', v * 100) || '%'
    WHEN 3 THEN CASE WHEN v < 0 THEN '-€' ELSE '€' END || format('{:.2f}', abs(v)) ELSE regexp_replace(regexp_replace(format('{:.10f}', v), '0+$', ''), '\\.$', '') END AS shown,
  s IN (0, 2, 4) AS numeric, CASE s WHEN 0 THEN '14:' || lpad((c_custkey % 60)::VARCHAR, 2, '0') || ':07' WHEN 1 THEN '2024-03-05 14:' || lpad((c_custkey % 60)::VARCHAR, 2, '0') ELSE '2024-03-05' END AS time
FROM (SELECT *, c_custkey % 5 AS s, CAST(c_acctbal AS DECIMAL(18,2))::DOUBLE AS v FROM customer)
""".replace("\\\\", "\\")

_HEADINGS = {
    "Item 1A. Risk Factors ........": ("item", "1A", "Risk Factors", False), "ITEM 02.02 — Results": ("item", "2.02", "Results", False), "Item 7 (Continued)": ("item", "7", "", True),
    "Item 601 of Regulation S-K": (None, None, None, None), "item 3, and so on": (None, None, None, None), "Item 5 we sold a lot of things to them": (None, None, None, None),
    "PART II — Other Information": ("part", "II", None, None), "Part I, Item 1 of this": (None, None, None, None), "Part iiii": (None, None, None, None),
    "Note 03.02: leases and other obligations of the group": ("note", "3.2", "leases and other obligations of the group", False), "NOTE XIV – Income Taxes": ("note", "XIV", "Income Taxes", False),
    "Note 12 that we were unable to find it": (None, None, None, None), "Note 1000 Leases": (None, None, None, None),
}


def read_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of items, parts and notes, and prose that only looks like them, per nation."""
    t = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, _HEADINGS))).alias("text"))
    i, p, n = headings.item_heading(headings.without_leaders(F.col("text"))), headings.part_heading(F.col("text")), headings.note_heading(F.col("text"))
    t = t.withColumns({"i": i, "p": p, "n": n})
    kind = F.when(F.col("i").isNotNull(), "item").when(F.col("p").isNotNull(), "part").when(F.col("n").isNotNull(), "note")
    return t.select("n_nationkey", "text", kind.alias("kind"), F.coalesce("i.id", "p", "n.id").alias("id"), F.coalesce("i.title", "n.title").alias("title"), F.coalesce("i.continued", "n.continued").alias("continued"))


_value = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else _quoted(v)
READ_HEADINGS = "SELECT n_nationkey, text, kind, id, title, continued FROM nation, (VALUES " + ", ".join(f"({_quoted(t)}, {', '.join(map(_value, v))})" for t, v in _HEADINGS.items()) + ") v(text, kind, id, title, continued)"

QUERIES = {
    "typed_dates": (typed_dates, TYPED_DATES),
    "typed_cells": (typed_cells, TYPED_CELLS),
    "summed_texts": (summed_texts, SUMMED_TEXTS),
    "cleaned_readings": (cleaned_readings, CLEANED_READINGS),
    "sheet_numbers": (sheet_numbers, SHEET_NUMBERS),
    "read_headings": (read_headings, READ_HEADINGS),
}
