"""Queries on links and reviews, built from orders, lines and customers as sheets and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.operators import links
from parchmint.sources.tables import money, table


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link per order: its customer is the sheet, its key the row, its total the text."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("auto", "raw", "sum"))), (k % 3 + 1).cast("int"))
    text = F.when(k % 3 == 1, F.concat(F.lit("=note "), k.cast("string"))).otherwise(F.concat(F.lit("("), money("o_totalprice").cast("string"), F.lit(")")))
    box = [F.lit(v).alias(n) for n, v in (("x", 0.1), ("y", 0.2), ("w", 0.3), ("h", 0.01))]
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("sheet"), (k % 100).alias("row"), (k % 7).alias("col"), F.lit(1).alias("doc"), F.lit(1).alias("page"), *box, kind.alias("kind"), text.alias("text"), k.alias("seq"), F.lit(0).alias("track"))


def written_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = links.written(_links(spark, sf_dir))
    return w.select("id", F.col("value.kind").alias("kind"), F.round("value.number", 4).alias("number"), F.col("value.text").alias("text"))


WRITTEN_CELLS = """
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'text' ELSE 'sum' END AS kind, CASE WHEN o_orderkey % 3 <> 1 THEN round(-CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE, 4) END AS number,
  CASE WHEN o_orderkey % 3 = 1 THEN '''=note ' || o_orderkey END AS text FROM orders
"""


def link_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links are left after each edit: a selection deleted, the last of each sheet undone, broken names pruned,
    a contribution dropped; and how many names to make and drop."""
    t = _links(spark, sf_dir)
    ranges = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sheet"), F.explode(F.array(F.struct(F.lit(0).alias("row0"), F.lit(9).alias("row1"), F.lit(0).alias("col0"), F.lit(3).alias("col1")), F.struct(F.lit(50).alias("row0"), F.lit(50).alias("row1"), F.lit(0).alias("col0"), F.lit(6).alias("col1")))).alias("r")).select("sheet", "r.*")
    left, gone = links.deleted(t, ranges)
    kept, last = links.undone(t)
    positions = t.select("id", "sheet", (F.col("row") + 1).alias("row"), "col", (F.col("id") % 10 == 3).alias("broken")).where("id % 2 = 1")
    synced = links.synced(t, positions)
    names = t.where("id % 4 = 0").select("id").union(t.select((-F.col("id") - 1).alias("id")).where("id % 5 = 0"))
    n = lambda df, what: df.agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("ids")).select(F.lit(what).alias("what"), "n", "ids")
    bound = links.bindings(t, names)
    moved = synced.join(t.select("id", F.col("row").alias("was")), "id").where("row <> was")
    return n(left, "left").union(n(gone, "deleted")).union(n(kept, "kept")).union(n(last, "undone")).union(n(synced, "synced")).union(n(moved, "moved")).union(n(bound.where("action = 'create'"), "create")).union(n(bound.where("action = 'delete'"), "delete"))


LINK_EDITS = """
WITH t AS (SELECT o_orderkey AS id, o_custkey AS sheet, o_orderkey % 100 AS row, o_orderkey % 7 AS col FROM orders),
s AS (SELECT *, (row <= 9 AND col <= 3) OR row = 50 AS hit, row_number() OVER (PARTITION BY sheet ORDER BY id DESC) AS back, id % 2 = 1 AND id % 10 = 3 AS broken FROM t WHERE sheet IN (SELECT c_custkey FROM customer) OR true)
SELECT 'left' AS what, count(*) AS n, sum(id)::BIGINT AS ids FROM s WHERE NOT hit UNION ALL SELECT 'deleted', count(*), sum(id)::BIGINT FROM s WHERE hit
UNION ALL SELECT 'kept', count(*), sum(id)::BIGINT FROM s WHERE back > 1 UNION ALL SELECT 'undone', count(*), sum(id)::BIGINT FROM s WHERE back = 1
UNION ALL SELECT 'synced', count(*), sum(id)::BIGINT FROM s WHERE NOT broken UNION ALL SELECT 'moved', count(*), sum(id)::BIGINT FROM s WHERE NOT broken AND id % 2 = 1
UNION ALL SELECT 'create', count(*), sum(id)::BIGINT FROM s WHERE id % 4 <> 0 UNION ALL SELECT 'delete', count(*), sum(-id - 1)::BIGINT FROM s WHERE (-id - 1) % 5 = 0
"""


def cell_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that sum the lines of an order in order of their numbers, the second one dropped again."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_quantity").cast("int")).alias("q"))
    rows = t.select(F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("id"), F.lit(1).alias("sheet"), F.col("l_orderkey").alias("row"), F.lit(1).alias("col"), F.lit("sum").alias("kind"), F.concat(F.lit("of ("), F.col("q").cast("string"), F.lit(") and 1.5k")).alias("text"), F.col("l_linenumber").alias("track"))
    left = links.without_contribution(rows, rows.where("track = 2").select("id"))
    return links.sum_cells(left).select("row", "formula", F.round("total", 4).alias("total"), "terms")


CELL_SUMS = """
WITH t AS (SELECT l_orderkey AS row, l_linenumber AS i, max(CAST(l_quantity AS INT)) AS q FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1, 2)
SELECT row, '=' || string_agg('-' || q || '+1500', '+' ORDER BY i) AS formula, round(sum(1500 - q), 4)::DOUBLE AS total, (2 * count(*))::BIGINT AS terms FROM t GROUP BY row
"""


def covered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled cells that a grown table newly covers, per customer's sheet of orders."""
    t = _links(spark, sf_dir).select("sheet", "row", "col", "text")
    ranges = lambda r, c: table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sheet"), F.lit(0).alias("row0"), F.lit(r).alias("row1"), F.lit(0).alias("col0"), F.lit(c).alias("col1"))
    return links.covered_conflicts(t, ranges(20, 3), ranges(60, 5))


COVERED_CELLS = "SELECT o_custkey AS sheet, count(*) AS conflicts FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 100 <= 60 AND o_orderkey % 7 <= 5 AND NOT (o_orderkey % 100 <= 20 AND o_orderkey % 7 <= 3) GROUP BY 1"


def reviewed_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of orders against the sum of their lines with signs: exact, different, or not to be evaluated."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when((F.col("l_orderkey") % 7 == 0) & (F.col("l_linenumber") == 1), None).otherwise(money("l_extendedprice")).cast("decimal(18,2)").alias("value"), F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1).alias("sign"))).alias("ops"))
    target = F.aggregate("ops", F.lit(0).cast("decimal(38,10)"), lambda a, o: (a + o["value"] * o["sign"]).cast("decimal(38,10)")) + F.when(F.col("l_orderkey") % 5 == 0, 3).otherwise(0)
    e = li.withColumn("t", F.when(F.col("l_orderkey") % 7 == 0, F.lit(1)).otherwise(target).cast("decimal(38,10)")).withColumn("e", links.signed_equation(F.col("t"), F.col("ops")))
    return e.select("l_orderkey", F.col("e.state").alias("state"), F.col("e.difference").cast("double").alias("difference"))


REVIEWED_EQUATIONS = """
WITH o AS (SELECT l_orderkey, count(*) FILTER (l_linenumber = 1) AS ones FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN l_orderkey % 7 = 0 AND ones > 0 THEN 'not-evaluable' WHEN l_orderkey % 7 = 0 THEN 'difference' WHEN l_orderkey % 5 = 0 THEN 'difference' ELSE 'exact-match' END AS state,
  CASE WHEN l_orderkey % 7 = 0 AND ones > 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN 1 - (SELECT sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) FROM lineitem l WHERE l.l_orderkey = o.l_orderkey)::DOUBLE WHEN l_orderkey % 5 = 0 THEN 3 ELSE 0 END::DOUBLE AS difference FROM o
"""


def draft_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equation drafts per nation that can't stand, by their fault."""
    n = F.col("n_nationkey")
    cell = lambda s: F.concat(n.cast("string"), F.lit(s))
    arr = lambda *s: F.array(*map(cell, s))
    draft = lambda i, target, ops: F.struct((n * 10 + i).alias("id"), cell(target).alias("target"), ops.alias("operands"))
    d = table(spark, sf_dir, "nation").select(F.explode(F.array(draft(1, "a", arr("b", "c")), draft(2, "b", arr("d", "e")), draft(3, "e", arr("f", "g")), draft(4, "x", arr("b", "d")), draft(5, "p", arr("q")), draft(6, "r", arr("s", "s")), draft(7, "g", arr("h", "b")), draft(8, "k", arr("l", "zz")))).alias("d")).select("d.*")
    anchors = table(spark, sf_dir, "nation").select(F.explode(arr(*"abcdefghklpqrsx")).alias("cell"))
    return links.faulty_equations(spark, d, anchors)


DRAFT_FAULTS = "SELECT n_nationkey * 10 + i AS id, fault FROM nation, (VALUES (2, 'cycle'), (3, 'cycle'), (7, 'cycle'), (4, 'subtotal-and-part'), (5, 'too-few-operands'), (6, 'duplicate-operand'), (8, 'unknown-cell'), (2, 'subtotal-and-part'), (3, 'subtotal-and-part'), (7, 'subtotal-and-part')) v(i, fault)"


def review_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace per supplier after four batches: one with an unknown decision changes nothing, one restores the first."""
    ops = [(1, 1, "equation", "e1", None), (1, 2, "decision", "e1", "accepted"), (1, 3, "value", "c1", "1.50"), (2, 1, "correction", "c1", "2"), (2, 2, "decision", "e9", "accepted"), (3, 1, "issue", "i1", None), (3, 2, "page", "7", None), (3, 3, "decision", "e1", "rejected"), (4, 1, "restore", "", "1"), (5, 1, "correction", "c2", "-3.00")]
    s = F.col("s_suppkey")
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("batch"), F.lit(q).alias("seq"), F.lit(o).alias("op"), F.lit(k).alias("key"), F.lit(v).cast("string").alias("value")) for b, q, o, k, v in ops])).alias("o")
    t = table(spark, sf_dir, "supplier").select(s.alias("doc"), each).select("doc", "o.*").where((F.col("doc") % 2 == 0) | (F.col("batch") < 4))
    return links.review_workspaces(t).select("doc", "what", "key", "value", F.col("revision").cast("long").alias("revision"))


REVIEW_WORKSPACES = """
SELECT s_suppkey AS doc, what, key, value, r::BIGINT AS revision FROM supplier JOIN (VALUES (0, 'equation', 'e1', 'accepted', 4), (0, 'value', 'c1', '1.5', 4), (0, 'value', 'c2', '-3', 4), (1, 'equation', 'e1', 'rejected', 2), (1, 'value', 'c1', '1.5', 2), (1, 'issue', 'i1', NULL, 2), (1, 'page', '7', NULL, 2)) v(odd, what, key, value, r) ON s_suppkey % 2 = odd
"""


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each customer's stored result still holds: by version and by what it was made of."""
    k = F.col("c_custkey")
    docs = table(spark, sf_dir, "customer").select(k.alias("doc"), links.fingerprint(F.struct("c_name", "c_mktsegment")).alias("fingerprint"))
    res = docs.where("doc % 4 <> 0").select("doc", F.when(F.col("doc") % 4 == 1, "v1").otherwise("v2").alias("version"), F.when(F.col("doc") % 4 == 2, "old").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return links.staleness(res, docs, "v2")


STORED_RESULTS = "SELECT c_custkey AS doc, CASE c_custkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'other-version' WHEN 2 THEN 'other-geometry' ELSE 'current' END AS state FROM customer"

QUERIES = {
    "written_cells": (written_cells, WRITTEN_CELLS),
    "link_edits": (link_edits, LINK_EDITS),
    "cell_sums": (cell_sums, CELL_SUMS),
    "covered_cells": (covered_cells, COVERED_CELLS),
    "reviewed_equations": (reviewed_equations, REVIEWED_EQUATIONS),
    "draft_faults": (draft_faults, DRAFT_FAULTS),
    "review_workspaces": (review_workspaces, REVIEW_WORKSPACES),
    "stored_results": (stored_results, STORED_RESULTS),
}
