"""Queries on collections: linking, search, order, keyed updates, reviews, link values, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import scalars
from parchmint.operators import library, windows
from parchmint.sources import decoders
from parchmint.sources.tables import dealt, grouped, money, table
from parchmint.streaming import spans as stream


def linked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an order list (order number, printed total) linked to the invoice pages that show them: one document per
    customer, a page per four of its orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", money("o_totalprice").alias("p"))
    page = F.row_number().over(windows.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    lines = o.withColumn("page", F.floor((page - 1) / 4)).select(F.col("o_custkey").alias("doc"), "page", "o_orderkey", F.concat(F.lit("Order #"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit("; due $"), grouped(F.col("p"))).alias("line"))
    pages = lines.groupBy("doc", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), " ").alias("text"))
    keys = dealt(o, F.col("o_orderkey")).select(F.col("o_orderkey").alias("row"), F.posexplode(F.array(F.concat(F.lit("order #"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")), F.concat(F.lit("$"), grouped(F.col("p"))))).alias("ord", "key"))
    return library.link_rows(keys, pages).select("row", "doc", "page", "found", "keys")


LINKED_ROWS = """
WITH o AS (SELECT o_orderkey k, o_custkey doc, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS page FROM orders)
SELECT k AS row, doc, CAST(page AS BIGINT) AS page, CAST(2 AS BIGINT) AS found, CAST(2 AS BIGINT) AS keys FROM o
"""


def found_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit of "an" on the lines of all documents, overlapping ones too, ranked exact first."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    hits = library.search_lines(docs, "an")
    return library.exact_first(hits).groupBy("doc").agg(F.count("*").alias("hits"), F.count_if("exact").alias("exact"), F.min("rank").alias("first_rank"))


FOUND_TEXT = r"""
WITH l AS (SELECT doc_id doc, unnest(string_split(text, chr(10))) t FROM documents),
n AS (SELECT doc, trim(regexp_replace(lower(t), '[\t\n\v\f\r ]+', ' ', 'g')) t FROM l),
h AS (SELECT doc, sum((length(t) - length(replace(t, 'an', ''))) // 2)::BIGINT hits,
        sum(len(list_filter(string_split(t, ' '), lambda w: regexp_replace(w, '[\p{P}]+$', '') = 'an')))::BIGINT exact FROM n GROUP BY doc)
SELECT doc, hits, exact, CASE WHEN exact > 0 THEN coalesce(sum(exact) OVER (ORDER BY doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1
  ELSE sum(exact) OVER () + coalesce(sum(hits - exact) OVER (ORDER BY doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 END::BIGINT AS first_rank
FROM h WHERE hits > 0
"""


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names in natural order: numbers by value, originals before copies, case ignored."""
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Report "), k.cast("string"), F.lit(".pdf"))).when(k % 4 == 1, F.concat(F.lit("report "), (k - 1).cast("string"), F.lit(" (2).pdf"))) \
        .when(k % 4 == 2, F.concat(F.lit("Report "), (k - 2).cast("string"), F.lit(" (10).pdf"))).otherwise(F.concat(F.lit("annex"), k.cast("string"), F.lit(".csv")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))
    w = windows.Window.orderBy(scalars.natural_key(F.col("name")), "s_suppkey")  # a file list, shown in one order
    return rows.select("s_suppkey", "name", F.row_number().over(w).cast("long").alias("place"))


NATURAL_ORDER = """
SELECT s_suppkey, CASE k % 4 WHEN 0 THEN 'Report ' || k || '.pdf' WHEN 1 THEN 'report ' || (k - 1) || ' (2).pdf' WHEN 2 THEN 'Report ' || (k - 2) || ' (10).pdf' ELSE 'annex' || k || '.csv' END AS name,
  row_number() OVER (ORDER BY k % 4 <> 3, CASE k % 4 WHEN 1 THEN k - 1 WHEN 2 THEN k - 2 ELSE k END, k % 4)::BIGINT AS place
FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier)
"""


def replaced_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the last of two corrections each for every third, and a new one for each nation."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("folder"))
    fixes = c.where("c_custkey % 3 = 0").select("c_custkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).select("c_custkey", F.concat(F.lit("fix "), F.col("seq").cast("string")).alias("c_name"), F.lit(0).cast("long").alias("folder"), "seq")
    new = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 10_000_000).cast("long").alias("c_custkey"), F.col("n_name").alias("c_name"), F.lit(1).cast("long").alias("folder"), F.lit(1).alias("seq"))
    return library.upserted(c, fixes.unionByName(new), "c_custkey")


REPLACED_RECORDS = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'fix 2' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey END::BIGINT AS folder FROM customer
UNION ALL SELECT n_nationkey + 10000000, n_name, 1 FROM nation
"""


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines less those of deleted orders: rows left by status."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k").select("k", "o_orderstatus")
    left, lines = library.cascaded(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), o.where("k % 5 = 0").select("k"), "k")
    return left.join(lines.groupBy("k").agg(F.count("*").alias("n")), "k", "left").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.sum(F.coalesce("n", F.lit(0))).alias("lines"))


CASCADE_DELETE = """
SELECT o_orderstatus, count(*) AS orders, sum(coalesce(n, 0))::BIGINT AS lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE o_orderkey % 5 <> 0 GROUP BY o_orderstatus
"""


def aligned_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on orders carried to a new scan: signatures of every fourth changed, every fifth order gone, new ones."""
    o = table(spark, sf_dir, "orders")
    now = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "moved").otherwise(F.col("o_orderstatus")).alias("signature"))
    before = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("signature"), F.when(F.col("o_orderkey") % 2 == 0, "accepted").otherwise("rejected").alias("decision"))
    return library.carried_decisions(now, before)


ALIGNED_REVIEWS = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 4 = 0) THEN 'unreviewed' WHEN o_orderkey % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS decision,
  CASE WHEN o_orderkey % 5 = 0 THEN 'archived' WHEN o_orderkey % 7 = 0 THEN 'new' WHEN o_orderkey % 4 = 0 THEN 'reset' ELSE 'kept' END AS state
FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0)
"""


def scored_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("outcome"))
    want, got = o.where("o_orderkey % 6 <> 1"), o.where("o_orderkey % 6 <> 2").withColumn("outcome", F.when(F.col("o_orderkey") % 6 == 3, "X").otherwise(F.col("outcome")))
    return library.scored(want, got, ["o_orderkey"]).groupBy("verdict").agg(F.count("*").alias("n"))


SCORED_TOTALS = """
SELECT CASE o_orderkey % 6 WHEN 1 THEN 'extra' WHEN 2 THEN 'missed' WHEN 3 THEN 'changed' ELSE 'matched' END AS verdict, count(*) AS n FROM orders GROUP BY 1
"""


def note_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of numbered notes: ids with leading zeros, ids that stand in two parts, and ids that don't exist."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    raw = lambda k: F.concat(F.lit("0"), (k % 900).cast("string"), F.lit("."), F.format_string("%02d", F.floor(k / 900).cast("int")))
    notes = p.select(F.col("k").alias("entry"), raw(F.col("k")).alias("raw"), F.lit("I").alias("part")).union(p.where("k % 50 = 0").select((F.col("k") + 5_000_000).alias("entry"), raw(F.col("k")).alias("raw"), F.lit("II").alias("part")))
    cites = p.select(F.col("k").alias("cite"), F.concat((F.col("k") % 900).cast("string"), F.lit("."), F.floor(F.col("k") / 900).cast("string")).alias("raw"), F.when(F.col("k") % 100 == 0, "II").alias("part"))
    return library.resolved_references(cites.union(p.select((F.col("k") + 9_000_000).alias("cite"), F.lit("999.999").alias("raw"), F.lit("I").alias("part"))), notes)


NOTE_REFERENCES = "SELECT p_partkey AS cite, CASE WHEN p_partkey % 100 = 0 THEN p_partkey + 5000000 ELSE p_partkey END AS entry FROM part WHERE p_partkey % 50 <> 0 OR p_partkey % 100 = 0"


def modal_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling of each part size's most frequent type, case ignored."""
    return library.canonical_text(table(spark, sf_dir, "part").select("p_size", "p_type"), "p_size", "p_type").select(F.col("p_size").cast("long").alias("p_size"), "text")


MODAL_SPELLING = """
SELECT CAST(p_size AS BIGINT) AS p_size, p_type AS text FROM (SELECT p_size, p_type, count(*) n FROM part GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY n DESC, length(p_type) DESC, lower(p_type)) = 1
"""


def allocated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free names beside taken ones: of every name a run of copies, with a hole at 2 for even suppliers."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    taken = s.select("k", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).where("NOT (k % 2 = 0 AND i = 2) AND k % 5 <> 0")
    name = F.concat(F.lit("File"), F.col("k").cast("string"), F.when(F.col("i") > 0, F.concat(F.lit(" ("), F.col("i").cast("string"), F.lit(")"))).otherwise(""), F.lit(".PDF"))
    return library.free_names(taken.select(name.alias("name")), s.select(F.concat(F.lit("file"), F.col("k").cast("string"), F.lit(".pdf")).alias("name")))


ALLOCATED_NAMES = "SELECT 'file' || s_suppkey || '.pdf' AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'file' || s_suppkey || '.pdf' ELSE 'file' || s_suppkey || ' (' || CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 5 END || ').pdf' END AS free FROM supplier"


def free_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.lit(1).alias("sheet"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("int").alias("col"))
    return library.first_free(cells, 16).select("row", F.col("col").cast("long").alias("col"))


FREE_CELLS = """
SELECT o.k AS row, min(c)::BIGINT AS col FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) o, range(1, 17) r(c)
WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o.k AND x.l_linenumber = c) GROUP BY o.k
"""


def link_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines gathered into one cell per order, as a formula and its exact value."""
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"), money("l_extendedprice").alias("value"))
    return library.sum_formulas(parts).select("cell", "formula", F.col("total").cast("double").alias("total"))


LINK_SUMS = """
SELECT l_orderkey AS cell, '=' || string_agg(rtrim(rtrim(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '0'), '.'), '+' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS formula,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY 1
"""


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of the web pages: its length, words, and list items."""
    p = table(spark, sf_dir, "pages").select("page_id", decoders.html_text(F.col("html")).alias("t"), F.regexp_count("html", F.lit(r"(?i)<li\b")).cast("long").alias("items"))
    return p.select("page_id", F.length("t").cast("long").alias("chars"), F.size(F.filter(F.split("t", " "), lambda w: w != "")).cast("long").alias("words"), "items", F.md5("t").alias("digest"))


PAGE_TEXT = r"""
WITH a AS (SELECT page_id, html, regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'gis') t FROM pages),
b AS (SELECT page_id, html, regexp_replace(t, '<[^>]*>', ' ', 'gs') t FROM a),
c AS (SELECT page_id, html, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') t FROM b),
d AS (SELECT page_id, html, trim(regexp_replace(t, '[\t\n\v\f\r ]+', ' ', 'g')) t FROM c)
SELECT page_id, length(t)::BIGINT AS chars, len(list_filter(string_split(t, ' '), lambda w: w <> ''))::BIGINT AS words, len(regexp_extract_all(html, '<li\b', 0, 'i'))::BIGINT AS items, md5(t) AS digest FROM d
"""


def routed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the reader their extension goes to."""
    exts = [*sum(decoders.READERS.values(), ()), "exe", "zip"]
    path = F.concat(F.lit("/in/Doc"), F.col("p_partkey").cast("string"), F.lit("."), F.when(F.col("p_partkey") % 2 == 0, F.upper("x")).otherwise(F.col("x")))
    rows = table(spark, sf_dir, "part").withColumn("x", F.element_at(F.array(*map(F.lit, exts)), (F.col("p_partkey") % len(exts) + 1).cast("int")))
    return rows.select(decoders.reader_of(path).alias("reader")).groupBy("reader").agg(F.count("*").alias("n"))


def _routed_sql() -> str:
    exts = [*sum(decoders.READERS.values(), ()), "exe", "zip"]
    cases = " ".join(f"WHEN i IN ({', '.join(str(exts.index(e)) for e in v)}) THEN '{k}'" for k, v in decoders.READERS.items())
    return f"SELECT CASE {cases} END AS reader, count(*) AS n FROM (SELECT p_partkey % {len(exts)} AS i FROM part) GROUP BY 1"


def revision_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two review commits per order against its last revision: the first that names it wins, the other is stale."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"))
    revisions = o.where("doc % 2 = 0").select("doc", F.explode(F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))).alias("revision"))
    asked = o.select("doc", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("seq")).withColumn("expected", F.when(F.col("doc") % 3 == 0, 2).when(F.col("doc") % 2 == 0, 3).otherwise(0).cast("long"))
    return library.committed(revisions, asked)


REVISION_COMMITS = """
SELECT doc, seq, CASE WHEN ok THEN latest + 1 END AS revision, CASE WHEN ok THEN 'committed' ELSE 'stale' END AS state FROM (
  SELECT o_orderkey AS doc, s::BIGINT AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END::BIGINT AS latest,
    s = 1 AND CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END = CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END AS ok FROM orders, range(1, 3) r(s))
"""


def format_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.lit(1).alias("sheet"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("int").alias("col"), F.col("l_returnflag").alias("format")).distinct()
    return library.format_blocks(cells).select("row", "format", F.col("from").cast("long").alias("first"), F.col("to").cast("long").alias("last"))


FORMAT_RUNS = """
WITH c AS (SELECT DISTINCT l_orderkey AS row, l_returnflag AS format, l_linenumber::BIGINT AS col FROM lineitem),
r AS (SELECT *, col - row_number() OVER (PARTITION BY row, format ORDER BY col) AS run FROM c)
SELECT row, format, min(col) AS first, max(col) AS last FROM r GROUP BY row, format, run
"""


def streamed_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the lines of a stream of documents, counted by source and kind: the same reader as in batch."""
    return stream.figures_by_source(spark, sf_dir)


QUERIES = {
    "linked_rows": (linked_rows, LINKED_ROWS),
    "found_text": (found_text, FOUND_TEXT),
    "natural_order": (natural_order, NATURAL_ORDER),
    "replaced_records": (replaced_records, REPLACED_RECORDS),
    "cascade_delete": (cascade_delete, CASCADE_DELETE),
    "aligned_reviews": (aligned_reviews, ALIGNED_REVIEWS),
    "scored_totals": (scored_totals, SCORED_TOTALS),
    "note_references": (note_references, NOTE_REFERENCES),
    "modal_spelling": (modal_spelling, MODAL_SPELLING),
    "allocated_names": (allocated_names, ALLOCATED_NAMES),
    "free_cells": (free_cells, FREE_CELLS),
    "link_sums": (link_sums, LINK_SUMS),
    "page_text": (page_text, PAGE_TEXT),
    "routed_files": (routed_files, _routed_sql()),
    "revision_commits": (revision_commits, REVISION_COMMITS),
    "format_runs": (format_runs, FORMAT_RUNS),
    "streamed_figures": (streamed_figures, None),
}
