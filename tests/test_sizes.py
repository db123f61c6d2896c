"""What keeps plans and tasks small on large inputs."""

from pyspark.sql import functions as F

from parchmint.functions import headings, labels, printed
from parchmint.operators import footing, grouping
from parchmint.plans import proofs, structure, tables, values
from parchmint.sources.tables import dealt

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_columns_compute_shared_values_once(spark):
    text = spark.range(1).select(F.col("id").cast("string").alias("t"))
    assert _plan(text.select(printed.auto_value(F.col("t")).alias("v"))).count("regexp_replace(trim(") <= 2
    assert _plan(text.select(labels.is_net_component(F.col("t")).alias("v"))).count("regexp_replace(lower(") == 1
    assert _plan(text.select(headings.item_heading(F.col("t")).alias("v"))).count("regexp_extract(t") <= 2


def test_item_citations_plan_starts_from_kept_rows(spark):
    assert "InArrow" not in _plan(structure.item_catalogue(spark, SMALL))
    assert _plan(structure.item_citations(spark, SMALL)).count("InArrow") == 1  # the citations themselves


def test_tables_are_detected_once(spark):
    assert "InArrow" not in _plan(tables.table_periods(spark, SMALL))


def test_small_files_are_dealt_to_many_tasks(spark):
    lines = structure._printed(spark.range(8).coalesce(1), F.col("id"), [(0, "Item 1. Business", 0.1, 0.1)])
    assert lines.rdd.getNumPartitions() == dealt(spark.range(8), F.col("id")).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_groups_are_whole_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.range(50).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("k"), F.col("id").alias("v"), F.col("id").cast("decimal(28,6)").alias("d"), F.array("id").alias("a"))
        folded = grouping.fold_groups(rows, ["k"], lambda g: [{"k": g[0]["k"], "n": len(g), "s": int(sum(r["d"] for r in g)), "a": sum(r["a"][0] for r in g)}], "k long, n int, s long, a long")
        want = {(k or None, len(v), sum(v), sum(v)) for k, v in ((k, [i for i in range(50) if i % 7 == k]) for k in range(7))}
        assert {tuple(r) for r in folded.collect()} == want
        assert grouping.fold_groups(rows.where("v < 0"), ["k"], lambda g: g, "k long, v long").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_of_a_union_are_whole_where_its_sides_are_coalesced_apart(spark):
    small = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "24k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "12"}
    was = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        k = F.col("id").alias("k")
        rows = spark.range(4000).groupBy(k).agg(F.repeat(F.max(F.col("id").cast("string")), 20).alias("t"))
        rows = rows.select("k", F.length("t").alias("v")).union(spark.range(4000).groupBy(k).agg(F.max(F.lit(1)).alias("v")))
        folded = grouping.fold_groups(rows, ["k"], lambda g: [{"k": g[0]["k"], "n": len(g)}], "k long, n int")
        assert {tuple(r) for r in folded.collect()} == {(i, 2) for i in range(4000)}
        found = tables.planted_tables(spark, SMALL)
        lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
        assert found.where("col = 0").count() == lines.count() == found.where("col = 1 and not header").count()
        assert found.where("header").count() == 2 * lines.select("l_orderkey").distinct().count()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_ties_of_runs_are_sought_once_a_row(monkeypatch):
    from decimal import Decimal

    asked = []
    monkeypatch.setattr(footing.Column_, "value", lambda self, row, f=footing.Column_.value: asked.append(row) or f(self, row))
    plain = {"block": 1, "label": "x", "dash": False, "decimals": 0, "text": "x", "signals": [], "closes_assets": False, "closes_claims": False, "name": "x", "result_column": False, "rate_column": False}
    cells = [plain | {"row": r, "col": c, "value": Decimal(3 ** (r + 1) + c)} for r in range(40) for c in (1, 2)]
    cells[-2]["value"], cells[-1]["value"] = (sum((c["value"] for c in cells[-8 + k : -2 : 2]), Decimal(0)) for k in (0, 1))
    found = footing.foot_block(cells)
    assert [(r["row"], r["col"], r["outcome"], r["members"]) for r in found] == [(39, 1, "confirmed", [36, 37, 38]), (39, 2, "confirmed", [36, 37, 38])]
    assert len(asked) < 1000  # every run of every row by itself asks some 20,000 times


def test_totals_are_found_once(spark):
    assert "InArrow" not in _plan(proofs.admitted_totals(spark, SMALL))


def _run_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_catalogues_broadcast_nothing_that_grows(spark):
    for query in (structure.document_kinds, structure.item_catalogue, structure.item_citations):
        assert "Broadcast" not in _run_plan(query(spark, SMALL))


def test_figures_and_totals_broadcast_nothing_that_grows(spark):
    for query in (values.document_figures, proofs.admitted_totals, values.proved_pages):
        assert "Broadcast" not in _run_plan(query(spark, SMALL))
