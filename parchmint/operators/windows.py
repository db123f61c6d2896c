"""Window-shaped operators: islands, furniture, page numbers, identities, prefix sums, first-wins ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import scalars, vocab


def islands(rows: DataFrame, partition: list[str], order: list[str], broken: Column, name: str = "island") -> DataFrame:
    """Numbers maximal runs: a run ends where ``broken`` holds (it may use lag over the same order); from 1."""
    w = Window.partitionBy(*partition).orderBy(*order)
    marked = rows.withColumn("_b", F.when(F.row_number().over(w) == 1, 1).otherwise(F.coalesce(broken, F.lit(False)).cast("int")))
    return marked.withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def lagged(column: str, partition: list[str], order: list[str], n: int = 1) -> Column:
    return F.lag(column, n).over(Window.partitionBy(*partition).orderBy(*order))


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def repeating_skeletons(lines: DataFrame) -> DataFrame:
    """(doc, skeleton, pages): digit-masked lines that stand at most once on a page, on enough pages, and whose every
    digit slot is constant or follows the page number. ``lines``: doc, page, text."""
    once = lines.select("doc", "page", scalars.skeleton(F.col("text")).alias("skeleton"), scalars.slots(F.col("text")).alias("slots"))
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("doc_pages"))
    shown = once.groupBy("doc", "skeleton").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"))
    per_slot = once.select("doc", "skeleton", "page", F.posexplode("slots").alias("slot", "value")).groupBy("doc", "skeleton", "slot").agg(
        F.countDistinct("value").alias("values"), F.countDistinct(F.col("value") - F.col("page")).alias("offsets"))
    free = per_slot.groupBy("doc", "skeleton").agg(F.bool_or((F.col("values") > 1) & (F.col("offsets") > 1)).alias("wild"), F.bool_or((F.col("values") > 1) & (F.col("offsets") == 1)).alias("follows"))
    enough = F.col("pages") >= F.greatest(F.lit(vocab.REPEAT_MINIMUM).cast("double"), F.col("doc_pages") * vocab.REPEAT_SHARE)
    return (
        shown.join(pages.hint("merge"), "doc").join(free.hint("merge"), ["doc", "skeleton"], "left")
        .where((F.col("n") == F.col("pages")) & enough & ~F.coalesce(F.col("wild"), F.lit(False)))
        .where(scalars.names_itself(F.col("skeleton")) | F.coalesce(F.col("follows"), F.lit(False)))
        .select("doc", "skeleton", "pages")
    )


def page_numbers(lines: DataFrame) -> DataFrame:
    """(doc, page, value): bare figures with one value-page offset on three or more consecutive pages at one height.
    ``lines``: doc, page, text, top (0 to 1)."""
    bare = lines.where(F.trim("text").rlike("^[0-9]{1,6}$")).select("doc", "page", "top", F.trim("text").cast("int").alias("value"))
    bare = bare.where(~F.col("value").between(*vocab.YEAR_RANGE)).withColumn("shift", F.col("value") - F.col("page"))
    one = first_wins(bare, ["doc", "shift", "page"], [F.col("top").desc()])
    runs = one.withColumn("run", F.col("page") - F.row_number().over(Window.partitionBy("doc", "shift").orderBy("page")))
    of_run = Window.partitionBy("doc", "shift", "run")
    placed = runs.withColumn("median", F.percentile("top", 0.5).over(of_run)).where(F.abs(F.col("top") - F.col("median")) <= vocab.PLACE_TOLERANCE)
    return placed.withColumn("n", F.count("*").over(of_run)).where(F.col("n") >= vocab.SEQUENCE_MINIMUM).select("doc", "page", "value")


def span_ids(spans: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``span_id``: a prefix of the category and 16 hex digits of what the span is and where; equal ones are counted."""
    parts = ["category", "page", "text", "box"]
    nth = F.row_number().over(Window.partitionBy("doc", *parts).orderBy(*order)) - 1
    body = F.concat_ws("|", F.substring("category", 1, 3), F.col("page").cast("string"), scalars.collapsed(F.col("text")), F.col("box"), nth.cast("string"))
    return spans.withColumn("span_id", F.concat(F.substring("category", 1, 3), F.lit("-"), F.substring(F.sha2(body, 256), 1, 16)))


def carried_forward(rows: DataFrame, partition: list[str], order: list[str], column: str, name: str) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(column, ignorenulls=True).over(w))


def contiguous_ties(cells: DataFrame) -> DataFrame:
    """(block, total_row, top_row): every run of two or more rows right above... or anywhere above a row whose exact sum is
    that row's figure. ``cells``: block, row (from 1, gapless), value decimal.

    A run from top to bottom sums to prefix(bottom) - prefix(top - 1), so ties are an equi-join of prefix sums, not a
    search of all triples.
    """
    w = Window.partitionBy("block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.withColumn("upto", F.sum("value").over(w))
    bottom = sums.select("block", F.col("row").alias("bottom"), F.col("upto").alias("upto_bottom"))
    above = sums.select("block", (F.col("row") + 1).alias("top"), F.col("upto").alias("before_top")).union(
        cells.select("block").distinct().select("block", F.lit(1).alias("top"), F.lit(0).cast(dict(sums.dtypes)["upto"]).alias("before_top")))
    totals = sums.select("block", F.col("row").alias("total_row"), F.col("value").alias("total"))
    # bounded: the run ends right above its total
    ends = totals.join(bottom, (totals["block"] == bottom["block"]) & (totals["total_row"] == bottom["bottom"] + 1)).select(totals["block"], "total_row", "bottom", (F.col("upto_bottom") - F.col("total")).alias("before_top"))
    hit = ends.join(above, ["block", "before_top"]).where(F.col("bottom") - F.col("top") >= 1)
    return hit.select("block", "total_row", F.col("top").cast("int").alias("top_row"), F.col("bottom").cast("int").alias("bottom_row"))
