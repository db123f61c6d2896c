"""Proving printed totals: runs, sign readings, outcomes, diagnoses, cross-footing, parallel columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions import scalars

MONEY = "decimal(38,2)"
FLOOR = 3
PLAUSIBLE = 0.5


def suffix_reversal(cells: Column, total: Column) -> Column:
    """How many members at the end, never the first, must change sign for the run to make the total; null if none do.

    Reversing a suffix lowers the sum by twice the suffix, so the suffix must be half of sum less total.
    """
    gap = scalars.exact_sum(cells, MONEY) - total
    tail = lambda k: scalars.exact_sum(F.slice(cells, F.size(cells) - k + 1, k), MONEY)
    counts = F.when(F.size(cells) > 1, F.sequence(F.lit(1), F.size(cells) - 1)).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(counts, lambda k: tail(k) * 2 == gap), F.lit(0))


def double_counts(cells: Column) -> Column:
    """Whether a figure from the third on, not zero, is the sum of all before it: a subtotal beside its own members."""
    at = F.when(F.size(cells) >= 3, F.sequence(F.lit(3), F.size(cells))).otherwise(F.array().cast("array<int>"))
    return F.exists(at, lambda i: (F.element_at(cells, i) != 0) & (F.element_at(cells, i) == scalars.exact_sum(F.slice(cells, F.lit(1), i - 1), MONEY)))


def cancels(cells: Column) -> Column:
    """Whether a figure and its opposite stand in one run."""
    return F.exists(cells, lambda x: (x != 0) & F.array_contains(cells, -x))


def diagnosis(cells: Column, delta: Column) -> Column:
    """Why a total misses its run: a member's sign; two digits swapped (a miss of whole units that nine divides); one glyph
    misread (a miss of one digit with zeros after it)."""
    cents = F.abs(delta) * 100
    one_digit = F.regexp_replace(cents.cast("decimal(38,0)").cast("string"), "0+$", "").rlike("^[1-9]$")
    sign = F.exists(cells, lambda x: x * -2 == delta)
    return F.when(delta == 0, F.lit(None).cast("string")).when(sign, "sign").when(cents % 900 == 0, "transposition").when(one_digit, "single-glyph")


def footed(blocks: DataFrame) -> DataFrame:
    """Adds sum, delta, reversed, outcome, reason and diagnosis. ``blocks``: cells (exact figures above the total, in
    order), total (null: none printed)."""
    out = blocks.withColumn("sum", scalars.exact_sum(F.col("cells"), MONEY)).withColumn("delta", (F.col("total") - F.col("sum")).cast(MONEY))
    out = out.withColumn("reversed", F.when(F.col("delta") == 0, 0).otherwise(suffix_reversal(F.col("cells"), F.col("total"))))
    rounding = F.abs("delta") * 200 <= F.size("cells") + 1
    far = F.abs(F.col("delta").cast("double")) > PLAUSIBLE * F.greatest(F.abs(F.col("total").cast("double")), F.abs(F.col("sum").cast("double")))
    reason = (
        F.when(F.col("total").isNull(), "no-total").when(F.size("cells") < FLOOR, "run-too-short").when(F.col("reversed").isNotNull(), F.lit(None).cast("string"))
        .when(rounding, "rounding-indeterminate").when(far, "no-plausible-run")
    )
    out = out.withColumn("reason", reason)
    outcome = F.when(F.col("reason").isNotNull(), "unresolved").when(F.col("reversed").isNotNull(), "confirmed").otherwise("break")
    out = out.withColumn("outcome", outcome)
    return out.withColumn("diagnosis", F.when(F.col("outcome") == "break", diagnosis(F.col("cells"), F.col("delta"))))


def cross_footed(cells: DataFrame) -> DataFrame:
    """Row totals against the columns beside them: may confirm, never breaks. ``cells``: block, row, col, header, value.

    Columns whose header can't be added (rates, averages, percentages) are left out; the total column opens with a
    result word and stands after at least two others.
    """
    kept = cells.where(~scalars.is_non_additive(F.col("header")))
    marked = kept.withColumn("result", scalars.is_total_column(F.col("header")))
    rows = marked.groupBy("block", "row").agg(
        F.max(F.when(F.col("result"), F.col("value"))).alias("total"),
        F.sum(F.when(~F.col("result"), F.col("value")).otherwise(0).cast("decimal(28,2)")).alias("sum"),
        F.count_if(~F.col("result")).alias("n"),
    )
    outcome = F.when(F.col("n") < 2, "unresolved").when(F.col("total") == F.col("sum"), "confirmed").otherwise("unresolved")
    return rows.where("total is not null").select("block", "row", F.col("sum").cast(MONEY).alias("sum"), F.col("total").cast(MONEY).alias("total"), outcome.alias("outcome"))


def proportional(a: Column, b: Column) -> Column:
    """Whether two columns are multiples of each other: no independent witness."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    return F.forall(pairs, lambda p: p["a"] * F.get(b, F.lit(0)) == p["b"] * F.get(a, F.lit(0)))


def best_outcomes(totals: DataFrame) -> DataFrame:
    """One total of each (axis, span): confirmed before break before unresolved, then in order."""
    from parchmint.operators.windows import first_wins

    rank = F.when(F.col("outcome") == "confirmed", 0).when(F.col("outcome") == "break", 1).otherwise(2)
    return first_wins(totals, ["axis", "span"], [rank, F.col("ord")])
