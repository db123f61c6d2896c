"""From the glyphs of documents to every figure they print, each with what it is: the engine as one flow.

Glyphs become lines with text; catalogues, lists and page furniture are found in them; dates, percentages and numbers are
read; and every span is a value, a reference, a part of the structure or noise, with its box, currency, scale and id. Each
step is an operator of its own, joined by document, page and line (sort-merge joins: broadcasts would grow with the documents); nothing but a page's rows or a line's spans is held at a
time. Glyphs: doc, page, line, char, x, y, w, h, in shares of the page; spaces have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import spans as reader
from parchmint.functions import vocab
from parchmint.operators import catalog, evidence, lists, reading, windows
from parchmint.operators.grouping import kept

KEYS = ("doc", "page", "line")
#: A gap of so many median widths of a line prints a space.
SPACE = 1.25


def placed_glyphs(glyphs: DataFrame) -> DataFrame:
    """Visible glyphs with ``i``, their place in the text of their line, spaces counted."""
    of_line = Window.partitionBy(*KEYS)
    order = of_line.orderBy("x", "y")
    t = glyphs.where(F.trim("char") != "").withColumn("_wide", F.coalesce(F.percentile(F.when(F.col("w") > 0, F.col("w")), 0.5).over(of_line), F.lit(0.005)))
    space = F.coalesce((F.col("x") - F.lag(F.col("x") + F.col("w")).over(order) > SPACE * F.col("_wide")).cast("int"), F.lit(0))
    t = t.withColumn("_space", space).withColumn("_nth", F.row_number().over(order) - 1)
    return t.withColumn("i", (F.col("_nth") + F.sum("_space").over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("int")).drop("_wide", "_nth")


def text_lines(placed: DataFrame) -> DataFrame:
    """(doc, page, line, text, left, right, top, bottom, char, height): lines of placed glyphs."""
    piece = F.when(F.col("_space") == 1, F.concat(F.lit(" "), F.col("char"))).otherwise(F.col("char"))
    text = placed.groupBy(*KEYS).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", piece.alias("c")))), lambda g: g["c"]), "").alias("text"))
    return text.join(evidence.line_envelopes(placed).hint("merge"), list(KEYS))


def claims(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranges, citations): what the catalogues explain. Ranges (keys, start, end, kind) are headings and contents rows, whose
    figures number the document itself; citations (keys, start, end, kind) are references of their own."""
    contents = catalog.contents_rows(lines)
    items = catalog.item_headings(lines, contents)
    notes = catalog.note_headings(lines)
    where = lines.select(*KEYS, F.length("text").alias("end"))
    told = lambda df, kind: df.select("doc", F.explode("lines").alias("line"), F.lit(kind).alias("kind")).distinct()
    every = told(contents, "item-toc-entry").union(told(items, "item-header")).union(told(notes, "note-header"))
    ranges = every.join(where.hint("merge"), ["doc", "line"]).select(*KEYS, F.lit(0).alias("start"), "end", "kind")
    cited = catalog.item_citations(lines, catalog.item_catalogue(contents, items), contents, items).select(*KEYS, "start", "end", F.lit("item").alias("kind"))
    cited = cited.union(catalog.note_citations(lines, catalog.note_catalogue(notes), notes).select(*KEYS, "start", "end", F.lit("note")))
    return ranges, cited


def furniture(lines: DataFrame) -> DataFrame:
    """(doc, page, line): running heads and feet, and page numbers."""
    edges = evidence.edge_furniture(lines)
    numbers = windows.page_numbers(lines).select("doc", "page", F.col("value").cast("string").alias("_t"))
    bare = lines.withColumn("_t", F.trim("text")).join(numbers.hint("merge"), ["doc", "page", "_t"], "left_semi").select(*KEYS)
    return edges.select(*KEYS).union(bare).distinct()


def detect(glyphs: DataFrame) -> DataFrame:
    """(doc, page, line, start, end, text, kind, normalized, currency, magnitude, date_precision, category, reason, clickable,
    x, y, w, h, span_id) of every span of every document."""
    placed = kept(placed_glyphs(glyphs))
    lines = kept(text_lines(placed))
    ranges, cited = map(kept, claims(lines))
    marks = kept(lists.list_marks(lines))
    shape = [*KEYS, "start", "end"]
    taken = ranges.union(cited)
    marks = lists.fenced(marks.select(*shape, "text", "kind"), taken).where("role is null").drop("role")
    wrapped = kept(evidence.wrapped_dates(lines))
    after = lines.select("doc", "page", F.col("line").alias("next"), F.lag("line").over(Window.partitionBy("doc", "page").orderBy("line")).alias("line"))
    years = wrapped.join(after.hint("merge"), ["doc", "page", "line"]).select("doc", "page", F.col("next").alias("line"), F.col("year_start").alias("start"), (F.col("year_start") + 4).alias("end"), F.lit("wrapped").alias("kind"))
    heads = wrapped.select(*shape, F.lit("wrapped").alias("kind"))

    below = F.lead("text").over(Window.partitionBy("doc", "page").orderBy("line"))
    word = F.lower(F.regexp_extract(below, r"(?i)^\s*(thousands?|millions?|billions?|trillions?)\b", 1))
    scales = F.create_map(*[F.lit(x) for name, value in vocab.MAGNITUDES.items() if len(name) >= 7 for x in (name, value)])
    told = lines.withColumn("_below", F.try_element_at(scales, word)).select(*KEYS, "text", "_below")
    read = reader.with_spans(told, "text", (*KEYS, "text", "_below")).select(*KEYS, F.col("text").alias("of_line"), "_below", F.explode("spans").alias("s"))
    read = read.select(*KEYS, "of_line", "_below", *(F.col("s." + c).alias(c) for c in ("start", "end", "kind", "text", "normalized", "currency", "magnitude", "date_precision")))
    read = lists.fenced(read, heads.union(years)).where("role is null").drop("role")
    day = wrapped.where("normalized is not null").join(lines.select(*KEYS, F.col("text").alias("of_line")).hint("merge"), list(KEYS))
    none = F.lit(None)
    read = read.unionByName(day.select(*shape, "of_line", "text", F.lit("date").alias("kind"), "normalized", F.lit("day").alias("date_precision"), none.cast("long").alias("_below"), none.cast("string").alias("currency"), none.cast("long").alias("magnitude")))
    ends = F.trim(F.substring(F.col("of_line"), F.col("end") + 1, F.length("of_line"))) == ""
    grows = (F.col("kind") == "number") & F.col("magnitude").isNull() & ends & F.col("_below").isNotNull()
    read = read.withColumn("magnitude_below", F.coalesce(grows, F.lit(False)))

    read = evidence.span_boxes(read, placed).where("x is not null")
    read = read.join(evidence.page_type(placed).select("doc", "page", F.col("typical").alias("page_height")).hint("merge"), ["doc", "page"], "left")
    read = read.join(furniture(lines).withColumn("furniture", F.lit(True)).hint("merge"), list(KEYS), "left").withColumn("furniture", F.coalesce("furniture", F.lit(False)))
    read = lists.fenced(read, ranges.union(cited).union(marks.select(*shape, "kind")))
    # what a catalogue or a list explains isn't published as a figure of its own
    plain = reading.classified(read.where("role is null").drop("role").withColumnRenamed("of_line", "line_text").withColumn("line_no", F.col("line")).drop("line").withColumnRenamed("line_text", "line"))
    plain = plain.drop("line").withColumnRenamed("line_no", "line")
    pages = lines.groupBy("doc", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    plain = plain.join(evidence.page_contexts(pages).select("doc", "page", F.col("currency").alias("_page"), "doc_currency").hint("merge"), ["doc", "page"], "left")
    scaled = F.col("normalized").cast("decimal(28,6)") * F.col("_below")
    trimmed = F.regexp_replace(F.regexp_replace(scaled.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = plain.withColumn("normalized", F.when(F.col("magnitude_below"), trimmed).otherwise(F.col("normalized"))).withColumn("magnitude", F.when(F.col("magnitude_below"), F.col("_below")).otherwise(F.col("magnitude")))
    plain = plain.withColumn("currency", F.when(F.col("kind") == "number", F.coalesce("currency", "_page", "doc_currency")).otherwise(F.col("currency")))

    made = [*shape, "text", "kind", "normalized", "currency", "magnitude", "date_precision", "category", "reason", "x", "y", "w", "h"]
    other = marks.select(*shape, "text", F.lit("number").alias("kind"), F.lit("structure").alias("category"), F.col("kind").alias("reason"))
    shown = cited.join(lines.select(*KEYS, "text").hint("merge"), list(KEYS)).select(*shape, F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), F.lit("text").alias("kind"), F.lit("reference").alias("category"), F.col("kind").alias("reason"))
    rest = evidence.span_boxes(other.union(shown), placed)
    out = plain.select(*made).unionByName(rest.select(*[c for c in made if c in rest.columns]), allowMissingColumns=True)
    out = out.withColumn("clickable", reading.clickable(F.col("category"))).withColumn("box", F.concat_ws(",", *(F.format_string("%.4f", F.col(c)) for c in ("x", "y", "w", "h"))))
    return windows.span_ids(out, ["line", "start"]).drop("box")
