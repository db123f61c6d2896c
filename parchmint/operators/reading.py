"""What a printed span is: a value, a reference, a part of the structure, or noise; and what lines and cells say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import scalars, vocab
from parchmint.operators.windows import islands

def _cue(words: str, reach: int) -> str:
    """One of the words, and nothing but the rest of its sentence up to the figure."""
    return rf"(?i)\b(?:{words})\b[^.]{{0,{reach}}}$"


#: A phone number shows a country code, or an area code in brackets.
_PHONE = r"\+[0-9]{1,3}[\s.-][0-9][0-9\s.-]{5,}[0-9]|\([0-9]{3}\)\s?[0-9]{3}[\s.-][0-9]{4}"


def match_places(text: Column, pattern: str) -> Column:
    """(start, end) of every match, from 0, end exclusive."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.transform(found, lambda m, i: F.struct(
        (F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda a, g: a + F.length(g))).alias("start"),
        (F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice(found, F.lit(1), i + 1), F.lit(0), lambda a, g: a + F.length(g))).alias("end"),
    ))


def overlaps_any(start: Column, end: Column, places: Column) -> Column:
    """Whether [start, end) shares a place with one of the ranges."""
    return F.exists(places, lambda p: (start < p["end"]) & (end > p["start"]))


def reference_kind(line: Column, start: Column, end: Column) -> Column:
    """What a token that is no value identifies: a phone number around it, what the nearest kind of cue before it says, or
    just an identifier."""
    before, kind = F.substring(line, F.lit(1), start), F.lit("identifier")
    for name, words in reversed(vocab.REFERENCE_CUES.items()):
        kind = F.when(before.rlike(_cue(words, vocab.REFERENCE_REACH)), name).otherwise(kind)
    return F.when(overlaps_any(start, end, match_places(line, _PHONE)), "phone").otherwise(kind)


def classified(spans: DataFrame) -> DataFrame:
    """Adds category and reason to spans by the first rule that holds: page furniture, a phone number, a cue before it,
    raised type, a year cited, a bare figure in prose; else a value.

    ``spans``: line (text), start, end (code points), kind, text, date_precision, furniture (boolean), height and page_height
    (null: unknown), isolated (boolean); and where known currency, magnitude, magnitude_below (the next line opens with
    one), each of which speaks for a figure.
    """
    line, start, end = F.col("line"), F.col("start"), F.col("end")
    before = F.substring(line, F.lit(1), start)
    cue = F.lit(None).cast("string")
    for kind, words in reversed(vocab.REFERENCE_CUES.items()):
        cue = F.when(before.rlike(_cue(words, vocab.REFERENCE_REACH)), kind).otherwise(cue)
    cue = F.when(cue.isNull() & before.rlike(rf"(?i)(?:\b(?:{vocab.NUMBER_MARK}))\s*$|[#№]\s*$"), "identifier").otherwise(cue)
    raised = F.col("height") < vocab.SUPERSCRIPT_RATIO * F.col("page_height")
    year = (F.col("date_precision") == "year") & before.rlike(_cue(vocab.CITATION_CUES, vocab.CITATION_REACH))
    words = F.size(F.regexp_extract_all(line, F.lit(r"\p{L}{2,}"), F.lit(0)))
    marked = F.col("text").rlike(r"[,%]|\.[0-9]")
    for name, says in (("currency", lambda c: c.isNotNull()), ("magnitude", lambda c: c.isNotNull()), ("magnitude_below", lambda c: F.coalesce(c, F.lit(False)))):
        if name in spans.columns:
            marked = marked | says(F.col(name))
    bare = (F.col("kind") == "number") & ~marked & ~F.col("isolated") & (words >= vocab.PROSE_WORDS) & ~before.rlike(_cue(vocab.PERIOD_CUES, vocab.PERIOD_REACH))
    reason = (
        F.when(F.col("furniture"), "page-furniture").when(overlaps_any(start, end, match_places(line, _PHONE)), "phone").when(cue.isNotNull(), cue)
        .when(F.coalesce(raised, F.lit(False)), "superscript").when(F.coalesce(year, F.lit(False)), "citation-year").when(bare, "unsupported")
    )
    category = F.when(reason.isNull(), "value").when(reason.isin("page-furniture", "superscript", "citation-year", "unsupported"), "noise").otherwise("reference")
    return spans.withColumn("reason", reason).withColumn("category", category)


def clickable(category: Column) -> Column:
    return category.isin("value", "reference")


def ordinal_chains(lines: DataFrame, reach: float = 0.05) -> DataFrame:
    """(doc, line, ordinal, chain): list markers in chains of three or more that count on in one column.

    ``lines``: doc, page, line, text, left. Brackets around the ordinal make a footnote marker.
    """
    mark = F.regexp_extract("text", r"^\s*(\(?[0-9]{1,3}[.)])\s+\S", 1)
    m = lines.withColumn("mark", mark).where("mark <> ''").withColumn("ordinal", F.regexp_extract("mark", "[0-9]+", 0).cast("int"))
    m = m.withColumn("kind", F.when(F.col("mark").startswith("("), "footnote-marker").otherwise("list-marker"))
    w = Window.partitionBy("doc", "kind").orderBy("page", "line")
    off = (F.col("ordinal") != F.lag("ordinal").over(w) + 1) | (F.abs(F.col("left") - F.lag("left").over(w)) > F.lit(max(vocab.COLUMN_TOLERANCE, reach))) | (F.col("page") - F.lag("page").over(w) > 1)
    runs = islands(m, ["doc", "kind"], ["page", "line"], off, "chain")
    n = F.count("*").over(Window.partitionBy("doc", "kind", "chain"))
    return runs.withColumn("n", n).where(F.col("n") >= vocab.LIST_CHAIN).select("doc", "line", "kind", "ordinal", "chain")


def with_wrapped_magnitude(lines: DataFrame) -> DataFrame:
    """Adds ``magnitude``: the magnitude word that opens the next line where this one ends in a figure.
    ``lines``: doc, page, line, text."""
    w = Window.partitionBy("doc", "page").orderBy("line")
    word = F.lower(F.regexp_extract(F.lead("text").over(w), r"(?i)^\s*(thousands?|millions?|billions?|trillions?)\b", 1))
    scale = F.lit(None).cast("long")
    for name, value in vocab.MAGNITUDES.items():
        if len(name) >= 7:
            scale = F.when(word == name, F.lit(value).cast("long")).otherwise(scale)
    return lines.withColumn("magnitude", F.when(F.col("text").rlike(r"[0-9][.,]?[0-9]*\)?\s*$"), scale))


def note_headings(lines: DataFrame) -> DataFrame:
    """(doc, line, id, title, continued): headings "Note 3 — Title" whose title reads like one; a title that ends on the
    line goes on with the next where that one is title-like and no heading. ``lines``: doc, line, text."""
    pattern = r"^\s*(?i:note)\s+(0*[0-9]{1,3}(?:\.[0-9]+)?)\s*[.:–—-]?\s*(.*)$"
    w = Window.partitionBy("doc").orderBy("line")
    t = lines.withColumn("raw", F.regexp_extract("text", pattern, 1)).withColumn("rest", F.regexp_extract("text", pattern, 2))
    t = t.withColumn("follow", F.lead("text").over(w)).withColumn("follow_raw", F.lead("raw").over(w))
    continued = F.col("rest").rlike(r"(?i)\(?continued\)?\s*$")
    title = F.regexp_replace(F.col("rest"), r"(?i)\s*[-–—]?\s*\(?continued\)?\s*$", "")
    wraps = title.rlike(r"(?i)(?:\b(?:and|of|the|for|in|to|on)|,)\s*$") & (F.col("follow_raw") == "") & scalars.looks_like_title(F.col("follow"))
    whole = scalars.collapsed(F.when(wraps, F.concat_ws(" ", title, F.col("follow"))).otherwise(title))
    out = t.where("raw <> ''").select("doc", "line", scalars.decimal_identifier(F.col("raw")).alias("id"), whole.alias("title"), continued.alias("continued"))
    return out.where(scalars.looks_like_title(F.col("title")))


def note_citations(lines: DataFrame) -> DataFrame:
    """(doc, line, raw): numbers cited as "see Note 3", lists like "Notes 3 and 4.1" too. ``lines``: doc, line, text."""
    lists = F.regexp_extract_all("text", F.lit(r"(?i)\b(?:see|in|under|to)\s+notes?\s+([0-9.]*[0-9](?:\s*(?:,|and|&|or)\s*[0-9.]*[0-9])*)"), F.lit(1))
    each = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r"[0-9]+(?:\.[0-9]+)*"), F.lit(0))))
    return lines.select("doc", "line", F.explode(each).alias("raw"))


def whole_number(c: Column) -> Column:
    """A cell that is one printed number: (value decimal text as double, is percent, is currency, in brackets, places).

    Percentages are divided by 100, magnitudes multiply, brackets are negative, a bare minus is read; null: no number.
    """
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "−", "-"))
    pattern = r"(?i)^(\(?)\s*([$€£¥₹₩]?)\s*(\(?)\s*(-?)\s*((?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?|\.[0-9]+)\s*(thousand|million|billion|trillion|k|m|mm|bn|b|t)?\s*(\)?)\s*(%?)$"
    g = [F.regexp_extract(t, pattern, i) for i in range(1, 9)]
    digits = F.regexp_replace(g[4], ",", "")
    scale = F.lit(1.0)
    for name in ("thousand", "million", "billion", "trillion", "k", "m", "mm", "bn", "b", "t"):
        scale = F.when(F.lower(g[5]) == name, float(vocab.MAGNITUDES[name])).otherwise(scale)
    opened, closed = (g[0] != "") | (g[2] != ""), g[6] != ""
    sign = F.when(opened | (g[3] != ""), -1.0).otherwise(1.0)
    value = digits.cast("double") * scale * sign / F.when(g[7] != "", 100.0).otherwise(1.0)
    places = F.length(F.regexp_extract(digits, r"\.([0-9]+)$", 1))
    found = F.struct(value.alias("value"), (g[7] != "").alias("percent"), (g[1] != "").alias("currency"), opened.alias("brackets"), places.alias("places"))
    return F.when(t.rlike(pattern) & (opened == closed), found)


def review_queue(equations: DataFrame, statuses: list[str] | None = None, axis: str | None = None) -> DataFrame:
    """Equations open to review in reading order: rejected ones out unless asked for. ``equations``: id, status, axis, page, y, x."""
    rows = equations.where(F.col("status").isin(*statuses)) if statuses else equations.where("status <> 'rejected'")
    if axis:
        rows = rows.where(F.col("axis") == axis)
    w = Window.partitionBy("page").orderBy("y", "x", "axis", "id")
    return rows.withColumn("place", F.row_number().over(w))


def visible_files(files: DataFrame, folder: str | None, query: str) -> DataFrame:
    """Files of a folder (null: all) whose name holds the query, case ignored."""
    here = F.lit(True) if folder is None else F.col("folder").eqNullSafe(F.lit(folder))
    return files.where(here & F.lower("name").contains(query.lower()))


def segments(words: DataFrame, page_gap: float = 0.012, gap: float = 2.5) -> DataFrame:
    """(page, line, segment, x0, x1, text): words of a line joined while the gap between them is small: the pieces that
    become table cells. ``words``: page, line, x0, x1, char (mean width of a character), text."""
    w = ["page", "line"]
    far = F.col("x0") - F.lag("x1").over(Window.partitionBy(*w).orderBy("x0")) >= F.greatest(F.lit(page_gap), gap * F.col("char"))
    s = islands(words, w, ["x0"], far, "segment")
    g = s.groupBy(*w, "segment").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sort_array(F.collect_list(F.struct("x0", "text"))).alias("p"))
    return g.select(*w, "segment", "x0", "x1", F.array_join(F.transform("p", lambda r: r["text"]), " ").alias("text"))


def word_class(c: Column) -> Column:
    """bullet, currency, period, date, percent, numeric, ordinal, marker, symbol or word, by the first that fits."""
    rules = (
        ("bullet", r"^[•·▪◦*]$"), ("currency", r"^(?:[$€£¥₹₩]|(?:USD|EUR|GBP|JPY|CAD|AUD|CHF|CNY|INR|KRW))$"), ("period", r"^(?:(?:19|20)[0-9]{2}|[Qq][1-4])$"),
        ("date", r"^[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}$"), ("percent", r"^[(]?-?[0-9.,]+[)]?%$"), ("numeric", r"^[$€£¥₹₩]?[(]?-?[$€£¥₹₩]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?[)]?$"),
        ("ordinal", r"^[(]?(?:[0-9]{1,3}|[a-z]|[ivx]+)[.)]$"), ("marker", r"^[(]?[*†‡§]+[)]?$"), ("symbol", r"^[^A-Za-z0-9]+$"),
    )
    out = F.lit("word")
    for name, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


#: What kinds of references and reasons of refusal mean, in a reader's words.
MEANINGS = {
    "phone": "a phone number", "postal": "a postal code", "tax-id": "a tax number", "security-id": "a security's symbol", "identifier": "an identifier", "note": "a note that is cited", "item": "an item that is cited",
    "page-furniture": "part of a running head or foot", "superscript": "raised type", "citation-year": "the year of a law", "unsupported": "a number that a sentence needed", "partial-token": "a part of something else",
    "list-marker": "the number of a list's entry", "footnote-marker": "the number of a footnote", "footnote-reference": "a mark that points at a footnote",
}


def explained(spans: DataFrame) -> DataFrame:
    """Adds ``told``, a sentence on how a span was read, and ``facts`` (name: value) that a reader can check. ``spans``:
    category, reason, kind, text, normalized, currency, magnitude, date_precision, clickable, page."""
    says = F.create_map(*[F.lit(x) for pair in MEANINGS.items() for x in pair])
    meaning = F.coalesce(F.try_element_at(says, F.col("reason")), F.col("reason"))
    kind, n = F.col("kind"), F.col("normalized")
    read = (
        F.when(n.isNull(), F.concat(F.lit("Printed as a "), kind, F.lit(", of which no value could be made."))).when(kind == "percent", F.concat(F.lit("Read as "), n, F.lit(" percent.")))
        .when(kind == "date", F.concat(F.lit("Read as "), n, F.lit(", to the "), F.coalesce("date_precision", F.lit("day")), F.lit("."))).otherwise(F.concat(F.lit("Read as "), n, F.lit(".")))
    )
    told = F.when(F.col("category") == "value", read).when(F.col("category") == "reference", F.concat(F.lit("Captured as printed: "), meaning, F.lit("."))).otherwise(F.concat(F.lit("Not a figure: "), meaning, F.lit(".")))
    printed = F.exists(F.array(*map(F.lit, [*vocab.CURRENCY_CODES, *vocab.CURRENCY_SYMBOLS])), lambda c: F.contains(F.upper(F.col("text")), c))
    fact = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value.cast("string")))
    currency = F.when(printed, F.col("currency")).otherwise(F.concat(F.col("currency"), F.lit(" (from the page)")))
    facts = F.array(fact("value", n), fact("currency", currency), fact("magnitude", F.col("magnitude")), fact("type", kind), fact("click target", F.when(F.col("clickable"), "yes").otherwise("no")), fact("page", F.col("page") + 1))
    return spans.withColumn("told", told).withColumn("facts", F.filter(facts, lambda x: x.isNotNull()))
