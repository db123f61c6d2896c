"""What stands around a figure: its box, its island of white space, the page's type size, wrapped dates, furniture at page
edges, currency and scale of a page, and whether a page's text can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import scalars, vocab
from parchmint.operators.windows import repeating_skeletons

#: Glyphs that make a page's median height typical.
TYPICAL_GLYPHS = 200
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"


def span_boxes(spans: DataFrame, glyphs: DataFrame, keys: tuple[str, ...] = ("doc", "page", "line")) -> DataFrame:
    """Adds x, y, w, h (the box of a span's visible glyphs, clamped to the page), height (their median) and isolated: two
    glyph widths of white space on both sides.

    ``spans``: keys, start, end; ``glyphs``: keys, i (place in the line), char, x, y, w, h; spaces have no row.
    """
    line = glyphs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "x", "y", "w", "h"))).alias("_g"))
    t = spans.join(line.hint("merge"), list(keys), "left")
    inside = F.filter("_g", lambda g: (g["i"] >= F.col("start")) & (g["i"] < F.col("end")))
    t = t.withColumn("_own", inside).withColumn("_before", F.filter("_g", lambda g: g["i"] < F.col("start"))).withColumn("_after", F.filter("_g", lambda g: g["i"] >= F.col("end")))
    low = lambda n: F.array_min(F.transform("_own", lambda g: g[n]))
    right, bottom = F.array_max(F.transform("_own", lambda g: g["x"] + g["w"])), F.array_max(F.transform("_own", lambda g: g["y"] + g["h"]))
    wide = _middle(F.filter(F.transform("_own", lambda g: g["w"]), lambda w: w > 0), 0.005)
    left_gap = low("x") - (F.element_at("_before", -1)["x"] + F.element_at("_before", -1)["w"])
    right_gap = F.element_at("_after", 1)["x"] - right
    far = lambda some, gap: F.when(F.size(some) == 0, F.lit(True)).otherwise(gap >= 2 * wide)
    some = F.size("_own") > 0
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    t = t.withColumns({
        "x": F.when(some, clamp(low("x"))), "y": F.when(some, clamp(low("y"))),
        "w": F.when(some, F.greatest(F.lit(1e-6), F.least(1 - low("x"), right - low("x")))), "h": F.when(some, F.greatest(F.lit(1e-6), F.least(1 - low("y"), bottom - low("y")))),
        "height": F.when(some, _middle(F.filter(F.transform("_own", lambda g: g["h"]), lambda h: h > 0), 0.0)),
        "isolated": F.coalesce(some & far(F.col("_before"), left_gap) & far(F.col("_after"), right_gap), F.lit(False)),
    })
    return t.drop("_g", "_own", "_before", "_after")


def _middle(values: Column, none: float) -> Column:
    """The median of a short array."""
    s, n = F.sort_array(values), F.size(values)
    return F.when(n == 0, none).otherwise((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def united(boxes: Column) -> Column:
    """The box around an array of boxes (x, y, w, h)."""
    x, y = F.array_min(F.transform(boxes, lambda b: b["x"])), F.array_min(F.transform(boxes, lambda b: b["y"]))
    right, bottom = F.array_max(F.transform(boxes, lambda b: b["x"] + b["w"])), F.array_max(F.transform(boxes, lambda b: b["y"] + b["h"]))
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h"))


def line_envelopes(glyphs: DataFrame) -> DataFrame:
    """(doc, page, line, left, right, top, bottom, char, height) of the visible glyphs of each line."""
    shown = glyphs.where(F.trim("char") != "")
    return shown.groupBy("doc", "page", "line").agg(
        F.min("x").alias("left"), F.max(F.col("x") + F.col("w")).alias("right"), F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"),
        F.coalesce(F.percentile(F.when(F.col("w") > 0, F.col("w")), 0.5), F.lit(0.005)).alias("char"), F.coalesce(F.percentile(F.when(F.col("h") > 0, F.col("h")), 0.5), F.lit(0.0)).alias("height"),
    )


def page_type(glyphs: DataFrame) -> DataFrame:
    """(doc, page, glyphs, typical): the median glyph height of pages with enough glyphs, else that of the document."""
    shown = glyphs.where("h > 0")
    page = shown.groupBy("doc", "page").agg(F.count("*").alias("glyphs"), F.percentile("h", 0.5).alias("own"))
    doc = shown.groupBy("doc").agg(F.percentile("h", 0.5).alias("all"))
    return page.join(doc.hint("merge"), "doc").select("doc", "page", "glyphs", F.when(F.col("glyphs") >= TYPICAL_GLYPHS, F.col("own")).otherwise(F.col("all")).alias("typical"))


def edge_furniture(lines: DataFrame) -> DataFrame:
    """(doc, page, line): repeated lines above the first or below the last ordinary line of their page; a page of nothing
    else is furniture throughout. ``lines``: doc, page, line, text, top."""
    repeated = repeating_skeletons(lines).select("doc", "skeleton", F.lit(True).alias("repeated"))
    order = lines.where(F.trim("text") != "").withColumn("skeleton", scalars.skeleton(F.col("text"))).withColumn("at", F.row_number().over(Window.partitionBy("doc", "page").orderBy("top", "line")))
    t = order.join(repeated.hint("merge"), ["doc", "skeleton"], "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
    page = Window.partitionBy("doc", "page")
    plain = F.when(~F.col("repeated"), F.col("at"))
    t = t.withColumn("first", F.min(plain).over(page)).withColumn("last", F.max(plain).over(page))
    return t.where("repeated and (first is null or at < first or at > last)").select("doc", "page", "line")


def wrapped_dates(lines: DataFrame) -> DataFrame:
    """(doc, page, line, start, end, year_start, text, normalized): a month and day without a year, joined to the nearest
    year alone in its white space that stands under it on the next line of the page.

    ``lines``: doc, page, line, text, top, bottom, height, left, char (a glyph's width: places are at even widths). Of heads
    on one line each takes the nearest year not taken by one before it.
    """
    head = rf"(?i)\b{_MONTH}\.?\s+[0-9]{{1,2}}(?:st|nd|rd|th)?(?!\s*,?\s*(?:19|20)[0-9]{{2}}\b)(?![0-9])\s*,?"
    below = Window.partitionBy("doc", "page").orderBy("line")
    t = lines.withColumn("next", F.lead(F.struct("text", "top", "height", "left", "char", "line")).over(below))
    tight = F.col("next.top") - F.col("bottom") <= F.greatest(F.lit(0.004), 0.375 * (F.col("height") + F.col("next.height")))
    t = t.where(F.col("text").rlike(head) & F.col("next.text").rlike(r"\b(?:19|20)[0-9]{2}\b") & tight)
    from parchmint.operators.reading import match_places

    h = t.select("doc", "page", "line", "text", "left", "char", "next", F.explode(match_places(F.col("text"), head)).alias("h"), match_places(F.col("next.text"), r"\b(?:19|20)[0-9]{2}\b").alias("years"))
    x0, x1 = F.col("left") + F.col("h.start") * F.col("char"), F.col("left") + F.col("h.end") * F.col("char")
    room = F.greatest(F.lit(0.006), 0.15 * (x1 - x0))
    centre = lambda y: F.col("next.left") + (y["start"] + y["end"]) / 2 * F.col("next.char")
    alone = lambda y: ~F.substring(F.col("next.text"), y["start"] - 1, F.lit(2)).rlike(r"\S\s$|\S$") | (y["start"] < 1)
    apart = lambda y: alone(y) & ~F.substring(F.col("next.text"), y["end"] + 1, F.lit(2)).rlike(r"^\S|^\s\S")
    under = F.filter("years", lambda y: (centre(y) >= x0 - room) & (centre(y) <= x1 + room) & apart(y))
    pairs = h.select("doc", "page", "line", "text", "next", "h", F.explode(F.transform(under, lambda y: F.struct(F.abs(centre(y) - (x0 + x1) / 2).alias("far"), y["start"].alias("start"), y["end"].alias("end")))).alias("y"))
    best = F.row_number().over(Window.partitionBy("doc", "page", "line", "h.start").orderBy("y.far", "y.start"))
    first = F.row_number().over(Window.partitionBy("doc", "page", "line", "y.start").orderBy("h.start"))
    one = pairs.withColumn("n", best).where("n = 1").withColumn("m", first).where("m = 1")
    shown = F.concat_ws(" ", F.regexp_replace(F.trim(F.substring(F.col("text"), F.col("h.start") + 1, F.col("h.end") - F.col("h.start"))), r"\s*,$", ""), F.substring(F.col("next.text"), F.col("y.start") + 1, F.lit(4)))
    month = F.substring(F.lower(F.regexp_extract(shown, rf"(?i)^({_MONTH})", 1)), 1, 3)
    number = F.array_position(F.array(*[F.lit(m[:3]) for m in vocab.MONTHS]), month)
    day, year = F.regexp_extract(shown, r"([0-9]{1,2})(?:st|nd|rd|th)? [0-9]{4}$", 1).try_cast("int"), F.regexp_extract(shown, r"([0-9]{4})$", 1).try_cast("int")
    iso = F.format_string("%04d-%02d-%02d", year, number.cast("int"), day)
    return one.select("doc", "page", "line", F.col("h.start").alias("start"), F.col("h.end").alias("end"), F.col("y.start").alias("year_start"), shown.alias("text"), F.when(F.try_to_date(iso, "yyyy-MM-dd").isNotNull(), iso).alias("normalized"))


# How a page says that its figures are scaled, the largest first.
SCALE_WORDS = (
    (10**9, r"(?:amounts?\s+)?in\s+billions?"), (10**6, r"(?:amounts?\s+)?in\s+millions?"),
    (10**3, r"(?:amounts?\s+)?in\s+thousands?"), (1, r"(?:amounts?\s+)?in\s+(?:ones|units|dollars)"),
)


def page_contexts(pages: DataFrame) -> DataFrame:
    """(doc, page, currency, scale, doc_currency): the currency a page names most, codes and symbols counted together, the
    first of the list on ties; the first scale it states; and the currency of most pages, the first page on ties.
    ``pages``: doc, page, text."""
    symbol = {code: s for s, code in vocab.CURRENCY_SYMBOLS.items()}
    counts = [F.struct((F.regexp_count(F.upper("text"), F.lit(rf"\b{c}\b")) + (F.regexp_count("text", F.lit("\\Q" + symbol[c] + "\\E")) if c in symbol else F.lit(0))).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("code")) for i, c in enumerate(vocab.CURRENCY_CODES)]
    best, scale = F.array_max(F.array(*counts)), F.lit(None).cast("long")
    for value, words in reversed(SCALE_WORDS):
        scale = F.when(F.col("text").rlike(rf"(?i)\b{words}\b"), F.lit(value).cast("long")).otherwise(scale)
    told = pages.select("doc", "page", best.alias("best"), scale.alias("scale")).select("doc", "page", F.when(F.col("best.n") > 0, F.col("best.code")).alias("currency"), "scale")
    votes = told.where("currency is not null").groupBy("doc", "currency").agg(F.count("*").alias("n"), F.min("page").alias("first"))
    doc = votes.groupBy("doc").agg(F.max_by("currency", F.struct("n", -F.col("first"))).alias("doc_currency"))
    return told.join(doc.hint("merge"), "doc", "left")


def _shared(p0: Column, p1: Column, q0: Column, q1: Column) -> Column:
    """Overlap of two stretches as a share of the shorter one."""
    return F.greatest(F.least(p1, q1) - F.greatest(p0, q0), F.lit(0.0)) / F.greatest(F.least(p1 - p0, q1 - q0), F.lit(1e-6))


def same_place(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Whether two recognised lines stand in one place."""
    return (_shared(ax0, ax1, bx0, bx1) >= 0.10) & (_shared(ay0, ay1, by0, by1) >= 0.35)


def coincident(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Whether one box repeats another: eight tenths of the smaller on both axes."""
    return (_shared(ax0, ax1, bx0, bx1) >= 0.80) & (_shared(ay0, ay1, by0, by1) >= 0.80)


def overlapping_copies(lines: DataFrame) -> DataFrame:
    """(doc, page): pages with a line that repeats another of the same text in its place: a hidden text layer. ``lines``:
    doc, page, id, text, x0, y0, x1, y1; only lines of one text meet."""
    a = lines.select("doc", "page", "text", *(F.col(c).alias("a_" + c) for c in ("id", "x0", "y0", "x1", "y1")))
    met = lines.join(a, ["doc", "page", "text"]).where("id > a_id").where(coincident(*(F.col(c) for c in ("a_x0", "a_y0", "a_x1", "a_y1", "x0", "y0", "x1", "y1"))))
    return met.select("doc", "page").distinct()


def sparse_text(pages: Column, letters: Column, words: Column, lines: Column) -> Column:
    """Whether a document of so many pages has implausibly little text."""
    few = (letters < F.greatest(F.lit(40), pages * 20)) | (words < F.greatest(F.lit(8), pages * 4)) | (lines < F.greatest(F.lit(3), pages * 2))
    return (pages > 0) & few


def pages_to_recognise(pages: DataFrame) -> DataFrame:
    """(doc, page, why): pages whose text can't be used: garbled; there but weak; or none, on a page with a scan or drawings.
    ``pages``: doc, page, chars, letter_share, invalid_share, garbled, image_share, drawings."""
    good = (F.col("chars") >= 80) & (F.col("letter_share") >= 0.30) & (F.col("invalid_share") < 0.02)
    why = F.when(F.col("garbled"), "garbled").when(good, F.lit(None)).when(F.col("chars") > 0, "weak").when((F.col("image_share") >= 0.5) | (F.col("drawings") >= 3), "image")
    return pages.select("doc", "page", why.alias("why")).where("why is not null")


def takes_turned(first: Column, second: Column) -> Column:
    """Whether a page recognised again after turning it is better: enough of its words and letters, and sure enough: within
    two points of a good first reading, eight above a poor one. Both: struct (confidence, words, chars)."""
    enough = (second["words"] >= F.greatest(F.lit(5.0), first["words"] * 0.5)) & (second["chars"] >= F.greatest(F.lit(20.0), first["chars"] * 0.5))
    least = F.when(first["confidence"] >= 75, first["confidence"] - 2).otherwise(first["confidence"] + 8)
    return enough & (second["confidence"] >= F.greatest(F.lit(50.0), least))


def takes_cleaned(first: Column, second: Column) -> Column:
    """Whether a page recognised again after cleaning adds a twentieth of text without losing its sureness."""
    more = (second["chars"] >= first["chars"] * 1.05) & (second["words"] >= first["words"] * 1.05)
    return more & (second["confidence"] >= F.greatest(F.lit(45.0), first["confidence"] - 15))


def merged_reading(first: DataFrame, second: DataFrame) -> DataFrame:
    """Lines of two recognition passes of a page: the second adds lines that no line of the first overlaps, and replaces
    weaker ones that it overlaps (a tenth of the narrower width and 35 % of the lower height).

    Both: page, id, x0, y0, x1, y1, confidence, text. Lines of one page meet in an equi-join on it.
    """
    a, b = first.select("page", *(F.col(c).alias("a_" + c) for c in ("id", "x0", "y0", "x1", "y1", "confidence"))), second
    met = b.join(a, "page").where(same_place(*(F.col(c) for c in ("a_x0", "a_y0", "a_x1", "a_y1", "x0", "y0", "x1", "y1"))))
    per_new = met.groupBy("page", "id").agg(F.max("a_confidence").alias("best"), F.max("confidence").alias("own"), F.collect_set("a_id").alias("over"))
    stronger = per_new.where("own > best")
    gone = stronger.select("page", F.explode("over").alias("id"))
    kept = first.join(gone, ["page", "id"], "left_anti").withColumn("pass", F.lit(1))
    new = second.join(per_new.select("page", "id"), ["page", "id"], "left_anti").union(second.join(stronger.select("page", "id"), ["page", "id"], "left_semi"))
    return kept.union(new.withColumn("pass", F.lit(2)))


def span_counts(spans: DataFrame) -> DataFrame:
    """(doc, category, label, published, suppressed): diagnostic counts of read spans by what they were taken for: a value's
    kind, a reference's kind or the reason of a refusal. ``spans``: doc, category, kind, reason."""
    label = F.when(F.col("category") == "value", F.col("kind")).otherwise(F.col("reason"))
    shown = F.col("category").isin("value", "reference")
    return spans.groupBy("doc", "category", label.alias("label")).agg(F.count_if(shown).alias("published"), F.count_if(~shown).alias("suppressed"))
