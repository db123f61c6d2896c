"""The catalogues a report carries of itself: items and notes, from contents pages, headings and citations.

Lines are rows (doc, page, line, text, left, right, top, bottom, char: the median width of its characters, height: their
median height). Everything is windows, equi-joins and grouping per document, but for the rows of one page, which a kernel
reads page by page: which lines share a band, and which bands fold into one contents row. Contents rows and headings are read
by several steps each and rest on long expressions, so they are kept: without that every step plans and runs them anew.
Joins are sort-merge joins: a table that looks small in its files takes many times its size once the driver broadcasts it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import headings as H
from parchmint.operators.grouping import fold_groups, kept

#: A page with so many item rows, at least so many and such a share of them with a page number in the right column, is contents.
CONTENTS_ROWS, NUMBERED_SHARE, NUMBER_LEFT = 3, 0.5, 0.6
_PAGE_NUMBER = re.compile(r"[ivxlcdm]{1,7}|\d{1,4}", re.I)
_CONTENTS_TITLE = r"(?i)^\s*(?:table\s+of\s+contents|contents|index(?:\s+to\b.*)?)\s*$"


def page_bands(boxes: list[tuple[float, float, float]]) -> list[int]:
    """The band of each (top, bottom, left): a box joins the first band that it shares half of the lower height with."""
    bands: list[list[float]] = []
    out = [0] * len(boxes)
    for i in sorted(range(len(boxes)), key=lambda i: (boxes[i][0], boxes[i][2])):
        top, bottom, _ = boxes[i]
        for n, band in enumerate(bands):
            lower = min(bottom - top, band[1] - band[0])
            if lower > 0 and min(bottom, band[1]) - max(top, band[0]) >= 0.5 * lower:
                band[:] = [min(top, band[0]), max(bottom, band[1])]
                out[i] = n
                break
        else:
            out[i] = len(bands)
            bands.append([top, bottom])
    return out


_FIELDS = ("doc", "page", "nth", "part", "id", "title", "printed_page", "lines")
ROW = "doc long, page long, nth long, part string, id string, title string, printed_page string, lines array<long>"


def _contents(page: list[dict]) -> list[tuple]:
    """(nth, part, id, title, printed page, lines) of a page that shows contents; rows of parts have no id."""
    bands: dict[int, list[dict]] = {}
    for line, band in zip(page, page_bands([(x["top"], x["bottom"], x["left"]) for x in page]), strict=True):
        bands.setdefault(band, []).append(line)
    rows = [sorted(b, key=lambda x: x["left"]) for _, b in sorted(bands.items())]

    def number(cells: list[dict]) -> dict | None:
        last = cells[-1]
        return last if len(cells) > 1 and last["left"] >= NUMBER_LEFT and _PAGE_NUMBER.fullmatch(last["text"].strip()) else None

    anchors = [cells for cells in rows if cells[0]["item"]]
    if len(anchors) < CONTENTS_ROWS or sum(number(c) is not None for c in anchors) < max(CONTENTS_ROWS, NUMBERED_SHARE * len(anchors)):
        return []
    out: list[list] = []
    open_, anchor, margin, bottom = False, None, 0.0, 0.0
    for cells in rows:
        first, at = cells[0], number(cells)
        texts = [c for c in cells if c is not at]
        if len(cells) <= 2 and first["part_head"]:
            out.append([first["part_head"], None, None, None, []])
            open_ = False
            continue
        if first["item"]:
            told = [c for c in texts if c is not first]
            title = " ".join(x for x in [first["item"]["title"], *(c["bare"] for c in told)] if x)
            out.append([None, first["item"]["id"], title, at["text"].strip() if at else "", [c["line"] for c in cells]])
            open_, anchor, bottom = True, first, max(c["bottom"] for c in cells)
            margin = min((c["left"] for c in told), default=first["left"] + max(0.004, first["char"]))
            continue
        # a wrapped title goes on under the title, not under the number, and close below
        indent = max(0.004, anchor["char"]) if anchor else 0.0
        if open_ and texts and min(c["top"] for c in cells) - bottom <= max(0.006, 1.2 * max(anchor["height"], 0.001)):
            left = min(c["left"] for c in texts)
            title = " ".join(x for x in [out[-1][2], *(c["bare"] for c in texts)] if x)
            if anchor["left"] + indent < left < NUMBER_LEFT and left >= margin - indent and all(c["title_like"] for c in texts):
                out[-1][2] = title
                out[-1][3] = out[-1][3] or (at["text"].strip() if at else "")
                out[-1][4] += [c["line"] for c in cells]
                bottom = max(c["bottom"] for c in cells)
                continue
        open_ = False
    titled = any(line["contents_title"] for line in page)
    return [(n, *row) for n, row in enumerate(out)] if titled or sum(r[1] is not None for r in out) >= CONTENTS_ROWS else []


def _contents_rows(page: list[dict]) -> list[dict]:
    return [dict(zip(_FIELDS, (page[0]["doc"], page[0]["page"], *r), strict=True)) for r in _contents(sorted(page, key=lambda x: x["line"]))]


def contents_rows(lines: DataFrame) -> DataFrame:
    """(doc, page, nth, id, part, title, printed_page, lines): the item rows of contents pages; a part printed above holds
    for all rows after it, on later pages too."""
    bare = H.without_leaders(F.col("text"))
    told = lines.where(F.trim("text") != "").select(
        F.col("doc").cast("long"), F.col("page").cast("long"), F.col("line").cast("long"), "text", "left", "top", "bottom", "char", "height", bare.alias("bare"),
        H.item_heading(bare).alias("item"), H.part_heading(F.col("text")).alias("part_head"), H.is_title(bare).alias("title_like"), F.col("text").rlike(_CONTENTS_TITLE).alias("contents_title"),
    )
    # only pages that could be contents reach the kernel
    enough = F.count(F.when(F.col("item").isNotNull(), 1)).over(Window.partitionBy("doc", "page")) >= CONTENTS_ROWS
    rows = fold_groups(told.withColumn("enough", enough).where("enough").drop("enough"), ["doc", "page"], _contents_rows, ROW, placed=True)
    order = Window.partitionBy("doc").orderBy("page", "nth")
    carried = F.coalesce(F.last("part", ignorenulls=True).over(order), F.lit(""))
    return kept(rows.withColumn("part", carried).where("id is not null").select("doc", "page", "nth", "id", "part", "title", "printed_page", "lines"))


def _extends(text: str, cur: str, left: Column) -> Column:
    """Whether line struct ``text`` goes on with the title of line struct ``cur``, which begins at ``left``."""
    f = lambda c, n: F.col(f"{c}.{n}")
    tall = F.greatest(f(cur, "height"), f(text, "height"), F.lit(0.001))
    near = (f(text, "top") - f(cur, "bottom") <= F.greatest(F.lit(0.004), 0.9 * tall)) & (f(cur, "page") == f(text, "page"))
    shared = F.greatest(F.least(f(cur, "bottom"), f(text, "bottom")) - F.greatest(f(cur, "top"), f(text, "top")), F.lit(0.0))
    lower = F.least(f(cur, "bottom") - f(cur, "top"), f(text, "bottom") - f(text, "top"))
    beside = (lower > 0) & (shared >= 0.7 * lower)
    gap = f(text, "left") - f(cur, "right")
    right = (f(text, "left") > f(cur, "left")) & (gap >= -F.greatest(F.lit(0.005), f(cur, "char"))) & (gap <= F.greatest(F.lit(0.04), 5 * f(cur, "char")))
    under = F.abs(f(text, "left") - left) <= F.greatest(F.lit(0.01), 2 * f(cur, "char"))
    return F.coalesce(near & f(text, "heading").isNull() & H.is_title(f(text, "text")) & F.when(beside, right).otherwise(under), F.lit(False))


def wrapped_headings(lines: DataFrame, heading: Column, word: str) -> DataFrame:
    """(doc, page, line, id, title, continued, lines, more fields of ``heading``): headings with titles followed over up to
    two further lines. ``heading`` is null where a line is none."""
    fields = ("page", "line", "text", "left", "right", "top", "bottom", "char", "height")
    t = lines.withColumn("heading", heading)
    order = Window.partitionBy("doc").orderBy("page", "line")
    own = F.struct(*fields, "heading")
    t = t.select("doc", own.alias("a"), F.lead(own).over(order).alias("b"), F.lead(own, 2).over(order).alias("c")).where("a.heading is not null")
    at = F.instr(F.col("a.text"), F.col("a.heading.title")) - 1
    offset = F.when((F.col("a.heading.title") != "") & (at >= 0), at).otherwise(F.greatest(F.lit(4), F.length(F.concat(F.lit(word + " "), F.col("a.heading.id")))))
    first = ~F.col("a.heading.continued") & _extends("b", "a", F.col("a.left") + offset * F.col("a.char"))
    t = t.withColumn("first", first).withColumn("second", F.col("first") & _extends("c", "b", F.col("b.left")))
    parts = F.concat(F.array("a.heading.title"), F.when(F.col("first"), F.array(F.trim("b.text"))).otherwise(F.array()), F.when(F.col("second"), F.array(F.trim("c.text"))).otherwise(F.array()))
    joined = F.trim(F.array_join(F.filter(parts, lambda x: x != ""), " "))
    held = F.concat(F.array("a.line"), F.when(F.col("first"), F.array("b.line")).otherwise(F.array()), F.when(F.col("second"), F.array("c.line")).otherwise(F.array()))
    title = F.when(F.col("first"), F.regexp_replace(joined, H._GOES_ON, "")).otherwise(joined)
    return t.select("doc", F.col("a.page").alias("page"), F.col("a.line").alias("line"), F.col("a.heading.id").alias("id"), title.alias("title"),
        (F.col("a.heading.continued") | F.col("first") & H.goes_on(joined)).alias("continued"), held.alias("lines"), F.col("a.heading").alias("heading"))


def item_headings(lines: DataFrame, contents: DataFrame) -> DataFrame:
    """(doc, page, line, id, part, title, continued, lines): item headings outside of contents rows, under their part."""
    used = contents.select("doc", F.explode("lines").alias("line"), F.lit(True).alias("used"))
    rest = lines.join(used.hint("merge"), ["doc", "line"], "left").where("used is null").drop("used")
    found = wrapped_headings(rest, H.item_heading(F.col("text")), "Item").drop("heading")
    parts = rest.select("doc", "page", "line", H.part_heading(F.col("text")).alias("part")).where("part is not null")
    both = found.withColumn("part", F.lit(None).cast("string")).unionByName(parts, allowMissingColumns=True)
    carried = F.coalesce(F.last("part", ignorenulls=True).over(Window.partitionBy("doc").orderBy("page", "line")), F.lit(""))
    return kept(both.withColumn("part", carried).where("id is not null").select("doc", "page", "line", "id", "part", "title", "continued", "lines"))


def canonical_titles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, title): the most frequent title of each key, letter case and spacing aside, the longest on ties, then the
    first; titles of continuations count only where no other heading has one. ``rows``: keys, title, continued, at."""
    shown = rows.withColumn("t", F.trim(F.regexp_replace("title", r"\s+", " "))).where("t <> ''")
    full = F.max((~F.col("continued")).cast("int")).over(Window.partitionBy(*keys))
    usable = shown.withColumn("full", full).where("full = 0 or not continued")
    votes = usable.groupBy(*keys, F.lower("t").alias("low")).agg(F.count("*").alias("n"), F.min(F.struct("at", "t")).alias("first"))
    best = F.max(F.struct("n", F.length("low"), F.struct(-F.col("first.at.page"), -F.col("first.at.line")), "first.t"))
    return votes.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.t").alias("title"))


def item_catalogue(contents: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc, id, part, title, title_source, in_contents, in_body): one entry an item; an id printed under several parts has
    one entry a part, and occurrences of it without a part go to the first. Contents name an item before headings do."""
    at = lambda page, line: F.struct(F.col(page).cast("long").alias("page"), F.col(line).cast("long").alias("line"))
    rows = contents.select("doc", "id", "part", "title", F.lit(False).alias("continued"), F.lit(0).alias("source"), at("page", "nth").alias("at"))
    rows = rows.union(headings.select("doc", "id", "part", "title", "continued", F.lit(1), at("page", "line")))
    order = F.struct("source", "at")
    of_id = Window.partitionBy("doc", "id")
    several = F.size(F.collect_set(F.when(F.col("part") != "", F.col("part"))).over(of_id)) > 1
    first_part = F.min(F.when(F.col("part") != "", F.struct(order, "part"))).over(of_id)["part"]
    keyed = rows.withColumn("key", F.when(several, F.when(F.col("part") == "", first_part).otherwise(F.col("part"))).otherwise(""))
    keys = ["doc", "id", "key"]
    entries = keyed.groupBy(*keys).agg(
        F.min(F.when(F.col("part") != "", F.struct(order, "part")))["part"].alias("part"), F.sum((F.col("source") == 0).cast("int")).cast("long").alias("in_contents"), F.sum("source").cast("long").alias("in_body"))
    toc, body = (canonical_titles(keyed.where(F.col("source") == s), keys).withColumnRenamed("title", n) for s, n in ((0, "toc"), (1, "body")))
    out = entries.join(toc.hint("merge"), keys, "left").join(body.hint("merge"), keys, "left")
    source = F.when(F.col("toc").isNotNull(), "contents").when(F.col("body").isNotNull(), "heading").otherwise("none")
    return out.select("doc", "id", F.coalesce("part", F.lit("")).alias("part"), F.coalesce("toc", "body", F.lit("")).alias("title"), source.alias("title_source"), "in_contents", "in_body")


def note_headings(lines: DataFrame) -> DataFrame:
    """(doc, page, line, id, title, continued, explicit, lines): headings of notes; bare numbers head notes only after the
    notes section has opened, and only in reports that never write "Note". Of bare ones, digits rule out Roman numbers."""
    order = Window.partitionBy("doc").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, -1)
    t = lines.withColumn("opened", F.coalesce(F.max(H.opens_notes(F.col("text"))).over(order), F.lit(False)))
    found = wrapped_headings(t, H.note_heading(F.col("text"), F.col("opened")), "Note")
    found = found.withColumn("explicit", F.col("heading.explicit")).drop("heading")
    of_doc = Window.partitionBy("doc")
    named = F.max("explicit").over(of_doc)
    digits = F.max(~F.col("explicit") & F.col("id").rlike("^[0-9]")).over(of_doc)
    own = F.when(F.col("named"), F.col("explicit")).otherwise(~F.col("digits") | F.col("id").rlike("^[0-9]"))
    return kept(found.withColumn("named", named).withColumn("digits", digits).where(own).select("doc", "page", "line", "id", "title", "continued", "explicit", "lines"))


def note_catalogue(headings: DataFrame) -> DataFrame:
    """(doc, id, title, headings): one entry a note."""
    rows = headings.withColumn("at", F.struct(F.col("page").cast("long").alias("page"), F.col("line").cast("long").alias("line")))
    titles = canonical_titles(rows, ["doc", "id"])
    return headings.groupBy("doc", "id").agg(F.count("*").alias("headings")).join(titles.hint("merge"), ["doc", "id"], "left").select("doc", "id", F.coalesce("title", F.lit("")).alias("title"), "headings")


_CITED = {
    "item": re.compile(r"\bitems?\s+(" + H.ITEM_ID + r")\b", re.I),
    "note": re.compile(r"\bnotes?\s+(" + H.NOTE_ID + r")\b", re.I),
}
_NEXT_NOTE = re.compile(r"\s*(?:,\s*(?:and\s+)?|\band\s+|&\s*)(" + H.NOTE_ID + r")\b", re.I)
_PART_BEFORE = re.compile(r"\bpart\s+([IVXLCDM]{1,6})\b[\s,.:;–—-]*$", re.I)
_RULES_AFTER = re.compile(r"(?:\([^()]{1,12}\))*\s*(?:of|under|to)\s+(?:regulation|reg\.|rule|form)\b", re.I)
CITED = "array<struct<raw:string,start:int,end:int,part:string,rest:string>>"
_CITED_TYPE = pa.list_(pa.struct([("raw", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("part", pa.string()), ("rest", pa.string())]))


def cited(text: str | None, kind: str) -> list[dict]:
    """Citations of a line by start: each number as printed, its place, the part named before it and what follows it.
    A list of notes ("Notes 3, 4 and 7") is one citation a number; items of rules are none."""
    out, at = [], 0
    while text and (m := _CITED[kind].search(text, at)):
        at = m.end()
        if kind == "item" and _RULES_AFTER.match(text, at):
            continue
        part = _PART_BEFORE.search(text[: m.start()]) if kind == "item" else None
        numbers = [m[1]]
        while kind == "note" and m[0].lower().startswith("notes") and (more := _NEXT_NOTE.match(text, at)):
            numbers.append(more[1])
            at = more.end()
        out += [{"raw": n, "start": m.start(), "end": at, "part": part[1].upper() if part else "", "rest": text[at:] if len(numbers) == 1 else ""} for n in numbers]
    return out


def _cited_kernel(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [cited(t, kind) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _CITED_TYPE)], names=[*batch.schema.names[:-1], "cited"])


def _citations(lines: DataFrame, kind: str, used: DataFrame) -> DataFrame:
    """(doc, page, line, id, part, title, start, end) of citations outside of the lines ``used``."""
    from functools import partial

    rest = lines.join(used.select("doc", F.explode("lines").alias("line"), F.lit(True).alias("used")).distinct().hint("merge"), ["doc", "line"], "left").where("used is null")
    rest = rest.where(F.col("text").rlike(rf"(?i)\b{kind}s?\s+[0-9IVXLCDM]")).select("doc", "page", "line", "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema[:-1])
    c = rest.mapInArrow(partial(_cited_kernel, kind=kind), f"{schema}, cited {CITED}").select("doc", "page", "line", F.explode("cited").alias("c"))
    told = H.title_after(F.col("c.rest"))
    number = H.item_id(F.col("c.raw")) if kind == "item" else H.note_id(F.col("c.raw"))
    c = c.select("doc", "page", "line", number.alias("id"), F.coalesce(H.roman(F.col("c.part")), F.lit("")).alias("part"), told["title"].alias("title"), F.col("c.start").alias("start"), (F.col("c.end") + told["length"]).alias("end"))
    return c.where("id is not null")


def item_citations(lines: DataFrame, catalogue: DataFrame, contents: DataFrame, headings: DataFrame) -> DataFrame:
    """Citations of catalogued items; an id with entries under several parts is resolved by the part named before it only."""
    c = _citations(lines, "item", contents.select("doc", "lines").union(headings.select("doc", "lines")))
    entries = catalogue.select("doc", "id", F.col("part").alias("entry_part"), F.count("*").over(Window.partitionBy("doc", "id")).alias("entries"))
    return c.join(entries.hint("merge"), ["doc", "id"]).where("entries = 1 or part = entry_part").select("doc", "page", "line", "id", "entry_part", "title", "start", "end")


def note_citations(lines: DataFrame, catalogue: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc, page, line, ids, title, start, end): citations of catalogued notes, one row a citation with all its notes."""
    c = _citations(lines, "note", headings.select("doc", "lines")).join(catalogue.select("doc", "id").hint("merge"), ["doc", "id"], "left_semi")
    return c.groupBy("doc", "page", "line", "start", "end").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.first("title").alias("title"))


def applicability(lines: DataFrame, items: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc, searched, kind, items, notes): what each document is: a filing with items, a statement with notes, or
    neither; documents where nothing was found are there too, so absence is explicit."""
    n = lambda df, name: df.groupBy("doc").agg(F.count("*").alias(name))
    out = lines.groupBy("doc").agg(F.count("*").alias("searched")).join(n(items, "items").hint("merge"), "doc", "left").join(n(notes, "notes").hint("merge"), "doc", "left").na.fill(0, ["items", "notes"])
    return out.withColumn("kind", F.when(F.col("items") > 0, "filing").when(F.col("notes") > 0, "statement").otherwise("neither")).select("doc", "searched", "kind", "items", "notes")
