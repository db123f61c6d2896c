"""Ordinals that number something: list markers, footnotes and the marks that point at them.

Candidates are read line by line (a kernel sees a line and its neighbours of the page), chains are islands over windows, and
marks meet their footnotes by an equi-join on the printed form. Lines: doc, page, line, text, left, right, top, bottom, char
(median width of a character), height (median height).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import vocab
from parchmint.operators.windows import islands

_MARK = re.compile(r"(\()?(\d{1,3}(?:\.\d{1,3})*)([).])?[*†‡§¶]{0,2}(?=[\s(]|$)")
_QUANTITY = re.compile(r"\s*(?:%|percent\b|\d|thousand|million|billion|trillion)", re.I)
_WORD = re.compile(r"[^\W\d_]{2,}")
_AFTER_SPACE = re.compile(r"(?<=\S)\s?(?=\(?\d)")
_MARKED, _LISTED = set(")]”’"), set(")]”’;:")


def ordinal(text: str, at: int) -> re.Match | None:
    """An ordinal at a place whose brackets pair and that doesn't go on into a quantity; ``groups``: open, digits, close."""
    m = _MARK.match(text, at)
    return m if m and (m[1] is not None) == (m[3] == ")") and not _QUANTITY.match(text, m.end()) else None


def is_prose(text: str) -> bool:
    return len(_WORD.findall(text)) >= vocab.LIST_PROSE_WORDS


def candidates(line: dict, near: list[dict], typical: float) -> list[tuple[str, int, int, str, bool]]:
    """(place, start, end, digits, bracketed) of a line's ordinals. Leading: text follows on the line or beside it. Raised:
    alone on its line and smaller than the page's text. Trailing: after a word, with nothing but more marks after it.
    Inline: after a word or a clause, with text after it."""
    text, out = line["text"], []
    head = len(text) - len(text.lstrip())
    m = ordinal(text, head)
    if m:
        rest = text[m.end() :].strip()
        beside = any(o["line"] != line["line"] and o["top"] < line["bottom"] and o["bottom"] > line["top"] and o["left"] > line["right"] + line["char"] and is_prose(o["text"]) for o in near)
        if is_prose(rest) if rest else beside:
            out.append(("leading", *m.span(), m[2], m[1] is not None))
        elif not rest and 0 < line["height"] < typical * vocab.RAISED_RATIO:
            out.append(("raised", *m.span(), m[2], m[1] is not None))
    for gap in _AFTER_SPACE.finditer(text):
        if gap.end() <= head or not (m := ordinal(text, gap.end())):
            continue
        before, rest = text[: gap.end()].rstrip().rstrip(".,")[-1:], text[m.end() :].strip()
        if (not rest or _MARK.match(rest)) and (before.isalpha() or before in _MARKED):
            out.append(("trailing", *m.span(), m[2], m[1] is not None))
        elif is_prose(rest) and (before.isalpha() or before in _LISTED):
            out.append(("inline", *m.span(), m[2], m[1] is not None))
    return out


_FOUND = pa.list_(pa.struct([("place", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("digits", pa.string()), ("bracketed", pa.bool_())]))


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        found = [[dict(zip(("place", "start", "end", "digits", "bracketed"), c, strict=True)) for c in candidates(r["own"], r["near"] or [], r["typical"] or 0.0)] for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(found, _FOUND)], names=["own", "found"])


def typical_heights(lines: DataFrame) -> DataFrame:
    """Adds ``typical``: the median height of the page's lines, of the document's where the page has few."""
    shown = F.when(F.col("height") > 0, F.col("height"))
    page, doc = Window.partitionBy("doc", "page"), Window.partitionBy("doc")
    own = F.when(F.count(shown).over(page) >= vocab.TYPICAL_LINES, F.percentile(shown, F.lit(0.5)).over(page))
    return lines.withColumn("typical", F.coalesce(own, F.percentile(shown, F.lit(0.5)).over(doc), F.lit(0.0)))


def ordinals(lines: DataFrame) -> DataFrame:
    """(doc, page, line, top, left, char, place, start, end, text, parts, bracketed) of every ordinal that could number something."""
    own = F.struct("doc", "page", "line", "text", "left", "right", "top", "bottom", "char", "height")
    around = Window.partitionBy("doc", "page").orderBy("line").rowsBetween(-vocab.BAND_LINES, vocab.BAND_LINES)
    rows = typical_heights(lines).select(own.alias("own"), F.collect_list(own).over(around).alias("near"), "typical").where(F.col("own.text").rlike("[0-9]"))
    kind = rows.schema["own"].dataType.simpleString()
    found = rows.mapInArrow(_kernel, f"own {kind}, found array<struct<place:string,start:int,end:int,digits:string,bracketed:boolean>>")
    f = found.select("own", F.explode("found").alias("f"))
    parts = F.transform(F.split("f.digits", r"\."), lambda p: p.cast("int"))
    text = F.substring(F.col("own.text"), F.col("f.start") + 1, F.col("f.end") - F.col("f.start"))
    return f.select("own.doc", "own.page", "own.line", "own.top", "own.left", "own.char", "f.place", "f.start", "f.end", text.alias("text"), parts.alias("parts"), "f.bracketed")


def follows(first: Column, second: Column) -> Column:
    """Whether a list prints ``second`` after ``first``: the last part one more in the same group, or a new group from 1."""
    head = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    group = (F.size(first) == F.size(second)) & (head(first) == head(second))
    last = F.element_at(second, -1)
    return F.coalesce((second > first) & F.when(group, last == F.element_at(first, -1) + 1).otherwise(last == 1), F.lit(False))


def _chains(rows: DataFrame, keys: list[str], together: Column) -> DataFrame:
    """Rows of chains of at least ``LIST_CHAIN`` ordinals that follow each other, with ``chain``."""
    order = ["page", "line", "start"]
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = islands(rows, keys, order, ~(follows(F.lag("parts").over(w), F.col("parts")) & F.coalesce(together, F.lit(False))), "chain")
    return runs.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "chain"))).where(F.col("n") >= vocab.LIST_CHAIN).drop("n")


def list_marks(lines: DataFrame) -> DataFrame:
    """(doc, page, line, start, end, text, kind): list-marker, footnote-marker and footnote-reference.

    Leading ordinals in one column, on one page or the next, that count on are a list, bracketed ones footnotes; inline ones
    within eight lines are a list. A single bracketed definition is a footnote where a mark of its form stands above it on
    the page. Trailing and raised marks refer to a footnote of their form on their page or up to four pages on.
    """
    c = ordinals(lines)
    keys = ["doc", "bracketed"]
    w = Window.partitionBy(*keys).orderBy("page", "line", "start")
    column = F.abs(F.col("left") - F.lag("left").over(w)) <= F.greatest(F.lit(vocab.COLUMN_TOLERANCE), 3 * F.col("char"))
    leading = c.where("place = 'leading'")
    led = _chains(leading, keys, column & (F.col("page") - F.lag("page").over(w) <= 1))
    of_doc = Window.partitionBy("doc").orderBy("page", "line", "start")
    passage = (F.col("page") == F.lag("page").over(of_doc)) & (F.col("line") - F.lag("line").over(of_doc) <= vocab.INLINE_REACH)
    inline = _chains(c.where("place = 'inline'"), ["doc"], passage)
    marks = c.where("place in ('trailing', 'raised')")
    alone = leading.where("bracketed").join(led.select("doc", "page", "line", "start").hint("merge"), ["doc", "page", "line", "start"], "left_anti")
    above = marks.select("doc", "page", "text", F.col("top").alias("mark_top"))
    pointed = alone.join(above.hint("merge"), ["doc", "page", "text"]).where("mark_top < top").groupBy("doc", "page", "line", "start", "end", "text").agg(F.count("*").alias("n")).where(F.col("n") >= vocab.FOOTNOTE_MARKS)
    shape = ["doc", "page", "line", "start", "end", "text"]
    kind = F.when(F.col("bracketed"), "footnote-marker").otherwise("list-marker").alias("kind")
    out = led.select(*shape, kind).union(pointed.select(*shape, F.lit("footnote-marker"))).union(inline.select(*shape, F.lit("list-marker")))
    ranges = led.where("bracketed").select("doc", "chain", "text", "page")
    span = Window.partitionBy("doc", "chain")
    forms = ranges.select("doc", "text", F.min("page").over(span).alias("first"), F.max("page").over(span).alias("last")).union(pointed.select("doc", "text", "page", "page")).distinct()
    near = F.col("page").between(F.col("first") - vocab.FOOTNOTE_PAGES, F.col("last"))
    pointing = marks.join(forms.hint("merge"), ["doc", "text"]).where(near).select(*shape).distinct().join(out.select("doc", "page", "line", "start").hint("merge"), ["doc", "page", "line", "start"], "left_anti")
    return out.union(pointing.select(*shape, F.lit("footnote-reference")))


def fenced(spans: DataFrame, claims: DataFrame, keys: tuple[str, ...] = ("doc", "page", "line")) -> DataFrame:
    """Spans with ``role``: the kind of the claimed range of their line that they share a place with, null where none does.

    ``spans``: keys, start, end, more; ``claims``: keys, start, end, kind. The claims of a line are few and come as one list.
    """
    told = claims.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("_claims"))
    shared = F.filter("_claims", lambda c: (F.col("start") < c["end"]) & (F.col("end") > c["start"]))
    return spans.join(told.hint("merge"), list(keys), "left").withColumn("role", F.get(shared, F.lit(0))["kind"]).drop("_claims")
