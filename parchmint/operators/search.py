"""Finding text on printed lines however it is printed: letter case, digit grouping, accounting brackets, dashes and dates.

A line and a query are brought to one form, and every character of the line's form knows where it was printed, so hits are
given at their printed places. Lines run through an Arrow kernel behind a native test for the query's rarest plain part.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import date
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import vocab

_MONTHS = {m[:n]: i for i, m in enumerate(vocab.MONTHS, 1) for n in {3, len(m)}} | {"sept": 9}
_MONTH = "(?:" + "|".join(sorted(_MONTHS, key=len, reverse=True)) + r")\.?"
#: Day dates at one place, by the first form that fits: year first, month/day/year, day month year, month day, year.
_DATE = re.compile(
    r"(?P<y1>\d{4})(?P<s>[-/])(?P<m1>\d{1,2})[-/](?P<d1>\d{1,2})|(?P<y2>\d{4})(?P<m2>\d\d)(?P<d2>\d\d)|(?P<m3>\d{1,2})[-/](?P<d3>\d{1,2})[-/](?P<y3>\d{4}|\d\d)"
    rf"|(?P<d4>\d{{1,2}})(?:st|nd|rd|th)?\s+(?P<m4>{_MONTH}),?\s+(?P<y4>\d{{4}})|(?P<m5>{_MONTH})\s+(?P<d5>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y5>\d{{4}})"
)
_BRACKETED = re.compile(r"\((?=[\d,.]*\d)([\d,.]+)\)")
_GROUPING = re.compile(r"(?<=\d),(?=\d)")
_ZERO_DASH = re.compile(r"(?<![^\s$])—(?!\S)")
_IN_BRACKETS = re.compile(r"\(\s*\d[\d,.\s]*\)")


def folded(text: str) -> str:
    """Lower case, character by character: none grows."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def day_date(text: str, at: int) -> tuple[int, str] | None:
    """(end, m/d/yyyy) of a day that stands at a place as a token of its own; an impossible day is none."""
    m = _DATE.match(text, at)
    if m is None or at and _joins(text[at - 1]) or m.end() < len(text) and _joins(text[m.end()]):
        return None
    form = next(n for n in "12345" if m["y" + n])
    month, year = m["m" + form], int(m["y" + form])
    month = int(month) if month.isdigit() else _MONTHS[month.rstrip(".")]
    if len(m["y" + form]) == 2:
        year += 2000 if year <= 49 else 1900
    try:
        day = date(year, month, int(m["d" + form]))
    except ValueError:
        return None
    return m.end(), f"{day.month}/{day.day}/{day.year}"


def _joins(c: str) -> bool:
    return c.isascii() and c.isalnum()


def normal_form(text: str, dates: bool = False) -> tuple[str, list[int]]:
    """A line as it is matched, and where each of its characters was printed.

    (1,234) becomes -1234, a dash alone becomes 0, digit-group commas go, and with ``dates`` days become m/d/yyyy, whose
    characters are spread over the printed date.
    """
    low = folded(text)
    shown: list[str | None] = list(low)
    for m in _BRACKETED.finditer(low):
        shown[m.start()], shown[m.end() - 1] = "-", None
    for m in _GROUPING.finditer(low):
        shown[m.start()] = None
    for m in _ZERO_DASH.finditer(low):
        shown[m.start()] = "0"
    out, places, at = [], [], 0
    while at < len(low):
        if dates and (low[at].isdigit() or low[at : at + 3] in _MONTHS) and (found := day_date(low, at)):
            end, day = found
            step = (end - at - 1) / (len(day) - 1)
            out.append(day)
            places += [at + round(j * step) for j in range(len(day))]
            at = end
            continue
        if shown[at] is not None:
            out.append(shown[at])
            places.append(at)
        at += 1
    return "".join(out), places


def bare_end(text: str) -> str:
    """A text less the marks at its end; the bracket of a bracketed figure stays."""
    t = text.rstrip()
    while t and unicodedata.category(t[-1]).startswith("P") and not (t[-1] == ")" and _IN_BRACKETS.fullmatch(t)):
        t = t[:-1].rstrip()
    return t


def normal_query(raw: str, dates: bool = False) -> str:
    return bare_end(normal_form(raw.strip(), dates)[0])


def cleaned_query(raw: str) -> str:
    """A query that came from elsewhere: no invisible, control or currency characters, white space collapsed."""
    kept = re.sub("[\u200b-\u200d\u2060\ufeff]", "", raw)
    kept = "".join(" " if unicodedata.category(c) == "Cc" else "" if unicodedata.category(c) == "Sc" else c for c in kept)
    return bare_end(" ".join(kept.split()))


def hits(text: str | None, query: str, dates: bool = False) -> list[dict]:
    """Every place of a line where a query in normal form stands, overlapping ones too: printed start and end, the token
    around it less marks at its end, and whether that token is all that was asked for."""
    if not text or not query:
        return []
    form, places = normal_form(text, dates)
    out, at = [], form.find(query)
    while at >= 0:
        start, end = places[at], places[at + len(query) - 1] + 1
        if (m := _BRACKETED.match(text, start)) and m.end() - 1 >= end:
            end = m.end()
        left = start
        while left and not text[left - 1].isspace():
            left -= 1
        right = end
        while right < len(text) and not text[right].isspace():
            right += 1
        token, keep = text[left:right], right
        while keep > end and unicodedata.category(text[keep - 1]).startswith("P") and not (text[keep - 1] == ")" and _IN_BRACKETS.fullmatch(token)):
            keep -= 1
        out.append({"start": start, "end": end, "token": text[left:keep], "exact": normal_query(token, dates) == query})
        at = form.find(query, at + 1)
    return out


_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string()), ("exact", pa.bool_())]))


def _kernel(batches: Iterator[pa.RecordBatch], query: str, dates: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [hits(t, query, dates) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _HITS)], names=[*batch.schema.names[:-1], "hits"])


def found(lines: DataFrame, query: str, keep: tuple[str, ...] = ("doc", "line"), dates: bool = False) -> DataFrame:
    """(keep, start, end, token, exact): every hit of a query on the lines; ``lines`` has text.

    Only lines that hold all letter runs of the query reach the kernel (figures and dates may be printed otherwise).
    """
    q = normal_query(query, dates)
    rows = lines.select(*keep, F.col("text").cast("string").alias("_line"))
    for word in () if dates else re.findall(r"[a-z]+", q):
        rows = rows.where(F.lower("_line").contains(word))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    out = rows.mapInArrow(partial(_kernel, query=q, dates=dates), f"{schema}, hits array<struct<start:int,end:int,token:string,exact:boolean>>")
    return out.select(*keep, F.explode("hits").alias("h")).select(*keep, "h.start", "h.end", "h.token", "h.exact")


def with_aliases(hits_: DataFrame, values: DataFrame, query: str) -> DataFrame:
    """Hits, and printed magnitudes that mean the query: "1200000000" finds "$1.2 billion" too.

    ``values``: keep columns, id, start, end, text, normalized, magnitude. A value where a hit stands already adds none, and
    its own printed form adds none where that was found as text.
    """
    q = normal_query(query)
    bare = F.regexp_replace(F.col("text"), r"(?i)^\s*(?:" + "|".join([*vocab.CURRENCY_CODES, "[" + "".join(vocab.CURRENCY_SYMBOLS) + "]"]) + r")\s*", "")
    same = (F.lower(F.col("text")) == q) | (F.lower(bare) == q)
    keep = [c for c in hits_.columns if c not in ("start", "end", "token", "exact")]
    meant = values.where(F.col("magnitude").isNotNull() & F.col("normalized").isNotNull()).withColumn("same", same).where((F.col("normalized") == q) | F.col("same"))
    meant = meant.join(hits_.select(*keep, "start", "end"), [*keep, "start", "end"], "left_anti")
    shown = hits_.select(*keep, F.lower("token").alias("token")).distinct()
    meant = meant.withColumn("token", F.lower("text")).join(shown.withColumn("there", F.lit(True)), [*keep, "token"], "left").where(~(F.col("same") & F.coalesce("there", F.lit(False))))
    return hits_.unionByName(meant.select(*keep, "start", "end", F.col("text").alias("token"), F.lit(True).alias("exact")))


def zero_placeholder(text: Column) -> Column:
    """A text that is nothing but a dash, with a currency sign or without, as zero."""
    return F.when(text.rlike(r"^\s*(?:\$\s*)?—\s*$"), F.replace(text, F.lit("—"), F.lit("0"))).otherwise(text)


def ranked(hits_: DataFrame, order: list[str], doc: str = "doc", after: int = 0, limit: int | None = None) -> DataFrame:
    """Hits ranked, exact ones before partial ones, each by document and then ``order``; ``after`` and ``limit`` page on.

    Ranks are counted within documents; what stands before a document is summed over ranges of documents, so no task holds
    a row per document.
    """
    own = hits_.withColumn("nth", F.row_number().over(Window.partitionBy("exact", doc).orderBy(*order)))
    sizes = own.groupBy("exact", doc).agg(F.count("*").alias("n"))
    cuts = sizes.agg(F.percentile_approx(doc, [i / 64 for i in range(1, 64)])).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(doc))) if cuts else F.lit(0)
    sizes = sizes.withColumn("part", part)
    whole = sizes.groupBy("exact", "part").agg(F.sum("n").alias("in_part"))
    ahead = Window.orderBy(F.col("exact").desc(), "part").rowsBetween(Window.unboundedPreceding, -1)  # 128 rows
    whole = whole.select("exact", "part", F.coalesce(F.sum("in_part").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("exact", "part").orderBy(doc).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(F.broadcast(whole), ["exact", "part"]).select("exact", doc, (F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("start_rank"))
    out = own.join(starts, ["exact", doc]).withColumn("rank", F.col("start_rank") + F.col("nth")).drop("start_rank", "nth")
    return out.where(F.col("rank") > after) if limit is None else out.where(F.col("rank").between(after + 1, after + limit))
