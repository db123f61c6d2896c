"""What a printed text becomes in a cell, and how a cell's value is printed: dates, numbers, readings, formats."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions import vocab
from parchmint.functions.scalars import bound, collapsed

_NAMES = {m: i for i, m in enumerate(vocab.MONTHS, 1)} | {m[:3]: i for i, m in enumerate(vocab.MONTHS, 1)} | {"sept": 9}
_EPOCH = "1899-12-30"


def _looked_up(word: Column, table: dict[str, float], otherwise: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for name, value in table.items() for x in (name, value)])
    return F.coalesce(F.try_element_at(pairs, F.lower(word)), otherwise)


def _month(name: Column) -> Column:
    return _looked_up(F.regexp_replace(name, r"\.$", ""), _NAMES, F.lit(None).cast("int"))


def _day(y: Column, m: Column, d: Column) -> Column:
    """A date where the calendar has it."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")), "yyyy-MM-dd")


def auto_date(text: Column) -> Column:
    """(value, kind) of a text that is one date: a quarter or a month gives its first day; null otherwise.

    Forms, in order: Q3 2025 or 2025-Q3; 2025-9-27 or 20250927; 9/27/25 (month first; two-digit years up to 49 are 20xx);
    Sep 27, 2025 or 27 Sep 2025; September 2025.
    """
    plain = F.regexp_replace(collapsed(text), r"(?i)(?<=[0-9])(?:st|nd|rd|th)\b", "")
    return bound(plain, lambda t: F.when(t.rlike("[0-9]"), _one_date(t)))  # every form has digits


def _one_date(t: Column) -> Column:
    g = lambda p, i: F.regexp_extract(t, p, i)
    made = lambda value, kind, form: F.when(t.rlike(form), bound(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(kind).alias("kind")))))
    n = lambda c: c.try_cast("int")
    quarter = r"(?i)^(?:Q([1-4]) ?[-/]? ?([0-9]{4})|([0-9]{4}) ?[-/]? ?Q([1-4]))$"
    q = n(F.concat(g(quarter, 1), g(quarter, 4)))
    of_quarter = _day(n(F.concat(g(quarter, 2), g(quarter, 3))), q * 3 - 2, F.lit(1))
    iso = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})$"
    compact = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
    us = r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4}|[0-9]{2})$"
    year = n(g(us, 3))
    year = F.when(F.length(g(us, 3)) == 2, F.when(year <= 49, year + 2000).otherwise(year + 1900)).otherwise(year)
    mdy, dmy, my = r"^([A-Za-z]+\.?) ([0-9]{1,2}),? ([0-9]{4})$", r"^([0-9]{1,2}) ([A-Za-z]+\.?),? ([0-9]{4})$", r"^([A-Za-z]+\.?) ([0-9]{4})$"
    return F.coalesce(
        made(of_quarter, "quarter", quarter), made(_day(n(g(iso, 1)), n(g(iso, 2)), n(g(iso, 3))), "day", iso), made(_day(n(g(compact, 1)), n(g(compact, 2)), n(g(compact, 3))), "day", compact),
        made(_day(year, n(g(us, 1)), n(g(us, 2))), "day", us), made(_day(n(g(mdy, 3)), _month(g(mdy, 1)), n(g(mdy, 2))), "day", mdy),
        made(_day(n(g(dmy, 3)), _month(g(dmy, 2)), n(g(dmy, 1))), "day", dmy), made(_day(n(g(my, 2)), _month(g(my, 1)), F.lit(1)), "month", my),
    )


def sheet_day(value: Column) -> Column:
    """A date as a sheet counts days."""
    return F.datediff(value, F.lit(_EPOCH).cast("date"))


def date_format_of(kind: Column) -> Column:
    return F.when(kind == "month", "mmmm yyyy").when(kind == "quarter", '"Q"q yyyy').otherwise("m/d/yyyy")


_MAGNITUDE = "(" + "|".join(sorted(vocab.MAGNITUDES, key=len, reverse=True)) + ")"
_FIGURE = r"([0-9,]+(?:\.[0-9]+)?)"


def _scale(word: Column) -> Column:
    return _looked_up(word, {name: float(value) for name, value in vocab.MAGNITUDES.items()}, F.lit(1.0))


def places_left(figure: Column, percent: Column, scale: Column) -> Column:
    """Decimal places to show: those printed; a magnitude moves one into the whole part for each power of ten."""
    printed = F.length(F.regexp_extract(figure, r"\.([0-9]+)$", 1))
    return F.when(percent, printed).otherwise(F.greatest(printed - F.round(F.log10(scale)).cast("int"), F.lit(0)))


def one_number(text: Column) -> Column:
    """(value, grouped, places, brackets, percent, scale) of a text that is one number, white space and a leading currency
    aside: (4)%'s bracket closes after the sign, "(1.5%)"; a percentage is its fraction; brackets are negative."""
    currency = "(?:" + "|".join([*vocab.CURRENCY_CODES, "[" + "".join(vocab.CURRENCY_SYMBOLS) + "]"]) + ")"
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", ""), rf"(?i)^(\()?([+-]?){currency}", "$1$2")
    g = F.regexp_extract
    forms = ((rf"^\({_FIGURE}%\)$", True, True, False), (rf"(?i)^\({_FIGURE}{_MAGNITUDE}?\)$", True, False, True), (r"^([+-]?[0-9,]+(?:\.[0-9]+)?)%$", False, True, False), (rf"(?i)^([+-]?[0-9,]+(?:\.[0-9]+)?){_MAGNITUDE}?$", False, False, True))
    return bound(bare, lambda t: F.coalesce(*[F.when(t.rlike(p), _number(g(t, p, 1), g(t, p, 2) if scaled else F.lit(""), brackets, percent)) for p, brackets, percent, scaled in forms]))


def _number(figure: Column, word: Column, brackets: bool, percent: bool) -> Column:

    def made(n: Column) -> Column:
        value = n["value"] / 100 if percent else n["value"] * n["scale"]
        fields = F.struct((-value if brackets else value).alias("value"), (n["figure"].contains(",") | (n["scale"] > 1)).alias("grouped"), places_left(n["figure"], F.lit(percent), n["scale"]).cast("int").alias("places"), F.lit(brackets).alias("brackets"), F.lit(percent).alias("percent"), n["scale"].alias("scale"))
        return F.when(n["value"].isNotNull(), fields)

    read = lambda f: F.struct(f.alias("figure"), F.regexp_replace(f, ",", "").try_cast("double").alias("value"), _scale(word).alias("scale"))
    return bound(figure, lambda f: bound(read(f), made))


def auto_value(text: Column) -> Column:
    """(kind, number, text, format) of what a text becomes in a cell: a day count, a number, or literal text that no sheet
    takes for a formula."""
    literal = lambda t: F.when(t.rlike(r"^[=+@-]"), F.concat(F.lit("'"), t)).otherwise(t)
    none = F.lit(None)
    a_day = lambda d: F.when(d.isNotNull(), F.struct(F.lit("date").alias("kind"), sheet_day(d["value"]).cast("double").alias("number"), none.cast("string").alias("text"), date_format_of(d["kind"]).alias("format")))
    a_number = lambda n: F.when(n.isNotNull(), F.struct(F.lit("number").alias("kind"), n["value"].alias("number"), none.cast("string").alias("text"), none.cast("string").alias("format")))
    words = F.struct(F.lit("text").alias("kind"), none.cast("double").alias("number"), bound(collapsed(text), literal).alias("text"), none.cast("string").alias("format"))
    return F.coalesce(bound(auto_date(text), a_day), bound(one_number(text), a_number), words)


_PASSES = (
    (re.compile(r"\(([\d,]+(?:\.\d+)?)%\)"), True, True),
    (re.compile(rf"\(([\d,]+(?:\.\d+)?)\s*(?:{_MAGNITUDE})?\)", re.I), True, False),
    (re.compile(r"\b([\d,]+(?:\.\d+)?)%"), False, True),
    (re.compile(rf"\b([\d,]+(?:\.\d+)?)\s*(?:{_MAGNITUDE})?\b", re.I), False, False),
)
NUMBERS = "array<struct<start:int,value:double,grouped:boolean,places:int,brackets:boolean,percent:boolean>>"
_NUMBERS = pa.list_(pa.struct([("start", pa.int32()), ("value", pa.float64()), ("grouped", pa.bool_()), ("places", pa.int32()), ("brackets", pa.bool_()), ("percent", pa.bool_())]))


def numbers_in(text: str | None) -> list[dict]:
    """Every number of a text by place: bracketed percentages first, then bracketed figures, percentages and plain ones, none
    within what an earlier pass took. A bare minus isn't read."""
    out, taken = [], []
    for pattern, brackets, percent in _PASSES:
        for m in pattern.finditer(text or ""):
            digits = m[1].replace(",", "")
            if any(a <= m.start() < b for a, b in taken) or not digits or digits == ".":
                continue
            scale = 1 if percent or not m[2] else vocab.MAGNITUDES[m[2].lower()]
            places = len(digits.partition(".")[2])
            value = float(digits) / 100 if percent else float(digits) * scale
            shift = 0 if percent else len(str(scale)) - 1
            out.append({"start": m.start(), "value": -value if brackets else value, "grouped": "," in m[1] or scale > 1, "places": max(0, places - shift), "brackets": brackets, "percent": percent})
            taken.append(m.span())
    return sorted(out, key=lambda n: n["start"])


def _numbers_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [numbers_in(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _NUMBERS)], names=[*batch.schema.names[:-1], "numbers"])


def with_numbers(rows: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep`` and ``numbers`` of every row."""
    kept = rows.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])
    return kept.mapInArrow(_numbers_kernel, f"{schema}, numbers {NUMBERS}")


def number_sum(numbers: Column) -> Column:
    """What a text adds to a sum; null where it has no number."""
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, n: a + n["value"]))


def shared_format(numbers: Column) -> Column:
    """(grouped, places, brackets, percent) that shows all numbers: any flag, most places."""
    flag = lambda n: F.exists(numbers, lambda x: x[n]).alias(n)
    return F.when(F.size(numbers) > 0, F.struct(flag("grouped"), F.array_max(F.transform(numbers, lambda x: x["places"])).alias("places"), flag("brackets"), flag("percent")))


def ocr_date(raw: Column) -> Column:
    """Digits and slashes of a reading as a date; eight digits are mm/dd/yyyy; 1900 to 2100; null where it is none."""
    kept = F.regexp_replace(raw, "[^0-9/]", "")
    digits = F.regexp_replace(kept, "/", "")
    shown = F.when(F.length(digits) == 8, F.concat_ws("/", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 4))).otherwise(kept)
    form = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    y, m, d = (F.regexp_extract(shown, form, i).try_cast("int") for i in (3, 1, 2))
    return F.when(shown.rlike(form) & y.between(1900, 2100) & _day(y, m, d).isNotNull(), shown)


# What the words of a column's header say of its cells, the first that fits.
COLUMN_KINDS = (
    ("date", ("date",)), ("number", ("count", "quantity", "number", "employees", "noof")), ("percentage", ("rate", "percent")),
    ("currency", ("amount", "balance", "price", "cost", "total")), ("status", ("status",)), ("city", ("city",)),
)


def column_kind(header: Column) -> Column:
    key, out = F.regexp_replace(F.lower(header), "[^a-z0-9]", ""), F.lit("text")
    for kind, words in reversed(COLUMN_KINDS):
        out = F.when(key.rlike("|".join(words)), kind).otherwise(out)
    return out


def repaired_separators(text: Column) -> Column:
    """$1.234.56 can only be $1,234.56; anything less certain stays."""
    whole = F.regexp_extract(text, r"^(\$[0-9]{1,3}(?:\.[0-9]{3})+)\.[0-9]{2}$", 1)
    return F.when(whole != "", F.concat(F.replace(whole, F.lit("."), F.lit(",")), F.regexp_extract(text, r"(\.[0-9]{2})$", 1))).otherwise(text)


def cleaned_reading(text: Column) -> Column:
    """A recognised text less what recognition adds: replacement characters, dashes of other widths, edge marks, spaces
    before punctuation."""
    t = F.regexp_replace(F.translate(text, "�—–", " --"), r"\s+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"^[ |_-]+", ""), r"[ |_-]+$", "")
    return F.trim(F.regexp_replace(t, r"\s+([,.;:])", "$1"))


def looks_numeric(text: Column) -> Column:
    """Whether a cell's text is a number once group commas and percent signs are off."""
    t = F.regexp_replace(F.trim(text), "[,%]", "")
    return t.rlike(r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$")


def places_of_format(fmt: Column) -> Column:
    """Decimal places of a sheet's number format: those of its first section."""
    return F.length(F.regexp_extract(F.split(fmt, ";")[0], r"\.([0#?]+)", 1))


def shown_number(value: Column, fmt: Column) -> Column:
    """A number as its sheet format prints it: percent, grouping, places, currency; General as short as it goes."""
    plain = fmt.isNull() | fmt.isin("", "General", "@")
    percent, grouped = fmt.contains("%"), fmt.rlike("#,#|#,0|0,0")
    v, places = F.when(percent, value * 100).otherwise(value), places_of_format(fmt)
    text = F.when(grouped, F.call_function("format_number", v, places.cast("int"))).otherwise(F.call_function("printf", F.concat(F.lit("%."), places.cast("string"), F.lit("f")), v))
    mark = F.regexp_extract(fmt, r"([$£€¥₹]|\[\$[^\]]*\])", 1)
    symbol = F.when(mark.startswith("[$"), F.regexp_extract(mark, r"^\[\$([^\]-]*)", 1)).otherwise(mark)
    money = F.when(text.startswith("-"), F.concat(F.lit("-"), symbol, F.substring(text, 2, 400))).otherwise(F.concat(symbol, text))
    short = F.regexp_replace(F.regexp_replace(F.call_function("printf", F.lit("%.10f"), value), "0+$", ""), r"\.$", "")
    return F.when(plain, short).when(percent, F.concat(text, F.lit("%"))).when(symbol != "", money).otherwise(text)


def shown_time(value: Column, fmt: Column) -> Column:
    """A time stamp as its sheet format means it: a time, a day, or both."""
    low = F.lower(F.coalesce(fmt, F.lit("")))
    day, time = low.rlike("[yd]|mmm"), low.rlike("[hs]")
    clock = F.when(low.contains("s"), F.date_format(value, "HH:mm:ss")).otherwise(F.date_format(value, "HH:mm"))
    return F.when(time & ~day, clock).when(time, F.date_format(value, "yyyy-MM-dd HH:mm")).otherwise(F.date_format(value, "yyyy-MM-dd"))


def is_dash(words: Column) -> Column:
    """Whether a cell's words, currency and footnote marks aside, are nothing but dashes."""
    kept = F.filter(words, lambda w: ~w.rlike(r"^(?:[$€£¥₹₩*†‡§¶%()]+|\([0-9a-z]\))$"))
    return (F.size(kept) > 0) & F.forall(kept, lambda w: w.rlike("^[‐-―-]+$"))
