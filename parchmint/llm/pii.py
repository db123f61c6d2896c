"""Personal data in whole texts, in DataFrame expressions only.

A pattern proposes spans, a checksum or range test confirms them, and context words within ``WINDOW`` characters before
or after raise a span's score. Patterns are written so that the JVM's matcher neither recurses per repeated group
(possessive groups) nor rescans a run from each of its characters (a match begins where a run or the last match ends),
so cost is linear in the text. Positions come from the texts between matches: their lengths add up in blocks.

Kinds ``email, ip, card, phone`` are kept whatever their score; ``iban`` must pass mod 97 and ``ssn`` needs a context
word to reach ``THRESHOLD``. Cases: a null text is the empty text and has no span; repeated rows give repeated rows;
other columns are kept and the new ones named by ``prefix``; spans of different kinds may overlap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.llm.shared import text_or_empty

WINDOW = 48
THRESHOLD = 0.5
CONTEXT_GAIN = 0.3
_BLOCK = 256


@dataclass(frozen=True)
class Detector:
    kind: str
    hint: str  # without a match of this cheap pattern there is no span
    propose: str
    confirm: Callable[[Column], Column]
    score: float
    context: str
    always: bool = True


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda span: F.length(_digits(span)).between(low, high)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test: every second digit from the right is doubled, 9 less over 9."""
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, first four characters moved to the end and letters written as 10 to 35, is 1 mod 97."""
    compact = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
DETECTORS = (
    Detector("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda s: F.lit(True), 0.9, "mail|contact|write to"),
    Detector("ip", "[0-9]\\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda s: s.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.6, r"\bip\b|address|host|server"),
    Detector("card", "[0-9][0-9 -]{11}", r"[0-9](?:[ -]?[0-9]){12,}+", lambda s: _digit_count(13, 19)(s) & luhn(_digits(s)), 0.7, "card|visa|master|credit|debit|payment"),
    Detector("phone", "\\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", _digit_count(9, 15), 0.6, "phone|tel|call|mobile|fax"),
    Detector("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, 0.8, "iban|account|bank", False),
    Detector("ssn", "[0-9]-[0-9]", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda s: F.lit(True), 0.3, r"\bssn\b|social security|taxpayer", False),
)
BASE_KINDS = ("email", "ip", "card", "phone")


_SPAN = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _around(pieces: Column, found: Column, i: Column, w: int = WINDOW) -> Column:
    """A match with the text before and after it, up to the next match of its kind."""
    before, after = F.get(pieces, i), F.get(pieces, i + 1)
    return F.lower(F.concat(F.right(before, F.lit(w)), F.lit(" "), F.get(found, i), F.lit(" "), F.left(after, F.lit(w))))


def find_pii(docs: DataFrame, column: str = "text", prefix: str = "pii_") -> DataFrame:
    """``docs`` with one array of spans per kind (``prefix`` + kind), by start; code points, end exclusive.

    Each step is a column of its own, named at least twice by the next one, so that no step is written into a lambda and
    computed again for every match. Starts add up the lengths of what stands before: within blocks of ``_BLOCK`` matches
    and over blocks, so a text with very many matches costs far less than their square.
    """
    text, none = text_or_empty(F.col(column).cast("string")), F.array().cast("array<string>")
    name = lambda d, part: f"_{prefix}{d.kind}_{part}"
    col = lambda d, part: F.col(name(d, part))
    block = lambda j: F.floor(j / _BLOCK).cast("int")

    def step(df: DataFrame, part: str, of: Callable[[Detector], Column]) -> DataFrame:
        return df.withColumns({name(d, part): of(d) for d in DETECTORS})

    def found(d: Detector) -> Column:
        hint = text.contains(d.hint) if d.hint == "@" else text.rlike(d.hint)
        return F.when(hint, F.regexp_extract_all(text, F.lit(d.propose), F.lit(0))).otherwise(none)

    def sums(d: Detector) -> Column:
        s = col(d, "steps")
        every = F.transform(F.sequence(F.lit(0), block(F.size(s) - 1)), lambda i: _total(F.slice(s, i * _BLOCK + 1, F.lit(_BLOCK))))
        return F.when(F.size(s) > 0, every).otherwise(F.array().cast("array<int>"))

    def starts(d: Detector) -> Column:
        s, base = col(d, "steps"), col(d, "bases")
        inner = lambda j: _total(F.slice(s, block(j) * _BLOCK + 1, (j % _BLOCK).cast("int")))
        every = F.transform(col(d, "gaps"), lambda g, j: g + F.get(base, block(j)) + inner(j))
        return F.when((F.size(base) > 0) & (F.size(s) > 0), every).otherwise(F.array().cast("array<int>"))

    def spans(d: Detector) -> Column:
        m, pieces = col(d, "found"), col(d, "pieces")
        score = lambda i: F.least(F.lit(d.score) + F.when(_around(pieces, m, i).rlike(d.context), CONTEXT_GAIN).otherwise(0.0), F.lit(1.0))
        one = lambda s, i: F.struct(F.lit(d.kind).alias("kind"), s.alias("start"), (s + F.length(F.get(m, i))).alias("end"), F.get(m, i).alias("text"), score(i).alias("score"))
        every = F.transform(col(d, "starts"), one)
        return F.filter(every, lambda x: d.confirm(x["text"]) & (F.lit(d.always) | (x["score"] >= THRESHOLD))).cast(_SPAN)

    out = step(docs, "found", found)
    out = step(out, "pieces", lambda d: F.when(F.size(col(d, "found")) > 0, F.split(text, d.propose, -1)).otherwise(none))
    out = step(out, "gaps", lambda d: F.transform(F.slice(col(d, "pieces"), 1, F.size(col(d, "found"))), F.length))
    out = step(out, "steps", lambda d: F.zip_with(col(d, "gaps"), col(d, "found"), lambda g, m: g + F.length(m)))
    out = step(out, "sums", sums)
    out = step(out, "bases", lambda d: F.transform(col(d, "sums"), lambda _, i: _total(F.slice(col(d, "sums"), F.lit(1), i))))
    out = step(out, "starts", starts)
    out = out.withColumns({prefix + d.kind: spans(d) for d in DETECTORS})
    return out.drop(*(name(d, part) for d in DETECTORS for part in ("found", "pieces", "gaps", "steps", "sums", "bases", "starts")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with each confirmed span replaced by its kind in brackets, kind by kind in the order of DETECTORS."""
    out = docs
    for d in DETECTORS:
        found = find_pii(out.withColumn("_pii_text", F.col(column)), "_pii_text", "_pii_")
        text, spans = text_or_empty("_pii_text"), F.col("_pii_" + d.kind)
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        begins = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
        kept = F.zip_with(ends, begins, lambda a, b: F.substring(text, a + 1, b - a))
        clean = F.when(F.size(spans) > 0, F.array_join(kept, f"[{d.kind}]")).otherwise(F.col("_pii_text"))
        out = found.withColumn(column, clean).select(*docs.columns)
    return out
