"""What headings say: items, parts and notes, their identifiers and titles, as Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmint.functions.scalars import bound

# Small words that don't count when a title's capitals do, and the marks trimmed from a title's ends.
TITLE_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with", "without")
TITLE_EDGES = " \t“”‘’\"'"
TITLE_CHARS, TITLE_MOST_WORDS, TITLE_SHARE = 180, 24, 0.7
#: A heading's number: an item's, and a note's (dotted digits or Roman).
ITEM_ID = r"[0-9]{1,3}(?:\.[0-9]{1,2})?[A-Za-z]?"
NOTE_ID = r"(?:[0-9]+(?:\.[0-9]+)*|[IVXLCDMivxlcdm]+)"
_GOES_ON = r"(?i)\s*[\[(]?\s*(?:continued|cont'd|contd?\.?)\s*[\])]?\s*$"
_SEPARATOR = r"^\s*[.:–—-]\s*"
_LEADERS = r"[\s.·•‧∙…_-]*(?:[.·•‧…]\s*){3,}\s*$"
_OF_RULES = r"(?i)^(?:\([^()]{1,12}\))*\s*(?:of|under|to)\s+(?:regulation|reg\.|rule|form)\b"


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i)


def trimmed(text: Column) -> Column:
    """White space and quotation marks off both ends."""
    marks = "[" + TITLE_EDGES + r"\s]"
    return F.regexp_replace(F.regexp_replace(text, f"^{marks}+", ""), f"{marks}+$", "")


def without_leaders(text: Column) -> Column:
    """A contents entry less the run of dots that leads to its page number."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _LEADERS, ""))


def goes_on(text: Column) -> Column:
    """Whether a heading is marked as continued."""
    return text.rlike(_GOES_ON)


def heading_title(rest: Column) -> Column:
    """What follows a heading's number: less its separator, the mark of continuation and quotation marks."""
    return trimmed(F.regexp_replace(F.trim(F.regexp_replace(rest, _SEPARATOR, "")), _GOES_ON, ""))


def is_title(text: Column, separated: Column | None = None) -> Column:
    """At most 180 characters and 24 words, no question, exclamation or sentence; and seven in ten of its words that mean
    something capitalised, unless a printed separator ``separated`` already shows a heading. Nothing at all is a title."""
    meant_of = lambda words: F.filter(words, lambda w: ~F.lower(w).isin(*TITLE_WORDS))
    capital = lambda meant: F.size(F.filter(meant, lambda w: w.rlike(r"^\p{Lu}")))
    shown = lambda words: bound(meant_of(words), lambda m: (F.size(m) > 0) & (capital(m) >= TITLE_SHARE * F.size(m)))
    told = lambda words: F.size(words).between(1, TITLE_MOST_WORDS) & (shown(words) if separated is None else separated | shown(words))
    words_of = lambda t: F.regexp_extract_all(t, F.lit(r"\p{L}+"), F.lit(0))
    return bound(F.trim(text), lambda t: (t == "") | (F.length(t) <= TITLE_CHARS) & ~t.rlike(r"[?!;.]$") & bound(words_of(t), told))


def roman(raw: Column) -> Column:
    """A valid Roman number in upper case, else null."""
    up = F.upper(F.trim(raw))
    return F.when((up != "") & up.rlike("^M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$"), up)


def item_id(raw: Column) -> Column:
    """``01a`` is ``1A``; a minor stays as printed (``2.02``); null where there is no item of that number."""
    major = _group(raw, r"^([0-9]{1,3})(?:\.[0-9]{1,2})?[A-Za-z]?$", 1).try_cast("int")
    rest = F.upper(_group(raw, r"^[0-9]{1,3}((?:\.[0-9]{1,2})?[A-Za-z]?)$", 1))
    return F.when(major.between(1, 999), F.concat(major.cast("string"), rest))


def note_id(raw: Column) -> Column:
    """Dotted digits without leading zeros, the first part at most 999; or a Roman number."""
    digits = raw.rlike(r"^[0-9]+(?:\.[0-9]+)*$")
    parts = F.transform(F.split(raw, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.get(parts, F.lit(0)).try_cast("int") <= 999
    return F.when(digits, F.when(small, F.array_join(parts, "."))).otherwise(roman(raw))


def _heading(number: Column, rest: Column, refused: Column, strict: Column | None = None) -> Column:
    """(id, title, continued) where number and title are those of a heading."""

    def made(h: Column) -> Column:
        separated = h["rest"].rlike(_SEPARATOR)
        fine = h["continued"] | is_title(h["title"], separated if strict is None else separated & ~strict)
        return F.when(~h["refused"] & ~F.trim(h["rest"]).startswith(",") & fine, F.struct(h["id"].alias("id"), h["title"].alias("title"), h["continued"].alias("continued")))

    read = lambda h: F.struct(h["id"].alias("id"), h["rest"].alias("rest"), h["refused"].alias("refused"), heading_title(h["rest"]).alias("title"), goes_on(h["rest"]).alias("continued"))
    return bound(F.struct(number.alias("id"), rest.alias("rest"), refused.alias("refused")), lambda h: F.when(h["id"].isNotNull(), bound(read(h), made)))


def item_heading(text: Column) -> Column:
    """``Item 1A. Risk Factors`` as (id, title, continued); null for prose, lists and items of rules ("of Regulation S-K")."""
    pattern = rf"(?i)^\s*item\s+({ITEM_ID})\b(.*?)\s*$"
    parts = F.struct(_group(text, pattern, 1).alias("id"), _group(text, pattern, 2).alias("rest"))
    return F.when(text.rlike(r"(?i)^\s*item\s"), bound(parts, lambda p: _heading(item_id(p["id"]), without_leaders_kept(p["rest"]), p["rest"].rlike(_OF_RULES))))


def without_leaders_kept(rest: Column) -> Column:
    """Leaders off; the white space before the title, which tells a separator, stays."""
    return F.regexp_replace(rest, _LEADERS, "")


def part_heading(text: Column) -> Column:
    """The Roman number of a line that is a part's heading, alone or with the part's name; else null."""
    pattern = r"(?i)^\s*part\s+([IVXLCDM]{1,6})\b([\s.–—:-]*)(.*?)\s*$"
    made = lambda rest: F.when(~rest.startswith(",") & is_title(without_leaders(rest)), roman(_group(text, pattern, 1)))
    return F.when(text.rlike(r"(?i)^\s*part\s"), bound(_group(text, pattern, 3), made))


def note_heading(text: Column, bare_allowed: Column | None = None) -> Column:
    """``Note 3 — Leases`` as (id, title, continued, explicit); ``3. Leases`` too where bare numbers may head a note."""
    named, bare = rf"(?i)^\s*note\s+({NOTE_ID})(?![0-9A-Za-z])(.*?)\s*$", rf"^\s*({NOTE_ID})(?![0-9A-Za-z]|\.[0-9])((?:\s*[.:–—-]|\s).*?|)\s*$"
    full = F.when(text.rlike(r"(?i)^\s*note\s"), bound(_group(text, named, 1), lambda raw: _heading(note_id(raw), _group(text, named, 2), F.lit(False))))
    told = lambda h, e: F.struct(h["id"].alias("id"), h["title"].alias("title"), h["continued"].alias("continued"), F.lit(e).alias("explicit"))
    one = lambda heading, e, fits=lambda h: F.lit(True): bound(heading, lambda h: F.when(h.isNotNull() & fits(h), told(h, e)))
    if bare_allowed is None:
        return one(full, True)
    short = bound(_group(text, bare, 1), lambda raw: _heading(note_id(raw), _group(text, bare, 2), F.lit(False), strict=F.lit(True)))
    return F.coalesce(one(full, True), F.when(bare_allowed & ~text.rlike(named), one(short, False, lambda h: h["title"] != "")))


def opens_notes(text: Column) -> Column:
    """Whether a line opens the notes of a report."""
    return text.rlike(r"(?i)\bnotes?\s+to\s+(?:the\s+)?(?:consolidated\s+)?financial statements\b")


def title_after(rest: Column) -> Column:
    """(title, length) printed right after a citation: quoted, or a title up to the next mark; length 0 where there is none."""
    lead = _group(rest, r"^(\s*[,:–—-]\s*)", 1)
    body = F.substring(rest, F.length(lead) + 1, F.length(rest))
    quoted = F.coalesce(*[F.when(body.rlike(p), _group(body, p, 1)) for p in (r'^("[^"]*")', r"^('[^']*')", "^(“[^”]*”)", "^(‘[^’]*’)")])
    inner = F.trim(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    plain = _group(body, r"^([^,;.)]*)", 1)
    shown = trimmed(plain)
    found = F.when(quoted.isNotNull() & (inner != ""), F.struct(inner.alias("title"), (F.length(lead) + F.length(quoted)).alias("length")))
    told = F.when(quoted.isNull() & (shown != "") & is_title(shown), F.struct(shown.alias("title"), (F.length(lead) + F.length(plain)).alias("length")))
    none = F.struct(F.lit("").alias("title"), F.lit(0).alias("length"))
    return F.when(lead == "", none).otherwise(F.coalesce(found, told, none))
