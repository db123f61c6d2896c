"""Secrets in whole texts by assignment-aware lexing.

Three base patterns (credential assignments, access key ids, long hex strings) are matched as given. Besides, the text
is lexed as source or configuration: pairs of a name (dotted, quoted, dashed) and what is assigned to it by ``=``,
``:=``, ``=>`` or ``:``, with an optional type between. Literals, concatenations of literals and names of constants
assigned before are resolved, so a literal stored under a harmless name and later given to ``db_password`` is found where
it is written. A literal is scored by the words of the names it reaches and by its own look (length, variety of
characters, placeholders); from ``THRESHOLD`` on it is a span of kind ``literal``, unless a base span holds all of it.

Cases: a null text is empty and has no span; repeated rows give repeated rows; a text without ``=`` and ``:`` is not
lexed; an empty table gives an empty result; other columns are kept, save where a new column has their name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.llm.shared import narrow_batches, sliced

THRESHOLD = 0.6
KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

_PAIR = re.compile(
    r"""(?<![A-Za-z0-9_.\-])(?P<quote>["']?)(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*)(?P=quote)\]?"""
    r"""(?:[ \t]*:[ \t]*[A-Za-z_][A-Za-z0-9_.]*(?:\[[A-Za-z0-9_., ]*\])?[ \t]*(?==[^=]))?"""
    r"""[ \t]*(?::=|=>|=(?!=)|:(?![:/]))[ \t]*"""
)
_LITERAL = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`\n]*`')
_BARE = re.compile(r"[A-Za-z0-9_+/.=\-]+")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*(?=[\"'`A-Za-z_])")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Weight of words, or of words side by side, in a name that a secret is assigned to (fixed values of this scorer).
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.95, "passphrase": 1.0, "secret": 0.95, "token": 0.85, "apikey": 0.95, "api key": 0.95,
    "access key": 0.95, "private key": 1.0, "secret key": 1.0, "signing key": 0.95, "encryption key": 0.95, "auth key": 0.9,
    "credential": 0.85, "credentials": 0.85, "bearer": 0.8, "authorization": 0.75, "client secret": 1.0, "connection string": 0.8,
}
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|_+|true|false|null|none|undefined|changeme|change_me|example|placeholder|your.*|todo|test|<.*>|\$.*|%.*|\{.*)$")


def name_weight(name: str) -> float:
    """The largest weight of a word or two neighbouring words of a name."""
    parts = [w.lower() for w in _WORDS.findall(name)]
    return max((NAME_WEIGHTS.get(w, 0.0) for w in [*parts, *(f"{a} {b}" for a, b in zip(parts, parts[1:]))]), default=0.0)


def literal_weight(value: str) -> float:
    """0 for placeholders and short literals; towards 1 with length and variety of characters."""
    if len(value) < 6 or " " in value.strip() and len(value.split()) > 4 or _PLACEHOLDER.match(value):
        return 0.0
    n = len(value)
    variety = -sum(c / n * math.log2(c / n) for c in map(value.count, set(value)))
    return min(1.0, 0.4 + 0.03 * n) * min(1.0, 0.4 + variety / 5)


def base_spans(text: str) -> list[tuple[str, int, int, int, float, str]]:
    """(kind, start, end, start of the secret itself, score, name), leftmost and non-overlapping per kind."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span(), m.start(2), 1.0, m[1]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span(), m.start(), 1.0, "") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span(), m.start(), 1.0, "") for m in _HEX.finditer(text)]
    return out


def pairs(text: str) -> list[tuple[str, list[tuple[int, int]], str]]:
    """Names with the literals they are assigned: (name, spans of the literals as written, value)."""
    constants: dict[str, tuple[list[tuple[int, int]], str]] = {}
    out, at = [], 0
    while m := _PAIR.search(text, at):
        at, spans, value = m.end(), [], ""
        while True:
            if lit := _LITERAL.match(text, at):
                spans.append((lit.start() + 1, lit.end() - 1))
                value, at = value + lit[0][1:-1], lit.end()
            elif bare := _BARE.match(text, at):
                word = bare[0].rstrip(".=,;") if bare[0].count("=") != len(bare[0]) else ""
                if _NAME.match(word) and word in constants:
                    spans, value = spans + constants[word][0], value + constants[word][1]
                elif not spans and word:
                    spans, value = [(bare.start(), bare.start() + len(word))], word
                else:
                    break
                # a bare word may itself be the name of the next pair ("a: b = c"): look at it again
                at = bare.start() + len(word) if not _PAIR.match(text, bare.start()) else bare.start()
                if at == bare.start():
                    spans, value = [], ""
                    break
            else:
                break
            if not (plus := _PLUS.match(text, at)):
                break
            at = plus.end()
        if spans:
            name = m["name"]
            constants[name] = constants[name.rpartition(".")[2]] = (spans, value)
            out.append((name, spans, value))
    return out


def find(text: str | None) -> list[tuple[str, int, int, int, float, str]]:
    """All spans of a text, by start and then by kind."""
    if not text:
        return []
    out = base_spans(text)
    if "=" in text or ":" in text:
        taken = [(a, b) for _, a, b, *_ in out]
        best: dict[tuple[int, int], tuple[float, str]] = {}
        for name, spans, value in pairs(text):
            weight = name_weight(name)
            score = weight * literal_weight(value) if weight else 0.0
            if score >= THRESHOLD:
                for span in spans:
                    if span[1] > span[0] and score > best.get(span, (0.0, ""))[0]:
                        best[span] = (score, name)
        for (a, b), (score, name) in best.items():
            if not any(x <= a and b <= y for x, y in taken):
                out.append(("literal", a, b, a, round(score, 6), name))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_FIELDS = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret_start", pa.int32()), ("score", pa.float64()), ("name", pa.string())]
_SPANS = pa.list_(pa.struct(_FIELDS))
SPANS = "array<struct<kind:string,start:int,end:int,secret_start:int,score:double,name:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [n for n, _ in _FIELDS]
    for batch in sliced(batches, -1):
        found = [[dict(zip(names, s, strict=True)) for s in find(t)] for t in batch.column(batch.num_columns - 1).to_pylist()]
        kept = batch.select(range(batch.num_columns - 1))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, _SPANS)], names=[*kept.schema.names, "secrets"])


def scan_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``secrets`` (spans by start; code points, end exclusive) of every row."""
    narrow_batches(docs.sparkSession)
    rows = docs.select(*keep, docs[text].cast("string").alias("_secret_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(_scan, f"{schema}, secrets {SPANS}")


def masked(text: str | None, mask: str = "[secret]") -> str | None:
    """The text with what is secret in each span (not the name it is assigned to) replaced once."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for start, end in sorted((s[3], s[2]) for s in spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _mask(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, column):
        yield batch.set_column(column, batch.schema.field(column), pa.array(map(masked, batch.column(column).to_pylist()), batch.schema.field(column).type))


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets of each text masked; all columns and rows stay."""
    from functools import partial

    narrow_batches(docs.sparkSession)
    return docs.mapInArrow(partial(_mask, column=docs.columns.index(text)), docs.schema)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
