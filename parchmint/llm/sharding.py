"""Sharding by histogram sort: equal bytes per shard, splitters from exact counts, one exchange.

Rows are ordered by (xxhash64 of the text, doc_id, crc32 of the text), so equal texts lie side by side. Splitters are the
keys below which k/shards of all bytes lie. They are found by refining: every open target has an interval of keys; each
round counts the exact bytes and rows in ``PROBES`` equal slices of every interval, all partitions at once with partial
sums before the exchange, and keeps the slice that holds the target, until the counts at one of its ends are within
``TOLERANCE`` of a shard's bytes. When the hash can't be cut further, a group of copies that straddles a target and weighs
more than the tolerance on both sides of it is cut by doc_id. Then rows are numbered in one exchange: by part (a shard is
several parts of about ``PART_ROWS`` rows, found by looser splitters, so a shard's rows needn't fit into a task), sorted
within it, after the rows that the counts found before the part. How many parts there are changes no result.

Cases: a null text has no bytes (size 1) and the crc of the empty text, and groups with empty texts; repeated rows are
numbered side by side, in one shard save where a splitter cuts between doc_ids; null doc_ids come first in their group;
rows alike in text and doc_id can't be separated by a splitter; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.llm.shared import stored

SHARDS = 16
PROBES = 256
#: A splitter may stand this share of a shard's bytes away from its target, and one between parts that share of a part's.
TOLERANCE = 0.002
PART_TOLERANCE = 0.25
#: Rows per part that one task numbers; more rows make more parts.
PART_ROWS = 1_000_000
MAX_PARTS_PER_SHARD = 256
_LOW = -(1 << 63)


@dataclass
class _Target:
    """Bytes wanted below a splitter, and the keys between which it lies: (level 0: hash, 1: doc_id) and both ends."""

    want: float
    level: int
    low: int
    high: int  # exclusive
    hash: int | None = None
    bytes_below: int = 0
    rows_below: int = 0
    done: bool = False

    def splitter(self) -> tuple[int, int | None]:
        """The first key (hash, doc_id; None: before every doc_id) that is not below the splitter."""
        return (self.low, None) if self.level == 0 else (self.hash, self.low)


def _digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )


def _slice_of(value: Column, low: int, step: int) -> Column:
    """(value - low) div step, in decimals: differences of 64-bit keys overflow a long."""
    return F.floor((value.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(step).cast("decimal(20,0)")).cast("int")


def _counts(rows: DataFrame, cells: list[tuple[int, int | None, int, int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """Exact (bytes, rows) of each slice of each cell (level, hash, low, high, step); empty slices are left out."""
    choice = None
    for i, (level, key, low, high, step) in enumerate(cells):
        value = F.col("key") if level == 0 else F.col("doc_id")
        inside = (F.col("key") == key) if level else F.lit(True)
        inside = inside & (value >= F.lit(low)) & ((value < F.lit(high)) if high < 1 << 63 else F.lit(True))
        hit = F.struct(F.lit(i).alias("cell"), _slice_of(value, low, step).alias("slice"))
        choice = F.when(inside, hit) if choice is None else choice.when(inside, hit)
    got = rows.select("size", choice.alias("at")).where("at is not null").groupBy("at").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {(r["at"]["cell"], r["at"]["slice"]): (r["b"], r["n"]) for r in got}


def find_splitters(rows: DataFrame, parts: int, total: int, span: tuple[int, int], tolerance: float = TOLERANCE, skip: int = 0) -> list[_Target]:
    """Targets with their final splitters, in key order; every ``skip``-th is left out.

    At most ``parts`` x PROBES counts come to the driver a round.
    """
    targets = [_Target(total * k / parts, 0, _LOW, 1 << 63) for k in range(1, parts) if not skip or k % skip]
    allowed = tolerance * total / parts
    while open_ := [t for t in targets if not t.done]:
        cells = sorted({(t.level, t.hash, t.low, t.high) for t in open_}, key=str)
        cells = [(*c, -(-(c[3] - c[2]) // PROBES)) for c in cells]
        for group in range(0, len(cells), 64):
            some = cells[group : group + 64]
            found = _counts(rows, some)
            for i, (level, key, low, high, step) in enumerate(some):
                for t in [t for t in open_ if (t.level, t.hash, t.low, t.high) == (level, key, low, high)]:
                    _advance(t, [(s, *found[i, s]) for s in range(PROBES) if (i, s) in found], step, allowed, span)
    return targets


def _advance(t: _Target, slices: list[tuple[int, int, int]], step: int, allowed: float, span: tuple[int, int]) -> None:
    """Moves a target's interval to the slice that crosses it; done where an end of that slice is near enough."""
    below, rows, start = t.bytes_below, t.rows_below, t.low
    for s, size, n in slices:
        if below + size >= t.want:
            low, high = start + s * step, min(start + (s + 1) * step, t.high)
            t.bytes_below, t.rows_below, t.low, t.high = below, rows, low, high
            if t.want - below <= allowed:
                t.done = True
            elif below + size - t.want <= allowed and high < 1 << 63:
                t.bytes_below, t.rows_below, t.low, t.done = below + size, rows + n, high, True
            elif high - low == 1 and t.level == 0:
                t.level, t.hash, t.low, t.high = 1, low, span[0], span[1] + 1
            elif high - low == 1:  # rows alike in text and doc_id stay together: the nearer end
                if below + size - t.want < t.want - below:
                    t.bytes_below, t.rows_below, t.low = below + size, rows + n, high
                t.done = True
            return
        below, rows = below + size, rows + n
    # only rows with a null doc_id are left in this hash: they come first, so the splitter stands behind what was counted
    t.bytes_below, t.rows_below, t.low, t.done = below, rows, t.high, True


def shard_documents(docs: DataFrame, shards: int = SHARDS, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, key, shard, slot: shards of near equal bytes in key order, slots gapless from 0."""
    rows = stored(_digest(docs), "digest")
    whole = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    per_shard = min(MAX_PARTS_PER_SHARD, max(1, -(-(whole["n"] or 0) // (shards * part_rows))))
    parts = shards * per_shard
    span = (whole["low"], whole["high"]) if whole["low"] is not None else (0, 0)
    # null doc_ids take the place just before the smallest one
    rows = rows.withColumn("named", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.lit(max(span[0] - 1, _LOW)))) 
    span = (max(span[0] - 1, _LOW), span[1])
    bounds = find_splitters(rows, shards, whole["b"], span) if whole["n"] else []
    inner = find_splitters(rows, parts, whole["b"], span, PART_TOLERANCE, per_shard) if whole["n"] and per_shard > 1 else []
    found = sorted([(t, 1) for t in bounds] + [(t, 0) for t in inner], key=lambda x: (x[0].rows_below, x[0].splitter()[0], x[0].splitter()[1] is not None, x[0].splitter()[1] or 0))
    shard_of = [0]
    for _, is_bound in found:
        shard_of.append(shard_of[-1] + is_bound)
    found = [t for t, _ in found]
    cuts = [t.splitter() for t in found]
    at_or_after = [F.col("key") >= F.lit(h) if d is None else (F.col("key") > F.lit(h)) | ((F.col("key") == F.lit(h)) & (F.col("doc_id") >= F.lit(d))) for h, d in cuts]
    part = _count_true(at_or_after)
    before = [0, *(t.rows_below for t in found)]
    ahead = [b - before[shard_of.index(shard_of[i])] for i, b in enumerate(before)]
    placed = rows.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("key", "doc_id", "text_crc32")))
    of_part = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("part") + 1)
    return placed.select(
        F.col("named").alias("doc_id"), "size", "text_crc32", "key",
        of_part(shard_of).cast("int").alias("shard"),
        (F.col("nth") - 1 + of_part(ahead)).cast("long").alias("slot"),
    )


def _count_true(tests: list[Column], first: int = 0) -> Column:
    """How many of the ascending tests hold, by halving."""
    if not tests:
        return F.lit(first)
    mid = len(tests) // 2
    return F.when(tests[mid], _count_true(tests[mid + 1 :], first + mid + 1)).otherwise(_count_true(tests[:mid], first))
