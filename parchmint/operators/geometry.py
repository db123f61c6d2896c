"""Operators on glyph boxes, lines, bands and page regions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmint.operators.grouping import fold_groups


def glyphs_of_lines(lines: DataFrame, pitch: float = 0.008) -> DataFrame:
    """(doc, line, ord, char, x, w) for text without geometry: one box per visible character on a fixed pitch."""
    each = lines.select("doc", "line", F.posexplode(F.split("text", "")).alias("ord", "char"))
    return each.where(F.col("char").rlike(r"\S")).withColumn("x", F.lit(0.02) + F.col("ord") * pitch).withColumn("w", F.lit(pitch))


def text_of_glyphs(glyphs: DataFrame, gap: float = 1.25) -> DataFrame:
    """(doc, line, text): characters by x, a space where the gap to the next is over ``gap`` - 1 median widths."""
    of_line = Window.partitionBy("doc", "line")
    w = of_line.orderBy("x", "ord")
    with_gap = glyphs.withColumn("median", F.percentile("w", 0.5).over(of_line)).withColumn("free", F.col("x") - F.lag(F.col("x") + F.col("w")).over(w))
    piece = F.when(F.col("free") > (gap - 1) * F.col("median"), F.concat(F.lit(" "), F.col("char"))).otherwise(F.col("char"))
    rows = with_gap.withColumn("piece", piece).groupBy("doc", "line").agg(F.sort_array(F.collect_list(F.struct("x", "ord", "piece"))).alias("p"))
    return rows.select("doc", "line", F.array_join(F.transform("p", lambda r: r["piece"]), "").alias("text"))


def quality(pages: DataFrame) -> DataFrame:
    """(doc, chars, letters, words, lines, garbled, ratio) of page texts: how much of a page is readable text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    chars = F.length(F.regexp_replace(t, r"\s", ""))
    letters = F.regexp_count(t, F.lit(r"[\p{L}\p{N}]"))
    bad = F.regexp_count(t, F.lit("[\\x{FFFD}\\x{0000}-\\x{0008}]"))
    lines = F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""))
    out = pages.select("doc", chars.cast("long").alias("chars"), letters.cast("long").alias("letters"), F.regexp_count(t, F.lit(r"\S+")).cast("long").alias("words"), lines.cast("long").alias("lines"), bad.cast("long").alias("garbled"))
    return out.withColumn("ratio", F.when(F.col("chars") > 0, F.bround(F.col("letters") / F.col("chars"), 4)).otherwise(F.lit(0.0)))


def needs_ocr(pages: DataFrame) -> DataFrame:
    """Pages whose text can't be trusted: garbled, or too little of it."""
    return pages.where((F.col("garbled") > 0) | (F.col("words") < 3) | ((F.col("chars") > 0) & (F.col("ratio") < 0.5)))


def cells_of_points(points: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """(page, row, col, n, value): the one value in each grid cell; two values publish none.

    Bands join on the page, so a page's points meet its own few bands only; edges are half open.
    """
    c = columns.select(F.col("page").alias("cp"), F.col("idx").alias("col"), F.col("lo").alias("x0"), F.col("hi").alias("x1"))
    r = rows.select(F.col("page").alias("rp"), F.col("idx").alias("row"), F.col("lo").alias("y0"), F.col("hi").alias("y1"))
    p = points
    hit = p.join(c, (p["page"] == c["cp"]) & (p["x"] >= c["x0"]) & (p["x"] < c["x1"])).join(r, (p["page"] == r["rp"]) & (p["y"] >= r["y0"]) & (p["y"] < r["y1"]))
    out = hit.groupBy("page", "row", "col").agg(F.count("*").alias("n"), F.min("value").alias("one"))
    return out.select("page", "row", "col", "n", F.when(F.col("n") == 1, F.col("one")).alias("value"))


def corridors(segments: DataFrame, samples: int = 400, support: float = 0.35) -> DataFrame:
    """(page, start, end): white corridors between columns, in samples of the page width.

    Each line votes for the samples inside its gaps (numeric lines twice); samples with ``support`` of the votes join
    into corridors. ``segments``: page, line, x0, x1, numeric.
    """
    w = Window.partitionBy("page", "line").orderBy("x0", "x1")
    gaps = segments.withColumn("from", F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("x0") > F.col("from"))
    lo, hi = F.ceil(F.col("from") * samples).cast("int"), (F.ceil(F.col("x0") * samples) - 1).cast("int")
    weight = F.when(F.col("numeric"), 2).otherwise(1)
    votes = gaps.where(hi >= lo).select("page", weight.alias("wt"), F.explode(F.sequence(lo, hi)).alias("s")).groupBy("page", "s").agg(F.sum("wt").alias("votes"))
    total = segments.select("page", "line", weight.alias("wt")).groupBy("page", "line").agg(F.max("wt").alias("wt")).groupBy("page").agg(F.sum("wt").alias("total"))
    won = votes.join(total, "page").where(F.col("votes") >= support * F.col("total"))
    runs = won.withColumn("run", F.col("s") - F.row_number().over(Window.partitionBy("page").orderBy("s")))
    return runs.groupBy("page", "run").agg(F.min("s").alias("start"), F.max("s").alias("end")).drop("run")


def _grouped(rows: DataFrame, keys: list[str], fold: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """An order-dependent fold of each group (a page or a block: small), in Arrow."""
    return fold_groups(rows, keys, fold, schema)


def running_clusters(values: list[float], tolerance: float) -> list[int]:
    """Group number of each of the ascending values: one joins the current group within ``tolerance`` of its mean."""
    out, total, n = [], 0.0, 0
    for v in values:
        if n and abs(v - total / n) > tolerance:
            total, n = 0.0, 0
        out.append((out[-1] + 1 if not n else out[-1]) if out else 0)
        total, n = total + v, n + 1
    return out


def clustered(rows: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """``rows`` (keys, id long, v double) with the cluster of each value: an order-dependent fold, so grouped in Arrow."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, "id", "v").schema) + ", cluster int"

    def fold(group: list[dict]) -> list[dict]:
        group.sort(key=lambda r: (r["v"], r["id"]))
        return [r | {"cluster": c} for r, c in zip(group, running_clusters([r["v"] for r in group], tolerance), strict=True)]

    return _grouped(rows.select(*keys, "id", "v"), keys, fold, schema)


def box_overlap(a: dict, b: dict) -> tuple[float, float, float]:
    """(shared area, area of a, area of b)."""
    w = max(0.0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]))
    h = max(0.0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return w * h, area(a), area(b)


def suppress(group: list[dict], iou: float = 0.30, contained: float = 0.70) -> list[dict]:
    """Boxes kept by confidence, then from the top left: one that overlaps a kept box is dropped."""
    kept: list[dict] = []
    for r in sorted(group, key=lambda r: (-r["confidence"], r["y0"], r["x0"], r["id"])):
        shared = [box_overlap(r, k) for k in kept]
        if not any(s and (s / (a + b - s) >= iou or s / min(a, b) >= contained) for s, a, b in shared):
            kept.append(r)
    return kept


_BOX = ("id long", "x0 double", "y0 double", "x1 double", "y1 double", "confidence double")


def without_overlaps(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Non-maximum suppression per page; ``boxes``: keys, id, x0, y0, x1, y1, confidence."""
    rows = boxes.select(*keys, *(b.split()[0] for b in _BOX))
    return _grouped(rows, keys, suppress, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys), *_BOX]))


def first_copies(group: list[dict], share: float = 0.8) -> list[dict]:
    """Lines less those that repeat an earlier kept one: same text, and boxes that share most of the smaller on both axes."""
    kept: list[dict] = []
    for r in sorted(group, key=lambda r: r["id"]):
        def same(k: dict, r: dict = r) -> bool:
            for lo, hi in (("x0", "x1"), ("y0", "y1")):
                least = min(k[hi] - k[lo], r[hi] - r[lo])
                if min(k[hi], r[hi]) - max(k[lo], r[lo]) < share * least:
                    return False
            return k["text"] == r["text"]

        if not any(map(same, kept)):
            kept.append(r)
    return kept


def without_copies(lines: DataFrame) -> DataFrame:
    """Coincident text layers removed per page; ``lines``: page, id, text, x0, y0, x1, y1. Groups are texts of one page."""
    rows = lines.select("page", "text", "id", "x0", "y0", "x1", "y1")
    return _grouped(rows, ["page", "text"], first_copies, "page long, text string, id long, x0 double, y0 double, x1 double, y1 double")


def one_to_one(group: list[dict], least: float) -> list[dict]:
    """Greedy one-to-one matches of expected and predicted boxes of a page, best overlap first."""
    want, got = ([r for r in group if r["side"] == s] for s in ("expected", "predicted"))
    pairs = []
    for a in want:
        for b in got:
            s, x, y = box_overlap(a, b)
            if s and s / (x + y - s) >= least:
                pairs.append((-s / (x + y - s), a["id"], b["id"]))
    used_a, used_b, out = set(), set(), []
    for minus, a, b in sorted(pairs):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append({"page": group[0]["page"], "expected": a, "predicted": b, "iou": -minus})
    return out


def matched(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """``boxes``: page, side, id, x0, y0, x1, y1."""
    rows = boxes.select("page", "side", "id", "x0", "y0", "x1", "y1")
    return _grouped(rows, ["page"], lambda g: one_to_one(g, least), "page long, expected long, predicted long, iou double")


def rule_groups(group: list[dict], reach: float = 0.004) -> list[dict]:
    """Components of crossing rules: each rule with the smallest id of its component (union-find over intersections)."""
    parent = {r["id"]: r["id"] for r in group}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ordered = sorted(group, key=lambda r: (r["x0"], r["id"]))
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if b["x0"] > a["x1"] + reach:
                break
            if b["y0"] <= a["y1"] + reach and a["y0"] <= b["y1"] + reach:
                x, y = root(a["id"]), root(b["id"])
                parent[max(x, y)] = min(x, y)
    return [{"page": r["page"], "id": r["id"], "component": root(r["id"])} for r in group]


def rule_components(rules: DataFrame) -> DataFrame:
    rows = rules.select("page", "id", "x0", "y0", "x1", "y1")
    return _grouped(rows, ["page"], rule_groups, "page long, id long, component long")


def merged_pages(source: DataFrame, replacement: DataFrame) -> DataFrame:
    """Pages of ``source`` (doc, page, text), replaced where ``replacement`` has them."""
    r = replacement.select("doc", "page", F.col("text").alias("new"))
    return source.join(r, ["doc", "page"], "left").select("doc", "page", F.coalesce("new", "text").alias("text"))

