"""Tables of a page from its words: which lines form one, where its columns and rows lie, what heads it, and how sure that is.

Words and rules are tables of boxes (page, ..., x0, y0, x1, y1). What is a window or a sum is one; the reading of a page,
in which each step rests on the one before, runs page by page in a kernel.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import scalars
from parchmint.operators.geometry import _grouped, running_clusters
from parchmint.operators.grouping import fold_groups
from parchmint.operators.windows import islands

WORD_GAP, CELL_GAP, CELL_CHARS = 0.55, 0.012, 2.5
#: Samples of a region's width, the share of lines that must leave a corridor free, and how many may cross it.
SAMPLES, SUPPORT, CROSSED = 400, 0.35, 0.15
VIEW_SAMPLES, VIEW_SUPPORT = 800, 0.45
#: How close lines follow each other in a table, in line heights; words that make a line prose.
PITCH, PROSE = 2.6, 8
RULE_REACH, RULE_SPAN, EDGE_SPAN = 0.004, 0.55, 0.6
#: A table is published with a credential and at least this confidence.
SURE = 0.5
_NUMBER = re.compile(r"^[$€£¥₹₩]?[(]?-?[$€£¥₹₩]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?[)]?%?$|^[‐-―-]$")
_MARK = re.compile(r"^(?:[$€£¥₹₩]|[)%]|\)%|[*†‡])$")
_PERIOD = re.compile(r"\b(?:19|20)\d{2}\b|\bQ[1-4]\b")


def words(glyphs: DataFrame) -> DataFrame:
    """(page, line, word, text, x0, x1, y0, y1, char): glyphs joined while the gap is under 0.55 character widths.
    ``glyphs``: page, line, char, x0, x1, y0, y1; spaces have no row."""
    of_line = ["page", "line"]
    wide = F.percentile(F.col("x1") - F.col("x0"), 0.5).over(Window.partitionBy(*of_line))
    t = glyphs.withColumn("wide", wide)
    far = F.col("x0") - F.lag("x1").over(Window.partitionBy(*of_line).orderBy("x0")) >= WORD_GAP * F.col("wide")
    g = islands(t, of_line, ["x0"], far, "word").groupBy(*of_line, "word").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "char"))), lambda c: c["char"]), "").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.first("wide").alias("char"))
    return g


def merged_lines(lines: list[dict]) -> list[list[dict]]:
    """Source lines of a page that share seven tenths of the lower height are one visual line, from the top."""
    out: list[list[dict]] = []
    for line in sorted(lines, key=lambda r: (r["y0"], r["x0"])):
        for group in out[-3:]:
            top, bottom = max(line["y0"], min(r["y0"] for r in group)), min(line["y1"], max(r["y1"] for r in group))
            if bottom - top >= 0.7 * min(line["y1"] - line["y0"], *(r["y1"] - r["y0"] for r in group)):
                group.append(line)
                break
        else:
            out.append([line])
    return out


class Line:
    """A visual line: its words by place and its cells, words joined over small gaps."""

    def __init__(self, found: list[dict]):
        self.words = sorted(found, key=lambda w: w["x0"])
        self.top, self.bottom = min(w["y0"] for w in found), max(w["y1"] for w in found)
        self.char = sorted(w["char"] for w in found)[len(found) // 2]
        self.cells: list[list[dict]] = []
        for w in self.words:
            if self.cells and w["x0"] - self.cells[-1][-1]["x1"] < max(CELL_GAP, CELL_CHARS * self.char):
                self.cells[-1].append(w)
            else:
                self.cells.append([w])
        self.left, self.right = self.words[0]["x0"], max(w["x1"] for w in self.words)
        self.numeric = any(_NUMBER.match(w["text"]) for w in self.words)

    def prose(self, left: float, right: float) -> bool:
        """Running text: one cell across most of the width, with many words."""
        return len(self.cells) == 1 and len(self.words) >= PROSE and self.right - self.left >= 0.6 * (right - left)


def goes_on(line: Line, above_bottom: float, above_left: float) -> bool:
    """Whether a line is close below another one and further in, or in lower case: the rest of its label."""
    close = line.top - above_bottom <= 0.9 * (line.bottom - line.top)
    return close and (line.left > above_left + 0.5 * line.char or line.words[0]["text"][:1].islower())


def line_runs(lines: list[Line]) -> list[list[Line]]:
    """Runs of lines in which at least two have several cells, cut at blank bands and at prose; lines of one cell at a run's
    end belong to the text after it, save one that goes on with the line above."""
    if not lines:
        return []
    left, right = min(x.left for x in lines), max(x.right for x in lines)
    out, run = [], []

    def close() -> None:
        while run and len(run[-1].cells) == 1 and not (len(run) > 1 and len(run[-2].cells) > 1 and goes_on(run[-1], run[-2].bottom, run[-2].left)):
            run.pop()
        while run and len(run[0].cells) == 1:
            run.pop(0)
        if sum(len(x.cells) > 1 for x in run) >= 2:
            out.append(list(run))
        run.clear()

    for x in lines:
        if run and x.top - run[-1].bottom > PITCH * (run[-1].bottom - run[-1].top) or x.prose(left, right):
            close()
        if not x.prose(left, right):
            run.append(x)
    close()
    return out


def corridor_votes(lines: list[Line], left: float, right: float) -> list[float]:
    """Middles of the corridors that enough lines leave free between their cells and few cross; lines with figures count twice."""
    step = (right - left) / SAMPLES
    # where votes of a sample begin (up) and end (down): between two such places all samples have the same votes
    free, crossed, total = {}, {}, 0.0

    def vote(votes: dict[int, float], first: int, end: int, weight: float) -> None:
        first, end = max(0, first), min(SAMPLES, end)
        if first < end:
            votes[first] = votes.get(first, 0.0) + weight
            votes[end] = votes.get(end, 0.0) - weight

    for x in lines:
        weight = 2.0 if x.numeric else 1.0
        total += weight
        edges = [(c[0]["x0"], max(w["x1"] for w in c)) for c in x.cells]
        for (_, a), (b, _) in zip(edges, edges[1:]):
            vote(free, math.ceil((a - left) / step), math.ceil((b - left) / step), weight)
        for a, b in edges:
            vote(crossed, math.floor((a - left) / step) + 1, math.ceil((b - left) / step), weight)
    out, f, c, best = [], 0.0, 0.0, None  # best: of an open stretch, the most votes and the samples from the first to past the last that has them
    places = sorted({0, SAMPLES, *free, *crossed})
    for a, b in zip(places, places[1:]):
        f, c = f + free.get(a, 0.0), c + crossed.get(a, 0.0)
        if not (f >= SUPPORT * total and c <= CROSSED * total):
            if best:
                out.append(left + (best[1] + best[2]) / 2 * step)
            best = None
        elif best is None or f > best[0]:
            best = (f, a, b)
        elif f == best[0]:
            best = (f, best[1], b)
    if best:
        out.append(left + (best[1] + best[2]) / 2 * step)
    return out


def boundaries(lines: list[Line]) -> list[float]:
    """Column boundaries in two votes: lines whose one cell spans a boundary of the first don't vote in the second."""
    left, right = min(x.left for x in lines), max(x.right for x in lines)
    first = corridor_votes([x for x in lines if len(x.cells) > 1] or lines, left, right)
    spanning = lambda x: any(c[0]["x0"] < b < max(w["x1"] for w in c) for c in x.cells for b in first)
    rest = [x for x in lines if not spanning(x)]
    return corridor_votes([x for x in rest if len(x.cells) > 1], left, right) if len(rest) >= 2 else first


def in_columns(line: Line, cuts: list[float]) -> list[str]:
    """The text of each column: words by their middles, a currency or closing mark with the figure it stands beside."""
    place = [bisect_right(cuts, (w["x0"] + w["x1"]) / 2) for w in line.words]
    for i, w in enumerate(line.words):
        if _MARK.match(w["text"]):
            beside = i + 1 if w["text"][0] in "$€£¥₹₩" else i - 1
            if 0 <= beside < len(place) and abs(place[beside] - place[i]) <= 1:
                place[i] = place[beside]
    texts: list[list[str]] = [[] for _ in range(len(cuts) + 1)]
    for w, p in zip(line.words, place, strict=True):
        texts[p].append(w["text"])
    return [" ".join(t) for t in texts]


def logical_rows(lines: list[Line], cuts: list[float]) -> list[dict]:
    """Rows of a grid: a line that only goes on with the label above, close below it and further in, belongs to its row; a
    label without figures whose next line has figures and starts in lower case is finished by that line."""
    rows: list[dict] = []
    for x in lines:
        cells = in_columns(x, cuts)
        filled = [k for k, c in enumerate(cells) if c]
        if rows:
            above = rows[-1]
            tail = filled == [0] and any(above["cells"][1:]) and goes_on(x, above["bottom"], above["left"])
            ends = x.top - above["bottom"] <= 0.9 * (x.bottom - x.top) and not any(above["cells"][1:]) and above["cells"][0] and 0 in filled and cells[0][:1].islower()
            if tail or ends:
                above["cells"] = [" ".join(t for t in (a, b) if t) for a, b in zip(above["cells"], cells, strict=True)]
                above["bottom"] = x.bottom
                continue
        rows.append({"cells": cells, "top": x.top, "bottom": x.bottom, "left": x.left})
    return rows


def header_rows(rows: list[dict]) -> int:
    """How many rows head the grid: those before the first row with a label and a figure that is no year or quarter, and no
    more than half of all; a second line of column titles counts with the first."""
    for n, r in enumerate(rows[: max(1, len(rows) // 2) + 1]):
        figures = [c for c in r["cells"][1:] if c and _NUMBER.match(c.replace(" ", ""))]
        if any(not _PERIOD.fullmatch(c) for c in figures) and r["cells"][0]:
            return n
        if figures and len(figures) == sum(bool(c) for c in r["cells"][1:]) and not all(_PERIOD.fullmatch(c) for c in figures):
            return n
    return 0


def without_empty_columns(rows: list[dict], heads: int, cuts: list[float]) -> tuple[list[dict], list[float]]:
    """The grid with every column that no body row fills folded into the one before it (the first into the next)."""
    while len(cuts) and (empty := next((k for k in range(len(cuts) + 1) if not any(r["cells"][k] for r in rows[heads:])), None)) is not None:
        into = empty - 1 if empty else 1
        low, high = min(empty, into), max(empty, into)
        for r in rows:
            r["cells"][low : high + 1] = [" ".join(t for t in r["cells"][low : high + 1] if t)]
        cuts = [b for i, b in enumerate(cuts) if i != low]
    return rows, cuts


FEATURES = ("fill", "numeric", "aligned", "rows", "columns", "header", "ruled")
#: Weight of each feature in the raw score.
WEIGHTS = {"fill": 0.22, "numeric": 0.24, "aligned": 0.14, "rows": 0.12, "columns": 0.12, "header": 0.1, "ruled": 0.06}


def features(rows: list[dict], heads: int, lines: list[Line], ruled: bool) -> dict[str, float]:
    """What speaks for a grid, each from 0 to 1."""
    body, width = rows[heads:], len(rows[0]["cells"])
    filled = [c for r in body for c in r["cells"] if c]
    values = [[r["cells"][k] for r in body if r["cells"][k]] for k in range(1, width)]
    columns = [sum(bool(_NUMBER.match(c.replace(" ", ""))) for c in v) / len(v) for v in values if v]
    rights = [w["x1"] for x in lines for w in x.words if _NUMBER.match(w["text"])]
    groups = Counter(running_clusters(sorted(rights), 0.012)) if rights else {}
    return {
        "fill": len(filled) / max(1, len(body) * width), "numeric": max(columns, default=0.0), "aligned": sum(n for n in groups.values() if n > 1) / len(rights) if rights else 0.0,
        "rows": min(1.0, len(body) / 6), "columns": min(1.0, width / 4), "header": 1.0 if heads else 0.0, "ruled": 1.0 if ruled else 0.0,
    }


def confidence(found: dict[str, float]) -> float:
    return round(1 / (1 + math.exp(-7 * (sum(WEIGHTS[f] * found[f] for f in FEATURES) - 0.42))), 4)


def credential(found: dict[str, float], categorical: float = 0.0) -> bool:
    """Whether a grid shows at least one thing only tables show: rules, a column of values, or repeated categories."""
    return found["ruled"] >= 0.5 or found["numeric"] >= 0.5 or categorical >= 2 / 3


def page_tables(found: list[dict]) -> list[dict]:
    """The tables of one page's words, one row a cell; a candidate that isn't sure is one row with the reason."""
    page = found[0]["page"]
    by_line: dict[int, list[dict]] = {}
    for w in found:
        by_line.setdefault(w["line"], []).append(w)
    boxes = [{"line": n, "x0": min(w["x0"] for w in ws), "y0": min(w["y0"] for w in ws), "x1": max(w["x1"] for w in ws), "y1": max(w["y1"] for w in ws)} for n, ws in by_line.items()]
    lines = [Line([w for b in group for w in by_line[b["line"]]]) for group in merged_lines(boxes)]
    out: list[dict] = []
    for n, run in enumerate(line_runs(sorted(lines, key=lambda x: x.top)), 1):
        cuts = boundaries(run)
        rows = logical_rows(run, cuts)
        heads = header_rows(rows)
        for _ in range(3):  # columns depend on which rows head the grid, and the other way round
            rows, kept = without_empty_columns(rows, heads, cuts)
            if kept == cuts:
                break
            cuts, rows = kept, logical_rows(run, kept)
            heads = header_rows(rows)
        told = features(rows, heads, run, False)
        sure = confidence(told)
        texts = Counter(c for r in rows[heads:] for c in r["cells"][1:] if c and not _NUMBER.match(c))
        repeated = sum(v for v in texts.values() if v > 1) / max(1, sum(texts.values()))
        good = credential(told, repeated) and sure >= SURE and len(cuts) > 0 and len(rows) > heads
        weak = None if good else max(FEATURES, key=lambda f: WEIGHTS[f] * (1 - told[f]))
        for r, row in enumerate(rows):
            out += [{"page": page, "table": n, "row": r, "col": k, "header": r < heads, "text": text, "confidence": sure, "accepted": good, "weakest": weak} for k, text in enumerate(row["cells"])]
    return out


TABLES = "page long, table int, row int, col int, header boolean, text string, confidence double, accepted boolean, weakest string"


def detected(found: DataFrame, placed: bool = False) -> DataFrame:
    """(page, table, row, col, header, text, confidence, accepted, weakest) of the tables of each page of words. No page is
    left out for time. ``placed``: the words of a page lie in one partition already."""
    return fold_groups(found.select("page", "line", "text", "x0", "y0", "x1", "y1", "char"), ["page"], page_tables, TABLES, placed)


def column_labels(cells: DataFrame) -> DataFrame:
    """(page, table, col, label, period): the texts of the header rows of a column, from the top, and the period they name."""
    g = cells.where("header and trim(text) <> ''").groupBy("page", "table", "col").agg(F.sort_array(F.collect_list(F.struct("row", "text"))).alias("p"))
    label = scalars.collapsed(F.array_join(F.transform("p", lambda x: x["text"]), " "))
    return g.select("page", "table", "col", label.alias("label"), scalars.period_in(label).alias("period"))


def table_counts(cells: DataFrame) -> DataFrame:
    """(page, tables, digest): accepted tables of a page and what they say."""
    t = cells.where("accepted").groupBy("page", "table").agg(F.sort_array(F.collect_list(F.struct("row", "col", "text"))).alias("c"))
    return t.groupBy("page").agg(F.count("*").alias("tables"), F.substring(F.sha2(F.to_json(F.sort_array(F.collect_list("c"))), 256), 1, 16).alias("digest"))


def value_signatures(cells: DataFrame) -> DataFrame:
    """(page, table, row, signature, splits): which columns of a body row hold figures, and whether a row starts another
    schema: the signature changes and the new one holds for the next row too."""
    is_number = F.col("text").rlike(_NUMBER.pattern)
    rows = cells.where("not header").groupBy("page", "table", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", is_number.alias("n")))), lambda x: F.when(x["n"], "9").otherwise("a")), "").alias("signature"))
    w = Window.partitionBy("page", "table").orderBy("row")
    splits = (F.col("signature") != F.lag("signature").over(w)) & (F.col("signature") == F.lead("signature").over(w))
    return rows.withColumn("splits", F.coalesce(splits, F.lit(False)))


def repeated_headers(cells: DataFrame) -> DataFrame:
    """(page, table, row): body rows that print the header again: a table starts anew there."""
    rows = cells.groupBy("page", "table", "row", "header").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", scalars.label(F.col("text")).alias("t")))), lambda x: x["t"]).alias("texts"))
    heads = rows.where("header").select("page", "table", "texts").distinct()
    return rows.where("not header").join(heads, ["page", "table", "texts"], "left_semi").select("page", "table", "row")


def offset_period_band(texts: Column, below: Column) -> Column:
    """Whether a header band names periods from a column on that isn't the first, over a band that is filled from there."""
    filled = F.filter(F.transform(texts, lambda t, i: F.when(F.trim(t) != "", i)), lambda i: i.isNotNull())
    periods = F.forall(F.filter(texts, lambda t: F.trim(t) != ""), lambda t: t.rlike(r"(?:19|20)[0-9]{2}|[Qq][1-4]"))
    under = F.forall(filled, lambda i: F.trim(F.get(below, i)) != "")
    return (F.size(filled) >= 2) & (F.element_at(filled, 1) >= 1) & periods & under


def ruled_boundaries(rules: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, xs): interior column boundaries from vertical rules that span most of a region's height; they need three
    rules, and the outer two are its frame. ``rules``: page, x, y0, y1; ``regions``: region, page, x0, y0, x1, y1."""
    r = rules.select("page", "x", F.col("y0").alias("r0"), F.col("y1").alias("r1"))
    inside = regions.join(r, "page").where((F.col("x") >= F.col("x0") - RULE_REACH) & (F.col("x") <= F.col("x1") + RULE_REACH))
    span = F.least("r1", "y1") - F.greatest("r0", "y0")
    g = inside.where(span >= RULE_SPAN * (F.col("y1") - F.col("y0"))).groupBy("region").agg(F.sort_array(F.collect_set(F.round("x", 4))).alias("xs"))
    return g.where(F.size("xs") >= 3).select("region", F.slice("xs", F.lit(2), F.size("xs") - 2).alias("xs"))


def ruled_rows(rules: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, ys): row edges from horizontal rules over at least six tenths of a region's width. ``rules``: page, y, x0, x1."""
    r = rules.select("page", "y", F.col("x0").alias("r0"), F.col("x1").alias("r1"))
    inside = regions.join(r, "page").where((F.col("y") >= F.col("y0") - RULE_REACH) & (F.col("y") <= F.col("y1") + RULE_REACH))
    span = F.least("r1", "x1") - F.greatest("r0", "x0")
    return inside.where(span >= EDGE_SPAN * (F.col("x1") - F.col("x0"))).groupBy("region").agg(F.sort_array(F.collect_set(F.round("y", 4))).alias("ys"))


def merged_rules(rules: list[dict]) -> list[dict]:
    """Collinear rules of one direction that overlap or touch, as one: those within 0.004 of the running mean position."""
    rules = sorted(rules, key=lambda r: (r["at"], r["lo"], r["id"]))
    out: list[dict] = []
    groups: dict[int, list[dict]] = {}
    for r, g in zip(rules, running_clusters([r["at"] for r in rules], RULE_REACH), strict=True):
        groups.setdefault(g, []).append(r)
    for g in groups.values():
        run: list[dict] = []
        for r in sorted(g, key=lambda r: (r["lo"], r["hi"])):
            if run and r["lo"] > max(x["hi"] for x in run) + RULE_REACH:
                out.append(_one_rule(run))
                run = []
            run.append(r)
        out.append(_one_rule(run))
    return out


def _one_rule(run: list[dict]) -> dict:
    return {"page": run[0]["page"], "id": min(r["id"] for r in run), "at": sum(r["at"] for r in run) / len(run), "lo": min(r["lo"] for r in run), "hi": max(r["hi"] for r in run), "n": len(run)}


def parallel_rules(rules: DataFrame) -> DataFrame:
    """(page, id, at, lo, hi, n); ``rules`` of one direction: page, id, at, lo, hi."""
    return _grouped(rules.select("page", "id", "at", "lo", "hi"), ["page"], merged_rules, "page long, id long, at double, lo double, hi double, n int")


def crossing_rules_kept(rules: list[dict]) -> list[dict]:
    """Rules with at least two crossings of the other direction among those kept, until none drops out."""
    kept = list(rules)
    while True:
        good = []
        for r in kept:
            cross = sum(o["vertical"] != r["vertical"] and r["lo"] - RULE_REACH <= o["at"] <= r["hi"] + RULE_REACH and o["lo"] - RULE_REACH <= r["at"] <= o["hi"] + RULE_REACH for o in kept)
            if cross >= 2:
                good.append(r)
        if len(good) == len(kept):
            return [{"page": r["page"], "id": r["id"]} for r in kept]
        kept = good


def coherent_rules(rules: DataFrame) -> DataFrame:
    """(page, id); ``rules``: page, id, vertical, at, lo, hi."""
    return _grouped(rules.select("page", "id", "vertical", "at", "lo", "hi"), ["page"], crossing_rules_kept, "page long, id long")


def row_edges(rows: DataFrame) -> DataFrame:
    """(region, row, edge): the middle between the centres of neighbouring rows. ``rows``: region, row, y0, y1."""
    w = Window.partitionBy("region").orderBy("row")
    centre = (F.col("y0") + F.col("y1")) / 2
    t = rows.withColumn("c", centre)
    return t.select("region", "row", ((F.col("c") + F.lead("c").over(w)) / 2).alias("edge")).where("edge is not null")


def snapped(edges: DataFrame, rules: DataFrame, reach: float) -> DataFrame:
    """(region, row, edge): edges moved to the nearest rule within reach. ``rules``: region, y; a region has few of them."""
    drawn = rules.groupBy("region").agg(F.collect_list("y").alias("ys"))
    t = edges.join(drawn, "region", "left")
    near = F.filter(F.transform("ys", lambda y: F.struct(F.abs(y - F.col("edge")).alias("far"), y.alias("y"))), lambda s: s["far"] <= reach)
    return t.select("region", "row", F.coalesce(F.array_min(near)["y"], "edge").alias("edge"))


def best_table(regions: DataFrame, tables: DataFrame) -> DataFrame:
    """(region, table): the table under a rectangle: most of it covered, then surest, then smallest, then by id; coverage
    and confidence tie within a hundredth. Both: page, x0, y0, x1, y1; ``tables`` also confidence."""
    t = tables.select("page", "table", "confidence", *(F.col(c).alias("t" + c) for c in ("x0", "y0", "x1", "y1")))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    shared = F.greatest(F.least("x1", "tx1") - F.greatest("x0", "tx0"), F.lit(0.0)) * F.greatest(F.least("y1", "ty1") - F.greatest("y0", "ty0"), F.lit(0.0))
    own = (F.col("tx1") - F.col("tx0")) * (F.col("ty1") - F.col("ty0"))
    met = regions.join(t, "page").withColumn("cover", shared / area).where("cover > 0").withColumn("own", own)
    order = [F.round("cover", 2).desc(), F.round("confidence", 2).desc(), F.round("own", 6), F.col("table")]
    return met.withColumn("n", F.row_number().over(Window.partitionBy("region").orderBy(*order))).where("n = 1").select("region", "table", F.round("cover", 4).alias("cover"))


def glyph_cells(glyphs: DataFrame, grids: DataFrame) -> DataFrame:
    """(page, i, row, col): the cell of a glyph's centre: how many of the grid's boundaries lie at or before it. ``grids``:
    page, xs, ys (interior boundaries)."""
    count = lambda edges, at: F.size(F.filter(edges, lambda e: e <= at))
    t = glyphs.join(grids, "page")
    return t.select("page", "i", count("ys", (F.col("y0") + F.col("y1")) / 2).alias("row"), count("xs", (F.col("x0") + F.col("x1")) / 2).alias("col"))


def shown_rows(cells: DataFrame) -> DataFrame:
    """(page, table, row, shown): a table's rows as a viewer counts them: all header bands are one row."""
    heads = F.sum(F.when(F.col("header") & (F.col("col") == 0), 1).otherwise(0)).over(Window.partitionBy("page", "table"))
    shown = F.when(F.col("header"), 0).otherwise(F.col("row") - F.col("heads") + F.when(F.col("heads") > 0, 1).otherwise(0))
    return cells.withColumn("heads", heads).select("page", "table", "row", shown.alias("shown")).distinct()


def chosen_reading(candidates: DataFrame) -> DataFrame:
    """(cell, text, ambiguous): the reading of a cell with the best score; ambiguous where another text comes within five.
    ``candidates``: cell, text, confidence, well_formed."""
    votes = candidates.groupBy("cell", "text").agg(F.count("*").alias("n"), F.max("confidence").alias("c"), F.max("well_formed").alias("f"))
    score = F.when(F.col("f"), 40.0).otherwise(0.0) + F.least(F.lit(15.0), 3.0 * F.col("n")) + 0.3 * F.col("c")
    w = Window.partitionBy("cell").orderBy(F.col("score").desc(), F.col("c").desc(), F.col("text"))
    t = votes.withColumn("score", score).withColumn("nth", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    return t.where("nth = 1").select("cell", "text", F.coalesce(F.col("score") - F.col("next") < 5, F.lit(False)).alias("ambiguous"))


def covered_share(regions: DataFrame, drawings: DataFrame, samples: int = 20) -> DataFrame:
    """(region, share) of a region under drawings, on a grid of samples. Both: page, x0, y0, x1, y1."""
    d = drawings.groupBy("page").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("ds"))
    at = lambda lo, hi, i: F.col(lo) + (F.col(hi) - F.col(lo)) * (F.col(i) + 0.5) / samples
    every = F.sequence(F.lit(0), F.lit(samples - 1))
    t = regions.join(d, "page", "left").select("region", "x0", "y0", "x1", "y1", "ds", F.explode(every).alias("i")).select("*", F.explode(every).alias("j"))
    x, y = at("x0", "x1", "i"), at("y0", "y1", "j")
    under = F.coalesce(F.exists("ds", lambda b: (x >= b["x0"]) & (x <= b["x1"]) & (y >= b["y0"]) & (y <= b["y1"])), F.lit(False))
    return t.groupBy("region").agg((F.count_if(under) / F.count("*")).alias("share"))


def supported_edges(lines: DataFrame, side: str, tolerance: float = 0.004) -> DataFrame:
    """(region, edge): the outermost edge (``side``: x0 the leftmost, x1 the rightmost) that two lines share within the
    tolerance, else the median. ``lines``: region, x0, x1."""
    w = Window.partitionBy("region").orderBy(side)
    near = (F.col(side) - F.lag(side).over(w) <= tolerance) | (F.lead(side).over(w) - F.col(side) <= tolerance)
    t = lines.withColumn("shared", F.coalesce(near, F.lit(False)))
    pick = F.min if side == "x0" else F.max
    return t.groupBy("region").agg(F.coalesce(pick(F.when(F.col("shared"), F.col(side))), F.percentile(side, 0.5)).alias("edge"))
