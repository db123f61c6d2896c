"""Regions, blocks and grids of a page beside each other: which belong together, which agree, and what is kept of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.operators.evidence import united
from parchmint.operators.geometry import _grouped
from parchmint.operators.windows import first_wins, islands

#: The share of a block a grid must cover, of a region that folds into another, and how far fragments may lie apart.
COVER, FOLD, NEAR = 0.25, 0.60, 0.03


def _beside(a: DataFrame, b: DataFrame, slack: float = 0.0) -> DataFrame:
    """Boxes of both that overlap on a page (``slack`` taller), with the shared area and that of the first. A page has few."""
    o = b.select("page", F.col("id").alias("other"), *(F.col(c).alias("o" + c) for c in ("x0", "y0", "x1", "y1")))
    w = F.greatest(F.least("x1", "ox1") - F.greatest("x0", "ox0"), F.lit(0.0))
    h = F.greatest(F.least(F.col("y1") + slack, F.col("oy1") + slack) - F.greatest(F.col("y0") - slack, F.col("oy0") - slack), F.lit(0.0))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0") + 2 * slack)
    return a.join(o, "page").withColumn("shared", w * h).withColumn("area", area).where("shared > 0")


def grid_of_block(blocks: DataFrame, grids: DataFrame, slack: float = 0.0) -> DataFrame:
    """(page, id, grid): the grid that covers most of a block, at least a quarter of it; with ``slack`` also one just above
    or below. Both: page, id, x0, y0, x1, y1."""
    met = _beside(blocks, grids, slack).where(F.col("shared") >= COVER * F.col("area"))
    return first_wins(met, ["page", "id"], [F.col("shared").desc(), F.col("other")]).select("page", "id", F.col("other").alias("grid"))


def combined(ruled: DataFrame, white: DataFrame) -> DataFrame:
    """(page, id, source): regions of rules and of white space together; a pair of which one holds six tenths of the other is
    one, and the ruled one stands for both."""
    met = _beside(white, ruled)
    other = (F.col("ox1") - F.col("ox0")) * (F.col("oy1") - F.col("oy0"))
    folded = met.where(F.col("shared") >= FOLD * F.least(F.col("area"), other)).select("page", "id").distinct()
    left = white.join(folded, ["page", "id"], "left_anti")
    return ruled.select("page", "id", F.lit("ruled").alias("source")).union(left.select("page", "id", F.lit("white").alias("source")))


def merged_neighbours(fragments: DataFrame, tolerance: float = 0.012) -> DataFrame:
    """(page, id, group): fragments in a column of the page that follow each other closely and have the same columns are one
    table. ``fragments``: page, id, y0, y1, edges (array of column positions)."""
    w = Window.partitionBy("page").orderBy("y0", "id")
    last, edges = F.lag("y1").over(w), F.lag("edges").over(w)
    t = fragments.withColumn("_close", F.col("y0") - last <= NEAR).withColumn("_b", edges)
    same = F.forall(F.transform("edges", lambda e, i: F.abs(e - F.get("_b", i)) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False)))
    t = t.withColumn("_agree", (F.size("edges") == F.size("_b")) & same)
    return islands(t, ["page"], ["y0", "id"], ~(F.col("_close") & F.col("_agree")), "group").select("page", "id", "group")


def statement_regions(rows: list[dict]) -> list[dict]:
    """Tables of a page dealt to regions from the top: each joins the first region whose last table ends just above it and
    has as many columns; only regions of more than one table are kept."""
    regions: list[list[dict]] = []
    for t in sorted(rows, key=lambda r: (r["y0"], r["id"])):
        home = next((g for g in regions if 0 <= t["y0"] - g[-1]["y1"] <= 2 * NEAR and g[-1]["columns"] == t["columns"]), None)
        regions.append([t]) if home is None else home.append(t)
    return [{"page": t["page"], "id": t["id"], "region": n} for n, g in enumerate((g for g in regions if len(g) > 1), 1) for t in g]


def regions_of_tables(tables: DataFrame) -> DataFrame:
    """(page, id, region); ``tables``: page, id, y0, y1, columns."""
    return _grouped(tables.select("page", "id", "y0", "y1", "columns"), ["page"], statement_regions, "page long, id long, region int")


def composed(values: DataFrame, regions: DataFrame) -> DataFrame:
    """Values with the block they are read in: those of tables that share a region are one block. ``values``: page, table,
    more; ``regions``: page, id, region."""
    r = regions.select("page", F.col("id").alias("table"), "region")
    t = values.join(r, ["page", "table"], "left")
    return t.withColumn("block", F.when(F.col("region").isNotNull(), F.concat(F.lit("r"), F.col("region").cast("string"))).otherwise(F.concat(F.lit("t"), F.col("table").cast("string")))).drop("region")


def edge_disagreements(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """(page, what, at): right edges of figures that lie in no grid column (outside), columns without any (missing), and
    columns with two (doubled). ``edges``: page, x; ``columns``: page, idx, x0, x1."""
    met = edges.join(columns, "page", "left").withColumn("inside", (F.col("x") > F.col("x0")) & (F.col("x") <= F.col("x1")))
    outside = met.groupBy("page", "x").agg(F.max(F.coalesce("inside", F.lit(False))).alias("any")).where("not any").select("page", F.lit("outside").alias("what"), F.col("x").alias("at"))
    n = columns.join(edges, "page", "left").groupBy("page", "idx", "x0").agg(F.count_if((F.col("x") > F.col("x0")) & (F.col("x") <= F.col("x1"))).alias("n"))
    return outside.union(n.where("n = 0").select("page", F.lit("missing"), "x0")).union(n.where("n > 1").select("page", F.lit("doubled"), "x0"))


def grid_totals_kept(grid: DataFrame, published: DataFrame) -> DataFrame:
    """(span, outcome): totals read from a grid that are new or say more than the published one of their figure: confirmed
    over break over unresolved. Both: span, outcome."""
    rank = lambda c: F.when(c == "confirmed", 2).when(c == "break", 1).otherwise(0)
    p = published.groupBy("span").agg(F.max(rank(F.col("outcome"))).alias("has"))
    return grid.join(p, "span", "left").where(F.col("has").isNull() | (rank(F.col("outcome")) > F.col("has"))).select("span", "outcome")


def boundary_pairs(rows: list[dict]) -> list[dict]:
    """Expected and actual boundaries matched one to one, nearest pairs first, within the tolerance of 0.01."""
    want, got = ([r["at"] for r in rows if r["side"] == s] for s in ("expected", "actual"))
    pairs = sorted((abs(a - b), i, j) for i, a in enumerate(want) for j, b in enumerate(got) if abs(a - b) <= 0.01)
    used: tuple[set, set] = (set(), set())
    for _, i, j in pairs:
        if i not in used[0] and j not in used[1]:
            used[0].add(i)
            used[1].add(j)
    return [{"page": rows[0]["page"], "matched": len(used[0]), "missed": len(want) - len(used[0]), "extra": len(got) - len(used[1])}]


def boundary_scores(boundaries: DataFrame) -> DataFrame:
    """(page, matched, missed, extra); ``boundaries``: page, side, at."""
    return _grouped(boundaries.select("page", "side", "at"), ["page"], boundary_pairs, "page long, matched int, missed int, extra int")


def row_bands(glyphs: DataFrame) -> DataFrame:
    """(block, row, top, bottom) of the glyphs of each row. ``glyphs``: block, row, y0, y1."""
    return glyphs.groupBy("block", "row").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"))


def fragment_geometry(fragments: DataFrame, strict: bool) -> DataFrame:
    """(doc, id, page, text, box, segments): the printed pieces of one thing, in order. A heading (``strict``) of which a piece
    has no box is left out whole, a contents row only loses that piece. ``fragments``: doc, id, nth, page, text, box (x, y, w,
    h; null where it can't be placed)."""
    own = F.struct("nth", "page", "text", "box")
    g = fragments.groupBy("doc", "id").agg(F.sort_array(F.collect_list(own)).alias("all"))
    placed = F.filter("all", lambda f: f["box"].isNotNull() & (F.trim(f["text"]) != ""))
    g = g.withColumn("segments", placed).where(F.size("segments") > 0)
    g = g.where(F.size("segments") == F.size("all")) if strict else g
    return g.select("doc", "id", F.get("segments", F.lit(0))["page"].alias("page"), F.array_join(F.transform("segments", lambda f: F.trim(f["text"])), " ").alias("text"), united(F.transform("segments", lambda f: f["box"])).alias("box"), "segments")


def item_keys(catalogue: DataFrame) -> DataFrame:
    """Adds ``key``: an item's number, and its part where the number stands under several parts. ``catalogue``: doc, id, part."""
    several = F.count("*").over(Window.partitionBy("doc", "id")) > 1
    return catalogue.withColumn("key", F.when(several & (F.col("part") != ""), F.concat_ws("-", F.lit("item"), F.lower("part"), F.lower("id"))).otherwise(F.concat_ws("-", F.lit("item"), F.lower("id"))))


def ordered_files(files: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Adds ``place``: files by name (natural order), links, size, date, folder or status; equal ones keep their order.
    ``files``: seq, name, links, size, date, folder, status; a file list is shown in one order."""
    from parchmint.functions.scalars import natural_key

    by: Column = natural_key(F.col("name")) if key == "name" else F.lower(key) if key in ("folder", "status") else F.col(key)
    return files.withColumn("place", F.row_number().over(Window.orderBy(by.desc() if descending else by, F.col("seq"))))


def general_reading(candidates: DataFrame, by_raw_first: bool = False) -> DataFrame:
    """(cell, text): of the readings of a cell without noise marks (of all, if none is) the one with most votes of its letters
    and digits, then the surest, then a raw one, then the longest; for names of places the raw one before the surest, and
    votes count by spelling. ``candidates``: cell, text, confidence, source."""
    noisy = F.col("text").rlike("[_|�]") | (F.trim("text") == "")
    t = candidates.withColumn("_clean", F.max((~noisy).cast("int")).over(Window.partitionBy("cell"))).where((F.col("_clean") == 0) | ~noisy)
    key = F.col("text") if by_raw_first else F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")
    t = t.withColumn("_votes", F.count("*").over(Window.partitionBy("cell", key))).withColumn("_raw", F.col("source").startswith("raw").cast("int"))
    order = ["_votes", "_raw", "confidence"] if by_raw_first else ["_votes", "confidence", "_raw"]
    return first_wins(t, ["cell"], [*(F.col(c).desc() for c in order), F.length("text").desc(), F.col("text")]).select("cell", "text")


def attached(documents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Documents with all artifacts of their finished run at once, or none: runs that miss one change nothing. ``documents``:
    id, text_artifact, table_artifact, value_artifact, status; ``artifacts``: id and the three."""
    names = ("text_artifact", "table_artifact", "value_artifact")
    whole = artifacts.where(" and ".join(f"{n} is not null" for n in names)).select("id", *(F.col(n).alias("_" + n) for n in names))
    t = documents.join(whole, "id", "left")
    return t.select("id", *(F.coalesce("_" + n, n).alias(n) for n in names), F.when(F.col("_text_artifact").isNotNull(), "ready").otherwise(F.col("status")).alias("status"))


def json_lines(rows: DataFrame) -> DataFrame:
    """(value): one compact JSON object a row, as a text sink writes them."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def lineage(result: DataFrame, inputs: DataFrame) -> DataFrame:
    """(doc, fault): stored results made of other geometry, of other tables, or of inputs that are gone; none for sound ones.
    ``result``: doc, geometry, digest; ``inputs``: doc, geometry, digest."""
    i = inputs.select("doc", F.col("geometry").alias("g"), F.col("digest").alias("d"))
    fault = F.when(F.col("g").isNull(), "input-missing").when(F.col("g") != F.col("geometry"), "geometry-changed").when(~F.col("d").eqNullSafe(F.col("digest")), "tables-changed")
    return result.join(i, "doc", "left").select("doc", fault.alias("fault")).where("fault is not null")
