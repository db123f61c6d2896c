"""Links between sheet cells and document rectangles: what a link writes, how selections, moves and undo change the set,
and the reviewed equations of a scan. Link rows: id, sheet, row, col, doc, page, x, y, w, h, kind, text, seq, track.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.functions import printed, scalars
from parchmint.operators.geometry import _grouped
from parchmint.operators.windows import first_wins


def written(links: DataFrame) -> DataFrame:
    """Adds ``value`` (kind, number, text, format): what a link writes to its cell. auto: a date, a number or text; raw: the
    text as it is, made literal; sum: the total of its numbers; table: nothing of its own."""
    t = printed.with_numbers(links, "text", tuple(links.columns)).withColumn("_auto", printed.auto_value(F.col("text")))
    none = F.lit(None)
    made = lambda kind, number, text, fmt=none: F.struct(F.lit(kind).alias("kind"), number.cast("double").alias("number"), text.cast("string").alias("text"), fmt.cast("string").alias("format"))
    raw = made("text", none, scalars.literal_cell(F.col("text")))
    total = made("sum", printed.number_sum(F.col("numbers")), none)
    value = F.when(F.col("kind") == "auto", F.col("_auto")).when(F.col("kind") == "raw", raw).when((F.col("kind") == "sum") & (F.size("numbers") > 0), total)
    return t.withColumn("value", value).drop("_auto", "numbers")


def sum_cells(links: DataFrame) -> DataFrame:
    """(sheet, row, col, formula, total, terms) of cells that sum links: the numbers of all their texts, in the order the
    links were added. Adding a link, or dropping one and summing again, is the same with other rows."""
    t = printed.with_numbers(links.where("kind = 'sum'").select("sheet", "row", "col", "track", "text"), "text", ("sheet", "row", "col", "track"))
    g = t.groupBy("sheet", "row", "col").agg(F.sort_array(F.collect_list(F.struct("track", "numbers"))).alias("p"))
    values = F.flatten(F.transform("p", lambda x: F.transform(x["numbers"], lambda n: n["value"])))
    shown = F.transform("v", lambda v: F.regexp_replace(F.regexp_replace(F.call_function("printf", F.lit("%.10f"), v), "0+$", ""), r"\.$", ""))
    g = g.withColumn("v", values).where(F.size("v") > 0)
    return g.select("sheet", "row", "col", F.concat(F.lit("="), F.array_join(shown, "+")).alias("formula"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("v").cast("long").alias("terms"))


def without_contribution(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Links less those of ``gone`` (id); what is left of a sum counts on from 0."""
    left = links.join(gone.select("id"), "id", "left_anti")
    return left.withColumn("track", F.row_number().over(Window.partitionBy("sheet", "row", "col").orderBy("track")) - 1)


def _inside(row: Column, col: Column) -> Column:
    return row.between(F.col("row0"), F.col("row1")) & col.between(F.col("col0"), F.col("col1"))


def selected(links: DataFrame, selections: DataFrame) -> DataFrame:
    """Links whose cell lies in a selected range (sheet, row0, row1, col0, col1). Ranges of a sheet are few and stand as one
    list beside its links, so no pair of link and range is formed."""
    ranges = selections.groupBy("sheet").agg(F.collect_list(F.struct("row0", "row1", "col0", "col1")).alias("_ranges"))
    hit = F.exists("_ranges", lambda r: F.col("row").between(r["row0"], r["row1"]) & F.col("col").between(r["col0"], r["col1"]))
    return links.join(ranges, "sheet").where(hit).drop("_ranges")


def deleted(links: DataFrame, selections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links left, ids deleted) after the links of the selected cells go."""
    gone = selected(links, selections).select("id")
    return links.join(gone, "id", "left_anti"), gone


def moved(links: DataFrame, changes: DataFrame) -> DataFrame:
    """Links with new rectangles and texts: ``changes`` has id, page, x, y, w, h, text, seq; the last of each id holds."""
    last = first_wins(changes, ["id"], [F.col("seq").desc()])
    new = last.select("id", *(F.col(c).alias("_" + c) for c in ("page", "x", "y", "w", "h", "text")))
    t = links.join(new, "id", "left")
    return t.select(*[F.coalesce("_" + c, c).alias(c) if c in ("page", "x", "y", "w", "h", "text") else F.col(c) for c in links.columns])


def undone(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links left, the one undone) of each sheet: the link created last goes; entries of links deleted since don't count."""
    last = links.groupBy("sheet").agg(F.max_by("id", F.struct("seq", "id")).alias("id"))
    return links.join(last.select("id"), "id", "left_anti"), links.join(last.select("id"), "id", "left_semi")


def covered_conflicts(content: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(sheet, conflicts): cells with content that a table's new range covers and its old one didn't. ``old``, ``new``: sheet,
    row0, row1, col0, col1, one range a sheet; ``content``: sheet, row, col, text."""
    was = old.select("sheet", F.struct("row0", "row1", "col0", "col1").alias("was"))
    t = content.where(F.trim("text") != "").join(new, "sheet").join(was, "sheet", "left")
    before = F.col("row").between(F.col("was.row0"), F.col("was.row1")) & F.col("col").between(F.col("was.col0"), F.col("was.col1"))
    return t.where(_inside(F.col("row"), F.col("col")) & ~F.coalesce(before, F.lit(False))).groupBy("sheet").agg(F.count("*").alias("conflicts"))


def synced(links: DataFrame, positions: DataFrame) -> DataFrame:
    """Links at the addresses their names have now; those whose name is broken (``broken``) go, those without a name stay
    where they were. ``positions``: id, sheet, row, col, broken."""
    now = positions.select("id", *(F.col(c).alias("_" + c) for c in ("sheet", "row", "col")), "broken")
    t = links.join(now, "id", "left").where(~F.coalesce("broken", F.lit(False)))
    return t.select(*[F.coalesce("_" + c, c).alias(c) if c in ("sheet", "row", "col") else F.col(c) for c in links.columns])


def bindings(links: DataFrame, names: DataFrame) -> DataFrame:
    """(id, action): names to create for links without one, names to delete that no link has. ``names``: id."""
    make = links.select("id").distinct().join(names.select("id"), "id", "left_anti").withColumn("action", F.lit("create"))
    return make.union(names.select("id").distinct().join(links.select("id"), "id", "left_anti").withColumn("action", F.lit("delete")))


def copied(link: DataFrame, targets: DataFrame) -> DataFrame:
    """A table link repeated on other pages, below each other in page order: one target a page, never the link's own page.
    ``link``: one row with rows (its height in the sheet); ``targets``: page, rows, seq (the first of a page counts)."""
    own = link.select(F.col("page").alias("own"), "sheet", "row", "col", F.col("rows").alias("own_rows"), "doc", "kind")
    one = first_wins(targets, ["page"], [F.col("seq")])
    t = one.withColumn("_k", F.lit(1)).join(F.broadcast(own.withColumn("_k", F.lit(1))), "_k").drop("_k").where("page <> own")  # one row beside each
    above = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)  # a table's copies: as many as pages asked for
    return t.select("doc", "page", "sheet", (F.col("row") + F.col("own_rows") + F.coalesce(F.sum("rows").over(above), F.lit(0))).alias("row"), "col", "kind")


def filed(documents: DataFrame, moves: DataFrame) -> DataFrame:
    """Documents in the folder they were last moved to. ``moves``: id, folder, seq."""
    last = first_wins(moves, ["id"], [F.col("seq").desc()]).select("id", F.col("folder").alias("_folder"))
    return documents.join(last, "id", "left").withColumn("folder", F.coalesce("_folder", "folder")).drop("_folder")


def document_status(stored: Column, has_text: Column, has_bytes: Column) -> Column:
    """ready, pending or missing: what was stored if it is one of these, else as the document's text and bytes tell."""
    low = F.lower(F.trim(stored))
    return F.when(low.isin("ready", "pending", "missing", "failed"), low).when(has_text, "ready").when(has_bytes, "pending").otherwise("missing")


def link_target(category: Column, kind: Column, text: Column, box: Column, segments: Column) -> Column:
    """(box, text) that a click on a span links: a date wrapped over lines of one page takes the box around both, a
    reference its printed text, structure and noise nothing. ``segments``: array of (page, box)."""
    from parchmint.operators.evidence import united

    one_page = F.size(F.array_distinct(F.transform(segments, lambda s: s["page"]))) == 1
    around = F.when((kind == "date") & (F.size(segments) > 1) & one_page, united(F.transform(segments, lambda s: s["box"]))).otherwise(box)
    return F.when(category.isin("value", "reference"), F.struct(around.alias("box"), text.alias("text")))


def key_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(row, ord, key): the filled keys of each row that has one."""
    each = F.posexplode(F.array(*[F.col(k).cast("string") for k in keys]))
    return rows.select("row", each.alias("ord", "key")).where(F.trim(F.coalesce("key", F.lit(""))) != "")


def signed_equation(target: Column, operands: Column, sort: str = "decimal(38,10)") -> Column:
    """(state, sum, difference) of a reviewed equation: operands (value, sign) against a target; not-evaluable where any is
    missing."""
    missing = target.isNull() | (F.size(operands) == 0) | F.exists(operands, lambda o: o["value"].isNull())
    total = F.aggregate(operands, F.lit(0).cast(sort), lambda a, o: (a + F.when(o["sign"] < 0, -o["value"]).otherwise(o["value"])).cast(sort))
    miss = (target - total).cast(sort)
    state = F.when(missing, "not-evaluable").when(miss == 0, "exact-match").otherwise("difference")
    return F.struct(state.alias("state"), F.when(~missing, total).alias("sum"), F.when(~missing, miss).alias("difference"))


def scan_equations(totals: DataFrame) -> DataFrame:
    """(id, block, row, col, axis, operands, decision): each confirmed or broken total as an equation to review, keyed by
    what it says; of equal ones the first counts. ``totals``: as ``footing.totals`` gives them."""
    signs = F.transform("members", lambda m: F.struct(m.alias("row"), F.when(F.array_contains("taken", m), -1).otherwise(1).alias("sign")))
    said = F.concat_ws("|", F.col("block").cast("string"), "axis", F.col("row").cast("string"), F.col("col").cast("string"), F.array_join(F.transform("members", lambda m: m.cast("string")), ","), F.array_join(F.transform("taken", lambda m: m.cast("string")), ","))
    t = totals.where("members is not null").select(F.concat(F.lit("eq-"), F.substring(F.sha2(said, 256), 1, 16)).alias("id"), "block", "row", "col", "axis", signs.alias("operands"), F.lit("unreviewed").alias("decision"))
    return first_wins(t, ["id"], [F.col("row"), F.col("col")])


def faulty_equations(spark: SparkSession, drafts: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, fault) of drafts that can't stand: unknown cells, fewer than two operands, one twice, a target that depends on
    itself, or an operand beside a part of it. ``drafts``: id, target, operands (array of cells); ``anchors``: cell."""
    from parchmint.operators.library import descendants

    flat = drafts.select("id", "target", F.explode_outer("operands").alias("operand"))
    cells = flat.select("id", F.col("target").alias("cell")).union(flat.select("id", "operand")).where("cell is not null").distinct()
    unknown = cells.join(anchors.select("cell"), "cell", "left_anti").select("id", F.lit("unknown-cell").alias("fault"))
    few = drafts.where(F.size("operands") < 2).select("id", F.lit("too-few-operands").alias("fault"))
    twice = drafts.where(F.size("operands") > F.size(F.array_distinct("operands"))).select("id", F.lit("duplicate-operand").alias("fault"))
    edges = flat.where("operand is not null").select(F.col("target").alias("parent"), F.col("operand").alias("child")).distinct()
    paths = descendants(spark, edges)
    cycle = drafts.join(paths.where("parent = child").select(F.col("parent").alias("target")), "target", "left_semi").select("id", F.lit("cycle").alias("fault"))
    pairs = flat.select("id", F.col("operand").alias("parent")).join(paths, "parent")
    inside = pairs.join(flat.select("id", F.col("operand").alias("child")), ["id", "child"], "left_semi").where("parent <> child").select("id", F.lit("subtotal-and-part").alias("fault"))
    return unknown.union(few).union(twice).union(cycle).union(inside).distinct()


_STATES = ("accepted", "rejected", "unreviewed")


def review_operations(rows: list[dict]) -> list[dict]:
    """The workspace of one document after batches of operations, each applied whole or not at all. Operations: equation
    (target becomes known), decision, correction and value (a cell's figure), issue, restore (as of a revision), page."""
    state: dict = {"equations": {}, "values": {}, "issues": set(), "pages": set()}
    history = [_frozen(state)]
    for batch in sorted({r["batch"] for r in rows}):
        draft, fine = _thawed(history[-1]), True
        for r in sorted((r for r in rows if r["batch"] == batch), key=lambda r: r["seq"]):
            op, key, value = r["op"], r["key"], r["value"]
            if op == "equation":
                draft["equations"].setdefault(key, "unreviewed")
            elif op == "decision" and key in draft["equations"] and value in _STATES:
                draft["equations"][key] = value
            elif op in ("correction", "value") and _decimal(value) is not None:
                draft["values"][key] = str(_decimal(value))
            elif op in ("issue", "page"):
                draft[op + "s"].add(key)
            elif op == "restore" and (value or "").isdigit() and int(value) < len(history):
                draft = _thawed(history[int(value)])
            else:
                fine = False
        if fine:
            history.append(_frozen(draft))
    last = history[-1]
    out = [("equation", k, v) for k, v in last[0]] + [("value", k, v) for k, v in last[1]] + [("issue", k, None) for k in last[2]] + [("page", k, None) for k in last[3]]
    return [{"doc": rows[0]["doc"], "what": w, "key": k, "value": v, "revision": len(history) - 1} for w, k, v in out]


def _decimal(text: str | None) -> Decimal | None:
    try:
        return Decimal(text).normalize()
    except ArithmeticError:
        return None
    except TypeError:
        return None


def _frozen(s: dict) -> tuple:
    return tuple(sorted(s["equations"].items())), tuple(sorted(s["values"].items())), tuple(sorted(s["issues"])), tuple(sorted(s["pages"]))


def _thawed(f: tuple) -> dict:
    return {"equations": dict(f[0]), "values": dict(f[1]), "issues": set(f[2]), "pages": set(f[3])}


def review_workspaces(operations: DataFrame) -> DataFrame:
    """(doc, what, key, value, revision); ``operations``: doc, batch, seq, op, key, value. A document's history is one group."""
    return _grouped(operations.select("doc", "batch", "seq", "op", "key", "value"), ["doc"], review_operations, "doc long, what string, key string, value string, revision int")


def staleness(results: DataFrame, documents: DataFrame, version: str) -> DataFrame:
    """(doc, state): stored results that are current, made by another version, of another geometry, or missing.
    ``results``: doc, version, fingerprint; ``documents``: doc, fingerprint."""
    r = results.select("doc", "version", F.col("fingerprint").alias("of"))
    state = F.when(F.col("version").isNull(), "missing").when(F.col("version") != version, "other-version").when(F.col("of") != F.col("fingerprint"), "other-geometry").otherwise("current")
    return documents.join(r, "doc", "left").select("doc", state.alias("state"))


def fingerprint(parts: Column) -> Column:
    """Sixteen hex digits of what a structure says."""
    return F.substring(F.sha2(F.to_json(parts), 256), 1, 16)
