"""Page geometry from what readers give: placed text items, recognised words, nested artifacts; turned and cropped pages."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions import scalars
from parchmint.operators.geometry import _grouped


def item_box(item: Column, view: Column, width: Column, height: Column, ascent: Column, descent: Column) -> Column:
    """(x0, y0, x1, y1), in shares of the page, of a placed text item. ``item``: struct (m: its six matrix numbers, width,
    height); ``view``: the page's six. Corners lie at the ascent and the descent of both ends of the base line."""
    m, v = lambda i: F.get(item["m"], F.lit(i)), lambda i: F.get(view, F.lit(i))
    t = [v(0) * m(0) + v(2) * m(1), v(1) * m(0) + v(3) * m(1), v(0) * m(2) + v(2) * m(3), v(1) * m(2) + v(3) * m(3), v(0) * m(4) + v(2) * m(5) + v(4), v(1) * m(4) + v(3) * m(5) + v(5)]
    long = lambda a, b: F.sqrt(a * a + b * b)
    ratio = lambda shown, raw: F.when(raw > 0, shown / raw).otherwise(1.0)
    inline, block = long(t[0], t[1]), long(t[2], t[3])
    length, em = item["width"] * ratio(inline, long(m(0), m(1))), item["height"] * ratio(block, long(m(2), m(3)))
    unit = lambda a, size, none: F.when(size > 0, a / size).otherwise(none)
    ix, iy, bx, by = unit(t[0], inline, 1.0), unit(t[1], inline, 0.0), unit(t[2], block, 0.0), unit(t[3], block, -1.0)
    xs = [t[4] + e * ix * length + a * bx * em for e in (0, 1) for a in (ascent, descent)]
    ys = [t[5] + e * iy * length + a * by * em for e in (0, 1) for a in (ascent, descent)]
    return F.struct((F.least(*xs) / width).alias("x0"), (F.least(*ys) / height).alias("y0"), (F.greatest(*xs) / width).alias("x1"), (F.greatest(*ys) / height).alias("y1"))


def word_glyphs(words: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(keep, i, char, x0, y0, x1, y1): a word's box split evenly into its characters. ``words``: keep, text, x0, y0, x1, y1."""
    n, each = F.length("text"), F.posexplode(F.split("text", "")).alias("i", "char")
    w = words.where(n > 0).withColumn("_step", (F.col("x1") - F.col("x0")) / n).select(*keep, each, "x0", "_step", "y0", "y1")
    x0 = F.col("x0") + F.col("i") * F.col("_step")
    return w.select(*keep, "i", "char", x0.alias("x0"), "y0", (x0 + F.col("_step")).alias("x1"), "y1")


def hocr_glyphs(pages: DataFrame) -> DataFrame:
    """(doc, page, word, i, char, x0, y0, x1, y1, confidence): the glyphs of an hOCR page, in shares of its size. ``pages``:
    doc, page, hocr, width, height."""
    from parchmint.sources.decoders import hocr_words

    w = pages.select("doc", "page", "width", "height", F.posexplode(hocr_words(F.col("hocr"))).alias("word", "w"))
    w = w.select("doc", "page", "word", "w.text", (F.col("w.x0") / F.col("width")).alias("x0"), (F.col("w.y0") / F.col("height")).alias("y0"), (F.col("w.x1") / F.col("width")).alias("x1"), (F.col("w.y1") / F.col("height")).alias("y1"), F.col("w.confidence").alias("confidence"))
    return word_glyphs(w, ("doc", "page", "word", "confidence"))


def text_pages(texts: DataFrame, lines_per_page: int = 60, columns: int = 100) -> DataFrame:
    """(doc, page, line, text, x0, y0, x1, y1): plain text set on pages: long lines wrapped, sixty lines a page, an even
    pitch. ``texts``: doc, text."""
    wrapped = F.flatten(F.transform(F.split("text", r"\r?\n"), lambda t: F.when(t == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(t, F.lit(rf".{{1,{columns}}}"), F.lit(0)))))
    t = texts.select("doc", F.posexplode(wrapped).alias("n", "text"))
    page, line = F.floor(F.col("n") / lines_per_page).cast("int"), (F.col("n") % lines_per_page).cast("int")
    y0 = 0.05 + line * (0.9 / lines_per_page)
    return t.select("doc", page.alias("page"), line.alias("line"), "text", F.lit(0.05).alias("x0"), y0.alias("y0"), (0.05 + F.length("text") * (0.9 / columns)).alias("x1"), (y0 + 0.8 * 0.9 / lines_per_page).alias("y1"))


def entries(artifacts: DataFrame) -> DataFrame:
    """(doc, page, i, char, line, x0, y0, x1, y1) of nested geometry. ``artifacts``: doc, geometry: struct (pages: array of
    (pageIndex, characters: array of (char, x, y, width, height, lineIndex)))."""
    p = artifacts.select("doc", F.explode("geometry.pages").alias("p")).select("doc", F.col("p.pageIndex").alias("page"), F.posexplode("p.characters").alias("i", "c"))
    return p.select("doc", "page", "i", "c.char", F.col("c.lineIndex").alias("line"), F.col("c.x").alias("x0"), F.col("c.y").alias("y0"), (F.col("c.x") + F.col("c.width")).alias("x1"), (F.col("c.y") + F.col("c.height")).alias("y1"))


def valid_spans(spans: Column) -> Column:
    """Spans of an artifact that can be used; malformed ones (no id, kind or text, a box off the page) are dropped, the rest
    stays. ``spans``: array of (id, kind, text, bounds (x, y, width, height))."""
    inside = lambda b: b.isNotNull() & b["x"].between(0, 1) & b["y"].between(0, 1) & (b["width"] > 0) & (b["height"] > 0)
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return F.filter(spans, lambda s: F.coalesce(filled(s["id"]) & filled(s["kind"]) & filled(s["text"]) & inside(s["bounds"]), F.lit(False)))


def valid_tables(tables: Column) -> Column:
    """Tables of an artifact with at least one row and two columns whose bands are in order. ``tables``: array of (id,
    columns: array of (x0, x1), rows: array of (y0, y1))."""
    ordered = lambda bands, lo, hi: F.forall(bands, lambda b: b[lo] < b[hi])
    good = lambda t: t["id"].isNotNull() & (F.size(t["columns"]) >= 2) & (F.size(t["rows"]) >= 1) & ordered(t["columns"], "x0", "x1") & ordered(t["rows"], "y0", "y1")
    return F.filter(tables, lambda t: F.coalesce(good(t), F.lit(False)))


def turned_pages(glyphs: DataFrame, turns: DataFrame) -> DataFrame:
    """Glyphs with each page turned back by its accepted quarter turns. ``glyphs``: doc, page, x, y, w, h, more; ``turns``:
    doc, page, turns."""
    t = glyphs.join(turns.select("doc", "page", "turns"), ["doc", "page"], "left")
    box = scalars.rotated(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.coalesce("turns", F.lit(0)))
    return t.withColumn("_b", box).select(*[F.col("_b." + c).alias(c) if c in ("x", "y", "w", "h") else F.col(c) for c in glyphs.columns])


def uncropped(glyphs: DataFrame, clips: DataFrame) -> DataFrame:
    """Glyphs of a cropped page in shares of the whole page. ``clips``: doc, page, cx, cy, cw, ch."""
    t = glyphs.join(clips, ["doc", "page"], "left")
    at = {"x": F.col("cx") + F.col("x") * F.col("cw"), "y": F.col("cy") + F.col("y") * F.col("ch"), "w": F.col("w") * F.col("cw"), "h": F.col("h") * F.col("ch")}
    return t.select(*[F.coalesce(at[c], F.col(c)).alias(c) if c in at else F.col(c) for c in glyphs.columns])


def line_signature(text: Column, x: Column, y: Column, w: Column, h: Column, visible: Column) -> Column:
    """What makes two raw lines the same: text, box to a thousandth, and whether it shows."""
    return F.struct(scalars.collapsed(text).alias("text"), *(F.round(c, 3).alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))), visible.alias("visible"))


def selection_text(found: list[dict]) -> list[dict]:
    """The text of one rectangle: glyphs with three tenths of their area inside, in reading order. Source lines that share
    seven tenths of their height are one; small raised or lowered pieces join the line beside them; a space stands where a
    gap is wider than half a glyph."""
    rows: dict[int, list[dict]] = {}
    for g in found:
        w, h = min(g["x1"], g["rx1"]) - max(g["x0"], g["rx0"]), min(g["y1"], g["ry1"]) - max(g["y0"], g["ry0"])
        area = (g["x1"] - g["x0"]) * (g["y1"] - g["y0"])
        if w > 0 and h > 0 and area > 0 and w * h >= 0.3 * area:
            rows.setdefault(g["line"], []).append(g)
    lines: list[list[dict]] = []
    for _, line in sorted(rows.items()):
        same = next((k for k in lines if _over(k, line) >= 0.7 and not _is_script(line, k) and not _is_script(k, line)), None)
        lines.append(line) if same is None else same.extend(line)
    for script in sorted(lines, key=_tall):
        base = [k for k in lines if k is not script and _is_script(script, k)]
        if base:
            nearest = min(base, key=lambda k: _gap(script, k) - _over(script, k))
            nearest.extend(script)
            lines = [k for k in lines if k is not script]
    out = []
    for line in lines:
        text, last = "", None
        for g in sorted(line, key=lambda g: (g["x0"], g["y0"])):
            if last is not None and g["x0"] - last["x1"] > 0.5 * (last["x1"] - last["x0"]) and not text.endswith(" "):
                text += " "
            text += g["char"]
            last = g
        out.append(re.sub(r" {2,}", " ", text).strip())
    return [{"region": found[0]["region"], "text": "\n".join(t for t in out if t)}]


def _tall(line: list[dict]) -> float:
    heights = sorted(g["y1"] - g["y0"] for g in line)
    return heights[len(heights) // 2]


def _over(a: list[dict], b: list[dict]) -> float:
    top, bottom = max(min(g["y0"] for g in a), min(g["y0"] for g in b)), min(max(g["y1"] for g in a), max(g["y1"] for g in b))
    low = min(max(g["y1"] for g in k) - min(g["y0"] for g in k) for k in (a, b))
    return max(0.0, bottom - top) / low if low > 0 else 0.0


def _gap(a: list[dict], b: list[dict]) -> float:
    return max(0.0, max(min(g["x0"] for g in a), min(g["x0"] for g in b)) - min(max(g["x1"] for g in a), max(g["x1"] for g in b)))


def _is_script(script: list[dict], base: list[dict]) -> bool:
    """Whether a line is a small, narrow piece raised or lowered beside another one."""
    width = max(g["x1"] for g in script) - min(g["x0"] for g in script)
    wide = sorted(g["x1"] - g["x0"] for g in base)[len(base) // 2]
    return _tall(script) < 0.8 * _tall(base) and _over(script, base) >= 0.25 and width <= max(6 * wide, 0.35 * (max(g["x1"] for g in base) - min(g["x0"] for g in base))) and _gap(script, base) <= 2 * wide


def selected_texts(glyphs: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, text); ``glyphs``: page, line, char, x0, y0, x1, y1; ``regions``: region, page, x0, y0, x1, y1."""
    r = regions.select("region", "page", *(F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")))
    return _grouped(glyphs.join(r, "page").drop("page"), ["region"], selection_text, "region long, text string")


_TEXT_MARKS = (rb"/ToUnicode", rb"/Font"), (rb"/Encoding", rb"/Font")
_SHOWS_TEXT = re.compile(rb"\bBT\b.*?\b(?:Tj|TJ)\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)


def has_text_layer(content: bytes | None) -> bool:
    """Whether a PDF's bytes show text that can be read: fonts with a character map or an encoding, or text operators, as
    they are or within deflated streams."""
    if not content:
        return False
    if any(all(m in content for m in marks) for marks in _TEXT_MARKS) or _SHOWS_TEXT.search(content):
        return True
    for m in _STREAM.finditer(content):
        try:
            inner = zlib.decompressobj().decompress(m[1], 1 << 20)
        except zlib.error:
            continue
        if any(all(k in inner for k in marks) for marks in _TEXT_MARKS) or _SHOWS_TEXT.search(inner):
            return True
    return False


def _layers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = ["text" if has_text_layer(c) else "none" for c in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["path", "layer"])


def text_layers(files: DataFrame) -> DataFrame:
    """(path, layer): text or none, per file."""
    return files.select("path", "content").mapInArrow(_layers, "path string, layer string")
