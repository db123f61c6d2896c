"""Workbooks from their bytes: cells of OOXML and ODF sheets, merges and repetitions spread, rows padded, and as HTML."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sheets, rows and columns of a workbook that are read; a sheet with more says so in ``truncated``.
SHEETS, ROWS, COLUMNS = 50, 5000, 256
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_TABLE, _OFFICE, _TEXT = (f"{{urn:oasis:names:tc:opendocument:xmlns:{n}:1.0}}" for n in ("table", "office", "text"))
_CELL = re.compile(r"([A-Z]+)([0-9]+)")


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def _place(ref: str) -> tuple[int, int]:
    m = _CELL.fullmatch(ref)
    return int(m[2]), column_number(m[1])


def ooxml_sheets(content: bytes) -> list[dict]:
    """Sheets of an OOXML workbook: name, cells {(row, column): text}, merges [(row, column, rows, columns)]."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(_MAIN + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(_MAIN + "si")]
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_MAIN + "sheet"):
            target = rels[sheet.get(_REL + "id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else "xl/" + target))
            cells = {}
            for c in root.iter(_MAIN + "c"):
                value = c.find(_MAIN + "v")
                kind = c.get("t")
                text = "".join(t.text or "" for t in c.iter(_MAIN + "t")) if kind == "inlineStr" else "" if value is None else value.text or ""
                if kind == "s" and text:
                    text = shared[int(text)]
                if kind == "b":
                    text = "TRUE" if text == "1" else "FALSE"
                if text:
                    cells[_place(c.get("r"))] = text
            merges = []
            for m in root.iter(_MAIN + "mergeCell"):
                first, last = (_place(r) for r in m.get("ref").split(":"))
                merges.append((*first, last[0] - first[0] + 1, last[1] - first[1] + 1))
            out.append({"name": sheet.get("name"), "cells": cells, "merges": merges})
    return out


def odf_sheets(content: bytes) -> list[dict]:
    """Sheets of an ODF workbook, repeated rows and cells spread; repetitions of nothing at the end are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    out = []
    for sheet in root.iter(_TABLE + "table"):
        cells, merges, r = {}, [], 0
        for row in sheet.iter(_TABLE + "table-row"):
            times, k, filled = int(row.get(_TABLE + "number-rows-repeated", 1)), 0, []
            for c in row:
                if c.tag not in (_TABLE + "table-cell", _TABLE + "covered-table-cell"):
                    continue
                n = int(c.get(_TABLE + "number-columns-repeated", 1))
                text = "\n".join("".join(p.itertext()) for p in c.findall(_TEXT + "p")) or c.get(_OFFICE + "value", "")
                if text:
                    filled += [(k + i + 1, text) for i in range(min(n, COLUMNS))]
                spans = int(c.get(_TABLE + "number-rows-spanned", 1)), int(c.get(_TABLE + "number-columns-spanned", 1))
                if spans != (1, 1):
                    merges.append((r + 1, k + 1, *spans))
                k += n
            if filled:
                for i in range(min(times, ROWS + 1)):
                    cells |= {(r + i + 1, col): text for col, text in filled}
            r += times
        out.append({"name": sheet.get(_TABLE + "name"), "cells": cells, "merges": merges})
    return out


def workbook_rows(content: bytes) -> list[dict]:
    """Rows of all sheets, each as long as the sheet is wide, blank rows at the end dropped; a merged area shows its text in
    its first cell only and hides the others (None)."""
    sheets = odf_sheets(content) if b"opendocument.spreadsheet" in content[:200] else ooxml_sheets(content)
    out = []
    for s in sheets[:SHEETS]:
        filled = [at for at, t in s["cells"].items() if t.strip()]
        height, width = max((r for r, _ in filled), default=0), max((c for _, c in filled), default=0)
        hidden = {(r + i, c + j) for r, c, rows, columns in s["merges"] for i in range(rows) for j in range(columns) if i or j}
        cut = len(sheets) > SHEETS or height > ROWS or width > COLUMNS
        for r in range(1, min(height, ROWS) + 1):
            texts = [None if (r, c) in hidden else s["cells"].get((r, c), "") for c in range(1, min(width, COLUMNS) + 1)]
            out.append({"sheet": s["name"], "row": r, "cells": texts, "truncated": cut})
    return out


_ROWS = pa.list_(pa.struct([("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("truncated", pa.bool_())]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, errors = [], []
        for content in batch.column(1).to_pylist():
            try:
                rows.append(workbook_rows(content or b""))
                errors.append(None)
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as e:  # a bad file is a row with its error
                rows.append([])
                errors.append(f"{type(e).__name__}: {e}"[:200])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _ROWS), pa.array(errors, pa.string())], names=["path", "rows", "error"])


def workbooks(files: DataFrame) -> DataFrame:
    """(path, rows, error) of workbook files: one row a file whatever its bytes. ``files``: path, content."""
    return files.select("path", "content").mapInArrow(_read, "path string, rows array<struct<sheet:string,row:int,cells:array<string>,truncated:boolean>>, error string")


def conversion_report(done: DataFrame) -> DataFrame:
    """(status, files): how many files of a batch were read and how many failed."""
    return done.groupBy(F.when(F.col("error").isNull(), "read").otherwise("failed").alias("status")).agg(F.count("*").alias("files"))


def padded(cells: Column, width: Column) -> Column:
    """A row as long as its sheet is wide."""
    return F.concat(cells, F.array_repeat(F.lit("").cast("string"), F.greatest(width - F.size(cells), F.lit(0))))


def html_row(cells: Column, bold: Column) -> Column:
    """A row as HTML; hidden cells (null) have none."""
    safe = lambda t: F.replace(F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\n"), F.lit("<br>"))
    tag = F.when(bold, "th").otherwise("td")
    each = F.transform(F.filter(cells, lambda c: c.isNotNull()), lambda c: F.concat(F.lit("<"), tag, F.lit(">"), safe(c), F.lit("</"), tag, F.lit(">")))
    return F.concat(F.lit("<tr>"), F.array_join(each, ""), F.lit("</tr>"))


def html_tables(rows: DataFrame) -> DataFrame:
    """(path, sheet, html): each sheet as one HTML table, its first row bold. ``rows``: path, sheet, row, cells."""
    t = rows.withColumn("html", html_row(F.col("cells"), F.col("row") == 1)).groupBy("path", "sheet").agg(F.sort_array(F.collect_list(F.struct("row", "html"))).alias("r"))
    return t.select("path", "sheet", F.concat(F.lit("<table>"), F.array_join(F.transform("r", lambda x: x["html"]), ""), F.lit("</table>")).alias("html"))


def with_inline_images(body: str, images: dict[str, tuple[str, bytes]]) -> str:
    """A mail's HTML with the images it names by content id put in its place."""
    import base64

    def one(m: re.Match) -> str:
        found = images.get(html.unescape(m[2]).strip("<>"))
        return m[0] if found is None else f"{m[1]}data:{found[0]};base64,{base64.b64encode(found[1]).decode()}"

    return re.sub(r"""(src\s*=\s*["']?)cid:([^"'\s>]+)""", one, body, flags=re.I)
