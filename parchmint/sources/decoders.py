"""Decoders from raw bytes and marked-up text to rows; file formats by extension."""

from __future__ import annotations

import base64
import csv
import gzip
import io
import json
from collections.abc import Iterator
from email import message_from_bytes, policy

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import scalars

#: Which reader an extension goes to (fixed values).
READERS = {
    "text": ("txt", "log", "md", "markdown", "html", "htm", "xhtml", "rtf"),
    "mail": ("eml", "mht", "mhtml"),
    "sheet": ("csv", "tsv", "xlsx", "xlsm", "xls", "xlsb", "ods"),
    "image": ("png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff", "webp"),
    "layout": ("pdf", "svg", "epub", "xps", "fb2", "cbz", "mobi"),
    "office": ("doc", "docx", "ppt", "pptx", "msg"),
}
SHEET_ROWS, SHEET_COLUMNS = 5000, 256


def reader_of(path: Column) -> Column:
    """The reader of a path by its extension, case ignored; null for unsupported ones."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for name, extensions in READERS.items():
        out = F.when(ext.isin(*extensions), name).otherwise(out)
    return out


def folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """All files under a folder: path, folder, name, reader, content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return raw.select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), name.alias("name"), reader_of(F.col("path")).alias("reader"), "content")


def decoded(content: Column) -> Column:
    """Bytes as text: a UTF-8 or UTF-16 byte-order mark decides, else UTF-8 if valid, else Latin-1."""
    head = F.hex(F.substring(content, 1, 3))
    utf8 = F.try_validate_utf8(content.cast("string"))
    return (
        F.when(head == "EFBBBF", F.decode(F.substring(content, 4, 1 << 30), "UTF-8"))
        .when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16"))
        .otherwise(F.coalesce(utf8, F.decode(content, "ISO-8859-1")))
    )


def html_text(html: Column) -> Column:
    """The visible text of a page: scripts, styles, comments and tags dropped, common entities read, space collapsed."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return scalars.collapsed(t)


def markdown_lines(text: Column) -> Column:
    """Lines of a markdown text as (kind, level, text): headings, bullets, numbered items, paragraphs; blanks dropped."""
    clean = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\*\*|__|\*|_|`)(.+?)\1", "$2"), r"\[([^\]]*)\]\([^)]*\)", "$1")

    def one(line: Column) -> Column:
        head, bullet, item = (F.regexp_extract(line, p, 1) for p in (r"^(#{1,6})\s+\S", r"^\s*([-*+])\s+\S", r"^\s*([0-9]+)[.)]\s+\S"))
        kind = F.when(head != "", "heading").when(bullet != "", "bullet").when(item != "", "item").otherwise("paragraph")
        body = F.regexp_replace(line, r"^(?:#{1,6}\s+|\s*[-*+]\s+|\s*[0-9]+[.)]\s+)", "")
        return F.struct(kind.alias("kind"), F.length(head).alias("level"), F.trim(clean(body)).alias("text"))

    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x) != ""), one)


def sniffed(head: str) -> str:
    """The delimiter of a table's first lines: of comma, semicolon, tab and bar the one with the steadiest count."""
    lines = [x for x in head[:8192].splitlines() if x.strip()][:20]
    counts = {d: [x.count(d) for x in lines] for d in ",;\t|"}
    steady = {d: (sum(n == max(set(c), key=c.count) for n in c), max(set(c), key=c.count)) for d, c in counts.items() if c and max(set(c), key=c.count) > 0}
    return max(steady, key=lambda d: (steady[d], -",;\t|".index(d))) if steady else ","


def delimited(text: str) -> tuple[list[tuple[int, int, str]], bool]:
    """(row, column, text) of a delimited text within the sheet limits, trailing blank rows dropped; and whether the text has
    more rows or columns than are kept."""
    rows, cut = [], False
    for n, r in enumerate(csv.reader(io.StringIO(text), delimiter=sniffed(text))):
        if n >= SHEET_ROWS:
            cut = cut or any(c.strip() for c in r)
            continue
        cut = cut or len(r) > SHEET_COLUMNS
        rows.append(r[:SHEET_COLUMNS])
    while rows and not any(c.strip() for c in rows[-1]):
        rows.pop()
    return [(i, j, c) for i, r in enumerate(rows, 1) for j, c in enumerate(r, 1)], cut


def sheet_cells(text: str) -> list[tuple[int, int, str]]:
    return delimited(text)[0]


def mail_parts(content: bytes) -> dict:
    """Six header fields, the body (HTML before plain text, its images by content id put in), and the names of attachments."""
    from parchmint.sources.sheets import with_inline_images

    m = message_from_bytes(content, policy=policy.default)
    body = m.get_body(("html", "plain"))
    text = body.get_content() if body else ""
    images = {str(p["content-id"]).strip("<> "): (p.get_content_type(), p.get_payload(decode=True) or b"") for p in m.walk() if p.get_content_maintype() == "image" and p["content-id"]}
    if images and body.get_content_subtype() == "html":
        text = with_inline_images(text, images)
    out = {h: str(m[h]) if m[h] is not None else None for h in ("from", "to", "cc", "bcc", "date", "subject")}
    return out | {"body": text, "attachments": [a.get_filename() or "" for a in m.iter_attachments() if a.get_content_disposition() == "attachment"]}


_MAIL = pa.struct([*((h, pa.string()) for h in ("from", "to", "cc", "bcc", "date", "subject", "body")), ("attachments", pa.list_(pa.string()))])
MAIL = "struct<from:string,to:string,cc:string,bcc:string,date:string,subject:string,body:string,attachments:array<string>>"


def _mails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, errors = [], []
        for content in batch.column(1).to_pylist():
            try:
                out.append(mail_parts(content or b""))
                errors.append(None)
            except (LookupError, ValueError, UnicodeError) as e:  # one bad file is a row with its error, not a failed job
                out.append(None)
                errors.append(str(e)[:200])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _MAIL), pa.array(errors, pa.string())], names=["path", "mail", "error"])


def mails(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInArrow(_mails, f"path string, mail {MAIL}, error string")


def artifact(value: object) -> str:
    return base64.b64encode(gzip.compress(json.dumps(value, separators=(",", ":")).encode(), mtime=0)).decode()


def read_artifact(text: str) -> object:
    return json.loads(gzip.decompress(base64.b64decode(text)))


def hocr_words(hocr: Column) -> Column:
    """(text, x0, y0, x1, y1, confidence) of each recognised word of an hOCR page."""
    tag = r"""(?s)<span[^>]*class=['"]ocrx_word['"][^>]*title=['"]bbox (\d+) (\d+) (\d+) (\d+)[^'"]*?(?:x_wconf (\d+))?['"][^>]*>(.*?)</span>"""
    got = [F.regexp_extract_all(hocr, F.lit(tag), F.lit(i)) for i in range(1, 7)]
    both = F.arrays_zip(*(g.alias(n) for g, n in zip(got, ("x0", "y0", "x1", "y1", "wconf", "raw"), strict=True)))
    num = lambda c: c.try_cast("int")
    words = F.transform(both, lambda w: F.struct(F.trim(F.regexp_replace(w["raw"], "<[^>]*>", "")).alias("text"), *(num(w[n]).alias(n) for n in ("x0", "y0", "x1", "y1")), num(w["wconf"]).alias("confidence")))
    return F.filter(words, lambda w: w["text"] != "")
