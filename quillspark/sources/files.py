"""Scans and sinks of files: delimited text, JSON lines, office documents, workbooks, captured pages."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_META = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_\-]+)", re.I)
#: Elements of a page that start a block of text, and those that are no text.
BLOCKS = frozenset("p div section article li tr td th h1 h2 h3 h4 h5 h6 blockquote pre table ul ol br".split())
SILENT = frozenset(("script", "style", "noscript", "template"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def read_strings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Comma-separated values, every cell a string, a byte-order mark tolerated (A01, A07): ``6.10`` stays ``6.10``. With
    ``columns`` a file whose header differs is an error."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if columns is not None and df.columns != columns:
        raise ValueError(f"columns differ: {df.columns}")
    return df


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a stated schema; blank lines are skipped, broken ones come as ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").json(path, columnNameOfCorruptRecord="_corrupt", mode="PERMISSIVE")


def write_twins(df: DataFrame, path: str, columns: list[str]) -> None:
    """The rows as comma-separated values in a fixed order, and as JSON lines with all columns (B01, B06, B13): lists joined by
    comma, booleans as true and false, nulls empty in the former."""
    flat = [F.array_join(c, ",").alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c) for c in columns]
    df.select(*flat).write.mode("overwrite").csv(f"{path}/csv", header=True, nullValue="", emptyValue="", escape='"')
    df.write.mode("overwrite").json(f"{path}/json")


def append_events(df: DataFrame, path: str) -> None:
    """Events added to a log of JSON lines, never rewritten."""
    df.write.mode("append").json(path)


def sniffed(content: Column) -> Column:
    """What bytes say they are: pdf, docx, zip, ole, rtf, html or other."""
    head = F.hex(F.substring(content, 1, 8))
    low = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.startswith("504B0304") & F.decode(F.substring(content, 1, 4096), "ISO-8859-1").contains("word/"), "docx")
        .when(head.startswith("504B0304"), "zip")
        .when(head.startswith("D0CF11E0A1B11AE1"), "ole")
        .when(head.startswith("7B5C727466"), "rtf")
        .when(low.contains("<html") | low.contains("<!doctype html"), "html")
        .otherwise("other")
    )


def decode(raw: bytes) -> str | None:
    """The declared charset if it works, then UTF-8, then GB 18030, at last Latin-1."""
    if raw is None:
        return None
    declared = _META.search(raw[:2048])
    for enc in ([declared[1].decode()] if declared else []) + ["utf-8", "gb18030"]:
        try:
            return raw.decode(enc)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("latin-1")


class _Blocks(HTMLParser):
    """Text blocks of a page in order, within a container, with headings and anchors."""

    def __init__(self, container: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.container, self.depth, self.inside, self.silent = container, 0, container is None, 0
        self.stop = -1
        self.parts: list[str] = []
        self.kind = "p"
        self.anchor: str | None = None
        self.blocks: list[tuple[str, str, str | None]] = []

    def _close(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        if text:
            self.blocks.append((self.kind, text, self.anchor))
            self.anchor = None
        self.parts = []

    def handle_starttag(self, tag, attrs) -> None:
        a = dict(attrs)
        if tag not in VOID:
            self.depth += 1
        if tag in SILENT:
            self.silent += 1
        if not self.inside and self.container in ((a.get("class") or "").split() + [a.get("id")]):
            self.inside, self.stop = True, self.depth - 1
        if self.inside and tag in BLOCKS:
            self._close()
            self.kind = tag
        if self.inside and (a.get("id") or tag == "a" and a.get("name")):
            self.anchor = a.get("id") or a.get("name")

    def handle_endtag(self, tag) -> None:
        if tag in VOID:
            return
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if self.inside and tag in BLOCKS:
            self._close()
            self.kind = "p"
        self.depth -= 1
        if self.inside and self.depth <= self.stop:
            self._close()
            self.inside, self.stop = False, -1

    def handle_data(self, data) -> None:
        if self.inside and not self.silent:
            self.parts.append(data)


PAGE = "text string, spans array<struct<kind:string,start:int,end:int,anchor:string>>"


def parse_page(html: str | None, container: str | None = None) -> tuple[str, list[tuple[str, int, int, str | None]]] | None:
    """Frozen text of a page and the place of each block in it."""
    if html is None:
        return None
    p = _Blocks(container)
    p.feed(html)
    p.close()
    p._close()
    text, spans = "", []
    for kind, block, anchor in p.blocks:
        start = len(text) + bool(text)
        text += ("\n" if text else "") + block
        spans.append((kind, start, start + len(block), anchor))
    return text, spans


def with_page(df: DataFrame, html: str, into: str, container: str | None = None) -> DataFrame:
    """A column with text and spans of captured pages; null stays null."""

    @F.pandas_udf(PAGE)
    def parse(pages: pd.Series) -> pd.DataFrame:
        done = [parse_page(x, container) for x in pages]
        return pd.DataFrame({"text": [d and d[0] for d in done], "spans": [d and [dict(zip(("kind", "start", "end", "anchor"), s)) for s in d[1]] for d in done]})

    return df.withColumn(into, parse(F.col(html)))


def docx_text(raw: bytes | None) -> str | None:
    """Paragraphs and table cells of an office document in order; ideographic blanks stay."""
    if raw is None:
        return None
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))
    return "\n".join(p for p in paragraphs if p.strip(" \t\r\n"))


def epub_text(raw: bytes | None) -> str | None:
    """All documents of the spine in order; a missing one is an error."""
    if raw is None:
        return None
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        opf = next(n for n in names if n.endswith(".opf"))
        root = ElementTree.fromstring(z.read(opf))
        ns = {"o": "http://www.idpf.org/2007/opf"}
        files = {i.get("id"): i.get("href") for i in root.findall(".//o:manifest/o:item", ns)}
        base = opf.rpartition("/")[0]
        parts = [decode(z.read(f"{base}/{files[r.get('idref')]}".lstrip("/"))) for r in root.findall(".//o:spine/o:itemref", ns)]
    return "\n".join(parse_page(p)[0] for p in parts)


def read_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Binary files as text, a row each: ``path, length, text``, and ``error`` where one can't be read. ``kind`` is html, docx or epub."""
    reader = {"html": decode, "docx": docx_text, "epub": epub_text}[kind]

    @F.pandas_udf("text string, error string")
    def extract(content: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in content:
            try:
                rows.append((reader(raw), None))
            except Exception as e:  # noqa: BLE001 - one bad file is a row, not the end of the job
                rows.append((None, f"{type(e).__name__}: {e}"[:200]))
        return pd.DataFrame(rows, columns=["text", "error"])

    return spark.read.format("binaryFile").load(path).withColumn("x", extract("content")).select("path", "length", "x.text", "x.error")


def workbook(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """A workbook of inline strings (B07, B11), for reports of bounded size: {sheet: (columns, rows)}."""
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'
    sheet = lambda cols, rows: '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [cols, *rows]) + "</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = range(1, len(sheets) + 1)
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>")
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(s[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, s in zip(n, sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        for i, (cols, rows) in zip(n, sheets.values()):
            z.writestr(f"xl/worksheets/sheet{i}.xml", sheet(cols, rows))
    return out.getvalue()


def read_workbook(raw: bytes) -> dict[str, list[list[str]]]:
    """Sheets of a workbook as rows of strings (A12, A14, A15): inline and shared strings, other values as written."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).findall(".//m:sheet", ns)]
        out = {}
        for i, name in enumerate(names, 1):
            rows = []
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{{{ns['m']}}}row"):
                cells = []
                for c in row.findall("m:c", ns):
                    v = c.find("m:v", ns)
                    cells.append(shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text or "" if v is not None else "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")))
                rows.append(cells)
            out[name] = rows
    return out
