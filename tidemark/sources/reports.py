"""Reports as DOCX and PDF files, and the paragraphs of a DOCX file read back."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

#: The input: one row for each report. A source of kind chatbi_result has a question, an answer and a table, rag_evidence a snippet and pages.
SCHEMA = """report_id string, title string, sections array<struct<title: string, content: string, sources: array<struct<id: string, kind: string, title: string,
page_start: int, page_end: int, snippet: string, question: string, answer: string, columns: array<string>, rows: array<array<string>>>>>>"""
#: Bounds of a report, of a table in it, and of a printed page.
MOST_SECTIONS, MOST_SOURCES, MOST_CHARS, MOST_CELLS = 100, 256, 1_000_000, 50_000
TABLE_ROWS, TABLE_COLUMNS, PRINTED_CELLS = 100, 50, 20
LINE_CHARS, LINES, REFERENCES = 46, 56, "参考来源"
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


class ReportTooLarge(ValueError):
    """A report is over a bound; nothing of it is rendered."""


def _clean(text) -> str:
    return _CONTROL.sub("", "" if text is None else str(text))


def marker(source_id: str) -> str:
    """A short mark of a source that stays the same in every rendering."""
    return "S-" + str(source_id).replace("-", "").upper()[:12]


def _reference(source: dict) -> str:
    first, last = source["page_start"], source["page_end"]
    return f"[{marker(source['id'])}] {_clean(source['title'])}" + ("" if first is None else f"，第 {first}–{last or first} 页")


def items(report: dict) -> list[tuple[str, object]]:
    """(style, text) and ("table", rows) of a report from top to bottom; ReportTooLarge if it is over a bound."""
    sections = report["sections"] or []
    sources = [s for section in sections for s in section["sources"] or []]
    found: list[tuple[str, object]] = [("Title", _clean(report["title"]))]
    for section in sections:
        found.append(("Heading1", _clean(section["title"])))
        found += [("", line) for line in _clean(section["content"]).splitlines() or [""]]
        for s in section["sources"] or []:
            found.append(("Heading2", _reference(s)))
            asked = s["kind"] == "chatbi_result"
            told = [("问题：", s["question"]), ("回答：", s["answer"])] if asked else [("", s["snippet"])] if s["kind"] == "rag_evidence" else []
            found += [("", lead + _clean(text)) for lead, text in told if text]
            if s["columns"]:
                found.append(("table", [[_clean(c) for c in row] for row in [s["columns"], *(s["rows"] or [])]]))
    chars = sum(len(x) if isinstance(x, str) else sum(len(c) for row in x for c in row) for _, x in found)
    cells = sum(len(s["columns"] or []) * len(s["rows"] or []) for s in sources if s["kind"] == "chatbi_result")
    if len(sections) > MOST_SECTIONS or len(sources) > MOST_SOURCES or chars > MOST_CHARS or cells > MOST_CELLS:
        raise ReportTooLarge(f"{len(sections)} sections, {len(sources)} sources, {chars} characters, {cells} cells")
    return [*found, ("Heading1", REFERENCES), *(("", _reference(s)) for s in sources)]


def docx(report: dict) -> bytes:
    """An office document; equal reports give equal bytes. Of a table the first 100 rows and 50 columns are shown."""

    def paragraph(text: str, style: str = "") -> str:
        named = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{named}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    body = []
    for style, what in items(report):
        if style != "table":
            body.append(paragraph(what, style))
        else:
            rows = ("".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in row[:TABLE_COLUMNS]) for row in what[: TABLE_ROWS + 1])
            body.append("<w:tbl>" + "".join(f"<w:tr>{row}</w:tr>" for row in rows) + "</w:tbl>")
    head, package = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{"".join(body)}<w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, xml in parts.items():
            archive.writestr(zipfile.ZipInfo(name), (head + xml).encode(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def pdf(report: dict) -> bytes:
    """A printable file in a font that readers have for Chinese; equal reports give equal bytes. Of a table 20 rows and columns are shown."""
    lines = []
    for style, what in items(report):
        shown = [what] if style != "table" else [" | ".join(row[:PRINTED_CELLS]) for row in what[: PRINTED_CELLS + 1]]
        lines += [(style, text[at : at + LINE_CHARS]) for text in shown for at in range(0, max(len(text), 1), LINE_CHARS)]
    pages = [lines[at : at + LINES] for at in range(0, len(lines), LINES)]
    font = "<< /Type /Font /Subtype /Type0 /BaseFont /STSong-Light /Encoding /UniGB-UTF16-H /DescendantFonts [4 0 R] >>"
    inner = "<< /Type /Font /Subtype /CIDFontType0 /BaseFont /STSong-Light /CIDSystemInfo << /Registry (Adobe) /Ordering (GB1) /Supplement 4 >> /DW 1000 /FontDescriptor 5 0 R >>"
    metrics = "<< /Type /FontDescriptor /FontName /STSong-Light /Flags 6 /FontBBox [-25 -254 1000 880] /ItalicAngle 0 /Ascent 752 /Descent -271 /CapHeight 737 /StemV 58 >>"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{6 + 2 * k} 0 R' for k in range(len(pages)))}] >>".encode(), font.encode(), inner.encode(), metrics.encode()]
    for k, page in enumerate(pages):
        drawn = zlib.compress("\n".join(f"BT /F1 {16 if style == 'Title' else 10} Tf 48 {790 - 13 * n} Td <{text.encode('utf-16-be').hex()}> Tj ET" for n, (style, text) in enumerate(page)).encode())
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {7 + 2 * k} 0 R >>".encode())
        objects.append(f"<< /Length {len(drawn)} /Filter /FlateDecode >>\nstream\n".encode() + drawn + b"\nendstream")
    out, starts = io.BytesIO(), []
    out.write(b"%PDF-1.4\n")
    for k, one in enumerate(objects, 1):
        starts.append(out.tell())
        out.write(f"{k} 0 obj\n".encode() + one + b"\nendobj\n")
    table = out.tell()
    out.write(f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{at:010} 00000 n \n".encode() for at in starts))
    out.write(f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{table}\n%%EOF\n".encode())
    return out.getvalue()


def export(reports: DataFrame, kind: str = "docx") -> DataFrame:
    """(report_id, content, error): each report of SCHEMA as a file, in the task that has it.

    A report over a bound has no content and says so in error; null titles,
    sections and sources are empty ones; extra columns are not read.
    """
    make = {"docx": docx, "pdf": pdf}[kind]

    def render(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    rows.append((r["report_id"], make(r), None))
                except ReportTooLarge as e:
                    rows.append((r["report_id"], None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.binary(), pa.string()))], names=["report_id", "content", "error"])

    return reports.select("report_id", "title", "sections").mapInArrow(render, "report_id string, content binary, error string")


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """(report_id, nth, style, text): the paragraphs of DOCX files (report_id, content), those of table cells too; style is null for plain ones."""

    def read(batches):
        name = f"{{{_W}}}"
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["content"] is None:
                    continue
                root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(r["content"])).read("word/document.xml"))
                for n, p in enumerate(root.iter(name + "p")):
                    style = p.find(f"{name}pPr/{name}pStyle")
                    rows.append((r["report_id"], n, None if style is None else style.get(name + "val"), "".join(t.text or "" for t in p.iter(name + "t"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), (), ()), (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["report_id", "nth", "style", "text"])

    return files.select("report_id", "content").mapInArrow(read, "report_id string, nth int, style string, text string")
