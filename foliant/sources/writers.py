"""Sinks: a minimal text PDF in pure Python, tool-backed writers, and the choice among writers."""

from __future__ import annotations

import html
import re
import shutil
import subprocess
import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _strip_tags
from ..shipping import ship
from .registry import WRITERS, Registry

# Fixed value: the name an invoice's XML gets where none is given.
INVOICE_NAME = "factur-x.xml"
LINES, WIDTH, LEADING, MARGIN = 60, 95, 12, 50


def attachment_name(given: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), F.lit(INVOICE_NAME))


def wkhtmltopdf_command(page_size: Column, orientation: Column, margin_top: Column, source: Column, target: Column) -> Column:
    """The command line; options that are null are left out."""
    return F.concat_ws(
        " ", F.lit("wkhtmltopdf"), F.lit("--encoding UTF-8"), F.concat(F.lit("--page-size "), page_size), F.concat(F.lit("--orientation "), orientation),
        F.concat(F.lit("--margin-top "), margin_top.cast("string"), F.lit("mm")), source, target,
    )


def wkhtmltopdf_arguments(program: str, options: dict, title: str | None, source: str, target: str) -> list[str]:
    """The arguments for a rendering: paper, orientation, margins by side, title, and the switches and numbers that are set."""
    out = [program, "--quiet", "--encoding", "UTF-8", "--page-size", str(options.get("paper_size") or "A4")]
    if str(options.get("orientation", "")).lower() in ("landscape", "l"):
        out += ["--orientation", "Landscape"]
    for side in ("top", "right", "bottom", "left"):
        if (margin := (options.get("margins") or {}).get(side)) is not None:
            out += [f"--margin-{side}", str(margin)]
    out += ["--title", title] if title else []
    out += [f"--{name.replace('_', '-')}" for name in ("grayscale", "lowquality", "disable_javascript") if options.get(name)]
    for name, kind in (("dpi", int), ("zoom", float)):
        out += [f"--{name}", str(kind(options[name]))] if options.get(name) is not None else []
    return [*out, source, target]


def encodable(text: str) -> bool:
    """Whether a standard font's encoding holds all characters; others would be lost."""
    try:
        text.encode("cp1252")
    except UnicodeEncodeError:
        return False
    return True


def _stream(lines: list[str]) -> bytes:
    shown = [x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for x in lines]
    return b"BT /F1 10 Tf %d TL %d %d Td " % (LEADING, MARGIN, 842 - MARGIN) + b" T* ".join(b"(" + x + b") Tj" for x in shown) + b" ET"


def text_pdf(text: str, title: str = "", attachments: dict[str, bytes] | None = None) -> bytes:
    """A PDF of A4 pages in a standard font: a form feed starts a page, long lines are wrapped."""
    pages: list[list[str]] = []
    for page in text.split("\f"):
        lines = [x[k : k + WIDTH] for x in page.split("\n") for k in range(0, max(1, len(x)), WIDTH)]
        pages += [lines[k : k + LINES] for k in range(0, max(1, len(lines)), LINES)]
    objects: list[bytes] = [b"", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for lines in pages:
        body = zlib.compress(_stream(lines))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595.28 841.89] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(objects))
        kids.append(len(objects))
    names = []
    for name, body in (attachments or {}).items():
        packed = zlib.compress(body)
        objects.append(b"<< /Type /EmbeddedFile /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed))
        objects.append(b"<< /Type /Filespec /F (%s) /UF (%s) /AFRelationship /Data /EF << /F %d 0 R >> >>" % (name.encode(), name.encode(), len(objects)))
        names.append(b"(%s) %d 0 R" % (name.encode(), len(objects)))
    tree = b" /Names << /EmbeddedFiles << /Names [%s] >> >>" % b" ".join(names) if names else b""
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R%s >>" % tree
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    objects.append(b"<< /Title (%s) >>" % title.encode("cp1252", "replace").replace(b"\\", b"").replace(b"(", b"").replace(b")", b""))
    out, at = bytearray(b"%PDF-1.7\n"), []
    for k, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(objects), start))


def _plain(content: dict) -> str:
    if content["type"] == "text":
        return content["content"]
    return _strip_tags(re.sub(r"(?i)<br\s*/?>|</p>|</h\d>", "\n", content["content"]))


@dataclass
class TextPdfWriter:
    """Renders text, and html by its text, in Python: stands for the library-backed writers.

    Text with characters that the standard font's encoding lacks gives None, not a page with marks in their place.
    """

    name: str = "tcpdf"
    supports_html: bool = True
    supports_text: bool = True

    @property
    def priority(self) -> int:
        return WRITERS[self.name][0]

    def available(self) -> bool:
        return True

    def can_handle(self, content: dict) -> bool:
        return content["type"] in ("html", "text")

    def render(self, content: dict, options: dict) -> bytes | None:
        text = _plain(content)
        return text_pdf(text, (content.get("metadata") or {}).get("title") or "") if encodable(text) else None

    def info(self) -> dict:
        return {"name": self.name, "priority": self.priority, "available": self.available(), "description": WRITERS[self.name][-1]}


@dataclass
class InvoiceWriter(TextPdfWriter):
    """Needs the invoice's XML in the metadata, which it embeds; called by name, not listed."""

    name: str = "zugferd"

    def can_handle(self, content: dict) -> bool:
        return super().can_handle(content) and bool((content.get("metadata") or {}).get("invoice_xml"))

    def render(self, content: dict, options: dict) -> bytes | None:
        if not self.can_handle(content):
            return None
        metadata = content["metadata"]
        if not encodable(_plain(content)):
            return None
        name = options.get("invoice_filename") or metadata.get("invoice_filename") or INVOICE_NAME
        return text_pdf(_plain(content), metadata.get("title") or "", {name: metadata["invoice_xml"].encode()})


@dataclass
class ToolWriter(TextPdfWriter):
    """The external renderer; not available where the program isn't."""

    name: str = "wkhtmltopdf"
    program: str = "wkhtmltopdf"

    def available(self) -> bool:
        return shutil.which(self.program) is not None

    def render(self, content: dict, options: dict) -> bytes | None:
        with tempfile.TemporaryDirectory() as d:
            source, target = Path(d, "in.html"), Path(d, "out.pdf")
            source.write_text(content["content"] if content["type"] == "html" else f"<pre>{html.escape(content['content'])}</pre>", encoding="utf-8")
            arguments = wkhtmltopdf_arguments(self.program, options, (content.get("metadata") or {}).get("title"), str(source), str(target))
            try:
                ran = subprocess.run(arguments, capture_output=True, timeout=options.get("timeout", 120))
            except (OSError, subprocess.TimeoutExpired):
                return None
            return target.read_bytes() if ran.returncode == 0 and target.exists() else None


def writers() -> Registry:
    """The listed writers; the first two render in Python."""
    out = Registry()
    out.register("dompdf", lambda: TextPdfWriter("dompdf"))
    out.register("tcpdf", TextPdfWriter)
    out.register("wkhtmltopdf", ToolWriter)
    return out


def create_pdf(content: dict, preferred: str | None = None, options: dict | None = None, registry: Registry | None = None) -> bytes | None:
    """The preferred writer's result if it can run and take the content, whatever that is; else the first result by priority."""
    registry, options = registry or writers(), options or {}
    first = InvoiceWriter() if preferred == "zugferd" else registry.get(preferred) if preferred else None
    if first is not None and first.available() and first.can_handle(content):
        return first.render(content, options)
    for w in registry.available():
        if w.can_handle(content) and (made := w.render(content, options)) is not None:
            return made
    return None


def html_to_pdf(content: str, metadata: dict | None = None, options: dict | None = None, preferred: str | None = None) -> bytes | None:
    return create_pdf({"content": content, "type": "html", "metadata": metadata or {}}, preferred, options)


def text_to_pdf(content: str, metadata: dict | None = None, options: dict | None = None, preferred: str | None = None) -> bytes | None:
    return create_pdf({"content": content, "type": "text", "metadata": metadata or {}}, preferred, options)


def file_to_pdf(path: str, metadata: dict | None = None, options: dict | None = None, preferred: str | None = None) -> bytes | None:
    """Of an HTML file; raises FileNotFoundError where there is none."""
    return html_to_pdf(Path(path).read_text("utf-8"), metadata, options, preferred)


def render_pdfs(contents: DataFrame, preferred: str | None = None) -> DataFrame:
    """(key, pdf) of rows (key, content, type, metadata map): rendered inside the tasks, null where no writer can."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        registry = writers()
        for rows in batches:
            made = [create_pdf({"content": c or "", "type": k, "metadata": dict(m or {})}, preferred, registry=registry) for c, k, m in zip(rows["content"], rows["type"], rows["metadata"], strict=True)]
            yield pd.DataFrame({"key": rows["key"], "pdf": made})

    ship(contents.sparkSession)
    return contents.select("key", "content", "type", "metadata").mapInPandas(run, f"key {contents.schema['key'].dataType.simpleString()}, pdf binary")
