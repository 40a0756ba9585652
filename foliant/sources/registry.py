"""Readers and writers by capability: what each can do, in order of priority, and which can run here."""

from __future__ import annotations

import shutil
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

# Reader (priority, scanned, text, description), writer (priority, html, text, external tool, description).
READERS = {
    "pdftotext": (10, False, True, "Poppler pdftotext - Schnelle Text-Extraktion"),
    "pdfbox": (30, False, True, "Apache PDFBox - Komplexe Layouts"),
    "tesseract": (50, True, False, "Tesseract OCR - Gescannte Dokumente"),
    "ocrmypdf": (60, True, False, "OCRmyPDF - Hochwertige OCR"),
}
WRITERS = {
    "dompdf": (10, True, True, False, "Dompdf - Reine PHP-Lösung für HTML zu PDF"),
    "zugferd": (15, True, True, False, "ZUGFeRD/Factur-X - E-Rechnungs-PDFs"),
    "tcpdf": (20, True, True, False, "TCPDF - Umfangreiche PHP-PDF-Bibliothek"),
    "wkhtmltopdf": (30, True, True, True, "wkhtmltopdf - Webkit-basierte Konvertierung"),
}
TEXT_READERS = [n for n, (_, scanned, text, _) in READERS.items() if text and not scanned]
OCR_READERS = [n for n, (_, scanned, text, _) in READERS.items() if scanned and not text]
#: Writers that the registry lists; the invoice writer is called by name only.
LISTED_WRITERS = ["dompdf", "tcpdf", "wkhtmltopdf"]


def reader_dim(spark: SparkSession) -> DataFrame:
    rows = [(n, p, s, t, s and not t, d) for n, (p, s, t, d) in READERS.items()]
    return spark.createDataFrame(rows, "reader string, priority int, supports_scanned boolean, supports_text boolean, is_ocr_only boolean, description string")


def writer_dim(spark: SparkSession) -> DataFrame:
    rows = [(n, *v) for n, v in WRITERS.items()]
    return spark.createDataFrame(rows, "writer string, priority int, supports_html boolean, supports_text boolean, requires_external_tool boolean, description string")


class Reader(Protocol):
    """A source of text: one bytes object in, a text or None out; runs inside tasks."""

    name: str
    priority: int
    supports_scanned: bool
    supports_text: bool

    def available(self) -> bool: ...

    def can_handle(self, path: str, content: bytes) -> bool: ...

    def extract(self, path: str, content: bytes, options: dict) -> str | None: ...


class Writer(Protocol):
    """A sink: content in, PDF bytes or None out; runs inside tasks."""

    name: str
    priority: int
    supports_html: bool
    supports_text: bool

    def available(self) -> bool: ...

    def can_handle(self, content: dict) -> bool: ...

    def render(self, content: dict, options: dict) -> bytes | None: ...

    def info(self) -> dict: ...


@dataclass
class Registry:
    """Instances by name, made on first use; a maker that fails is remembered as None."""

    makers: dict[str, Callable[[], object]] = field(default_factory=dict)
    made: dict[str, object | None] = field(default_factory=dict)

    def register(self, name: str, make: Callable[[], object]) -> None:
        self.makers[name] = make
        self.made.pop(name, None)

    def get(self, name: str) -> object | None:
        if name not in self.made and name in self.makers:
            try:
                self.made[name] = self.makers[name]()
            except (OSError, RuntimeError, ValueError):
                self.made[name] = None
        return self.made.get(name)

    def all(self) -> list:
        return sorted((x for x in map(self.get, self.makers) if x is not None), key=lambda x: x.priority)

    def available(self) -> list:
        return [x for x in self.all() if x.available()]

    def where(self, capability: str) -> list:
        return [x for x in self.available() if getattr(x, capability)]

    def types(self) -> list[str]:
        return [x.name for x in self.all()]

    def count(self) -> int:
        return len(self.all())

    def info(self) -> list[dict]:
        return [{"name": x.name, "priority": x.priority, "available": x.available()} for x in self.all()]


def has_tool(*names: str) -> bool:
    """Whether all the programs are on this machine's path."""
    return all(shutil.which(n) for n in names)
