"""Column functions over texts, metadata maps and tool output."""

from __future__ import annotations

import html as html_lib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..shipping import ship
from .lexicon import LANGUAGE_CODES

#: What trimming strips: blanks and NUL, but not the form feed.
PHP_TRIM = " \t\n\r\0\x0b"
VISIBLE = "[ \t\n\x0b\f\r]+"

# Names of invoice attachments in the order they are looked for, and signs of an invoice in XML.
INVOICE_NAMES = ["factur-x.xml", "zugferd-invoice.xml", "ZUGFeRD-invoice.xml", "xrechnung.xml"]
INVOICE_MARKS = ["CrossIndustryInvoice", "urn:un:unece:uncefact", "Invoice xmlns", "ubl:Invoice", "CreditNote xmlns"]


def php_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(PHP_TRIM))


def has_text(text: Column) -> Column:
    return F.coalesce(F.length(php_trim(text)) > 0, F.lit(False))


def blank_to_null(text: Column) -> Column:
    return F.when(has_text(text), text)


def text_or_default(text: Column, default: str = "") -> Column:
    return F.when(has_text(text), text).otherwise(default)


def char_count(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def line_count(text: Column) -> Column:
    """Of a document: lines end with CRLF, CR or LF; null has none, an empty text one."""
    return F.coalesce(F.regexp_count(text, F.lit("\r\n|\r|\n")) + 1, F.lit(0)).cast("long")


def provider_line_count(text: Column) -> Column:
    """Of a cached variant: only LF ends a line; null stays null."""
    return (F.regexp_count(text, F.lit("\n")) + 1).cast("long")


def visible_bytes(text: Column) -> Column:
    return F.octet_length(F.regexp_replace(text, VISIBLE, ""))


def enough_or_null(text: Column, least: int = 10) -> Column:
    """A reader's output, null under ``least`` bytes besides blanks."""
    return F.when(visible_bytes(text) >= least, text)


def embedded_text(page_one: Column, whole: Column, second: Column, least: int = 20) -> Column:
    """Whether any probe, in the order of their cost, holds ``least`` visible bytes."""
    return F.coalesce(visible_bytes(page_one) >= least, F.lit(False)) | F.coalesce(visible_bytes(whole) >= least, F.lit(False)) | F.coalesce(visible_bytes(second) >= least, F.lit(False))


def strip_ocr_markers(text: Column) -> Column:
    return F.regexp_replace(text, r"\[OCR skipped on page\(s\) [0-9, -]+\]\s*", "")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def document_html(text: Column, path: Column, reader: Column, is_scanned: Column, css: str = "body { font-size: 12pt; }") -> Column:
    """A result row as an HTML page: title and source are the file's name."""
    name = escape_html(base_name(path))
    return F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), name, F.lit('</title><meta name="generator" content="foliant"><meta name="source" content="'), name, F.lit('">'),
        F.coalesce(F.concat(F.lit('<meta name="pdf-reader" content="'), reader, F.lit('">')), F.lit("")),
        F.lit(f"<style>{css}</style></head><body>"),
        F.when(is_scanned, F.lit('<div class="scanned-notice">Recognised text; it may hold errors.</div>')).otherwise(""),
        F.coalesce(F.concat(F.lit("<pre>"), escape_html(text), F.lit("</pre>")), F.lit("<p>No text.</p>")),
        F.lit("</body></html>"),
    )


def content_html(content: Column, kind: Column, title: Column, file_body: Column | None = None) -> Column:
    """A writer's input as HTML: html as it is, a file's body, text escaped in a page."""
    page = F.concat(F.lit("<!DOCTYPE html><html><head><title>"), escape_html(F.coalesce(title, F.lit(""))), F.lit("</title></head><body><pre>"), escape_html(content), F.lit("</pre></body></html>"))
    return F.when(kind == "html", content).when(kind == "file", file_body if file_body is not None else F.lit(None)).otherwise(page)


def tags_stripped(html: Column) -> Column:
    """Without comments and well-formed tags; what stands between stays, entities too."""
    return F.regexp_replace(html, r"(?s)<!--.*?-->|</?[A-Za-z!?][^>]*>", "")


def _strip_tags(s: str) -> str:
    out, at, n = [], 0, len(s)
    while at < n:
        c = s[at]
        if c != "<" or at + 1 < n and s[at + 1].isspace():
            out.append(c)
            at += 1
            continue
        if s.startswith("<!--", at):
            end = s.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        quote, at = "", at + 1
        while at < n and (quote or s[at] != ">"):
            if quote:
                quote = "" if s[at] == quote else quote
            elif s[at] in "\"'":
                quote = s[at]
            at += 1
        at += 1
    return "".join(out)


@F.pandas_udf(StringType())
def _tags_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else _strip_tags(s))


@F.pandas_udf(StringType())
def _entities_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else html_lib.unescape(s))


def strip_tags(text: Column) -> Column:
    """As a state machine: a quoted > ends no tag, and < before a blank is text."""
    ship(SparkSession.active())
    return _tags_udf(text)


def decode_entities(text: Column) -> Column:
    """All named and numbered entities; ``xml_entities`` does the five of XML without Python."""
    ship(SparkSession.active())
    return _entities_udf(text)


def xml_entities(text: Column) -> Column:
    """The five entities that tools emit."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_body(html: Column) -> Column:
    body = r"(?is)<body[^>]*>(.*?)</body>"
    return F.when(html.rlike(body), F.regexp_extract(html, body, 1)).otherwise(html)


def is_pdf(path: Column, content: Column) -> Column:
    """By name and by a signature within the first 1024 bytes."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return F.coalesce(F.lower(path).endswith(".pdf") & head.contains("%PDF-"), F.lit(False))


def pdf_version(content: Column) -> Column:
    head = F.decode(F.substring(content, 1, 8), "ISO-8859-1")
    return F.nullif(F.regexp_extract(head, r"%PDF-(\d+\.\d+)", 1), F.lit(""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, where a column named in a lambda would be computed anew for each element."""
    return F.transform(F.array(value), use)[0]


def parse_metadata(output: Column) -> Column:
    """``Key: value`` lines as a map; of equal keys the last one counts."""
    line = r"^([^:\n]+):[ \t\r\f\x0b]*(.*)$"
    found = F.transform(F.split(output, "\n", -1), lambda x: F.struct(F.regexp_extract(x, line, 1).alias("key"), F.regexp_extract(x, line, 2).alias("value")))
    # A line that doesn't match gives an empty key, one that does never.
    pairs = F.transform(F.filter(found, lambda p: p["key"] != ""), lambda p: F.struct(php_trim(p["key"]).alias("key"), php_trim(p["value"]).alias("value")))

    def newest(rows: Column, keys: Column, names: Column) -> Column:
        """The last of equal keys stands first in the reversed arrays, where each distinct key is looked up once."""
        return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(rows, F.array_position(keys, k).cast("int"))["value"]))

    def of_keys(rows: Column, keys: Column) -> Column:
        return _let(F.array_distinct(F.reverse(keys)), lambda names: newest(rows, keys, names))

    return _let(F.reverse(pairs), lambda rows: _let(F.transform(rows, lambda p: p["key"]), lambda keys: of_keys(rows, keys)))


def page_count(metadata: Column) -> Column:
    return F.coalesce(F.try_element_at(metadata, F.lit("Pages")).try_cast("int"), F.lit(0))


def page_count_or_null(metadata: Column) -> Column:
    return F.nullif(page_count(metadata), F.lit(0))


def language_code(language: Column) -> Column:
    """A document's language as a recognition code; null where it isn't known, region tags too."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    return F.try_element_at(table, F.lower(php_trim(language)))


def widened_language(requested: Column, detected: Column) -> Column:
    return F.when(detected.isNotNull() & ~requested.contains(detected), F.concat(detected, F.lit("+"), requested)).otherwise(requested)


def is_invoice_name(name: Column) -> Column:
    return F.coalesce(F.lower(name).isin([x.lower() for x in INVOICE_NAMES]), F.lit(False))


def is_invoice_content(xml: Column) -> Column:
    out = F.lit(False)
    for mark in INVOICE_MARKS:
        out = out | xml.contains(mark)
    return F.coalesce(out, F.lit(False))
