"""Scalar text, metadata and invoice queries B1 to B25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.lexicon import LANGUAGE_CODES
from ..operators.invoice import has_invoice, invoice_of
from ..operators.select import available_readers, longest_result, text_by_reader
from ..sources.registry import READERS
from .common import LANG_SQL, PHP_TRIM_SQL, parts, quoted, table
from .geometry import INFO_SQL, _info

BLANK_SQL = PHP_TRIM_SQL.format(x="text") + " <> ''"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")



def b1_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 7 == 0, F.lit(" \n\t")).when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", t.has_text(text).alias("has_text"), F.length(t.text_or_default(text, "none")).cast("long").alias("chars"))


def b2_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.replace("text", F.lit(". "), F.lit("\r\n")))
    return _docs(spark, sf_dir).select("doc_id", t.char_count(text).alias("chars"), t.line_count(text).alias("lines"), t.provider_line_count(text).alias("provider_lines"))


def b3_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.create_map(F.lit("title"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), F.lit("author"), F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    more = F.create_map(F.lit("subject"), F.col("lang"), F.lit("title"), F.when(F.col("doc_id") % 3 == 0, "Later").otherwise("Other"))
    merged = F.map_from_entries(F.concat(F.filter(F.map_entries(given), lambda e: ~F.map_contains_key(more, e["key"])), F.map_entries(more)))
    return _docs(spark, sf_dir).select(
        "doc_id", F.try_element_at(merged, F.lit("title")).alias("title"), F.try_element_at(merged, F.lit("author")).isNotNull().alias("has_author"),
        F.coalesce(F.try_element_at(merged, F.lit("keywords")), F.lit("none")).alias("keywords"), F.try_element_at(merged, F.lit("subject")).alias("subject"),
    )


def _with_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a document: its first turn is the primary result, later turns are alternatives."""
    names = F.array(*[F.lit(x) for x in (*READERS, "unknown")])
    reader = F.element_at(names, (F.col("turn") % 5 + 1).cast("int"))
    row = F.struct("turn", reader.alias("reader"), "text", (F.col("turn") % 2 == 1).alias("is_scanned"))
    got = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    rest = F.transform(F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))), lambda x: F.struct(x["reader"].alias("reader"), x["text"].alias("text"), x["is_scanned"].alias("is_scanned")))
    known = F.when(F.col("t")[0]["reader"] != "unknown", F.col("t")[0]["reader"])
    return got.select("conv_id", F.col("t")[0]["text"].alias("text"), known.alias("reader"), F.col("t")[0]["is_scanned"].alias("is_scanned"), rest.alias("alternatives"))


ALTERNATIVES_SQL = """turns AS (SELECT conv_id, turn, text, ['pdftotext', 'pdfbox', 'tesseract', 'ocrmypdf', 'unknown'][(turn % 5 + 1)::INT] AS reader, turn % 2 = 1 AS is_scanned,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)"""


def b4_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _with_alternatives(spark, sf_dir)
    r, a = F.col("reader"), F.col("alternatives")
    return docs.select("conv_id", (F.size(a) > 0).alias("any"), F.array_join(F.array_sort(available_readers(r, a)), ",").alias("readers"), F.coalesce(F.length(text_by_reader(F.col("text"), r, a, "pdfbox")), F.lit(-1)).cast("long").alias("pdfbox_chars"))


def b5_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _with_alternatives(spark, sf_dir)
    best = longest_result(F.col("text"), F.col("reader"), F.col("is_scanned"), F.col("alternatives"))
    return docs.withColumn("b", best).select("conv_id", F.col("b.reader").alias("reader"), F.length("b.text").cast("long").alias("chars"), F.col("b.is_scanned").alias("is_scanned"))


def b6_document_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    reader = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise("pdftotext")
    page = t.document_html(F.col("text"), path, reader, F.col("doc_id") % 2 == 0)
    return _docs(spark, sf_dir).select("doc_id", F.length(page).cast("long").alias("chars"), F.sha1(page).alias("page_sha1"))


ESCAPE_SQL = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"


def b7_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 2 == 0, "html").otherwise("text")
    content = F.struct(F.col("text").alias("content"), kind.alias("type"), F.create_map(F.lit("title"), F.col("source")).alias("metadata"))
    return _docs(spark, sf_dir).withColumn("c", content).select("doc_id", "c.type", F.length("c.content").cast("long").alias("chars"), F.try_element_at("c.metadata", F.lit("title")).alias("title"))


def b8_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("html"), F.lit("text"), F.lit("file")), (F.col("doc_id") % 3 + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", (kind == "html").alias("is_html"), (kind == "text").alias("is_text"), (kind == "file").alias("is_file"))


def b9_content_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 2 == 0, "html").otherwise("text")
    page = t.content_html(F.col("text"), kind, F.col("source"))
    return _docs(spark, sf_dir).select("doc_id", F.length(page).cast("long").alias("chars"), F.sha1(page).alias("page_sha1"))


def b10_content_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = t.tags_stripped(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(out).cast("long").alias("chars"), F.sha1(out).alias("text_sha1"))


def b11_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = t.html_body(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(body).cast("long").alias("chars"), F.sha1(body).alias("body_sha1"))


def _file() -> tuple[Column, Column]:
    k = F.col("p_partkey")
    path = F.concat(F.lit("/f/"), k.cast("string"), F.when(k % 5 == 0, ".txt").when(k % 5 == 1, ".PDF").otherwise(".pdf"))
    return path, F.encode(F.concat(F.repeat(F.lit("x"), (k % 4 * 400).cast("int")), F.lit("%PDF-1."), (k % 8).cast("string"), F.lit("\nrest")), "UTF-8")


def b12_is_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", t.is_pdf(*_file()).alias("valid"))


def b13_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", t.pdf_version(_file()[1]).alias("version"))


def b14_metadata_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = t.parse_metadata(_info())
    return parts(spark, sf_dir, "p_size").withColumn("m", m).select("p_partkey", F.size("m").cast("long").alias("keys"), *[F.try_element_at("m", F.lit(k)).alias(a) for k, a in (("Title", "title"), ("Page size", "page_size"), ("Language", "language"))])


def b15_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = parts(spark, sf_dir, "p_size").withColumn("m", t.parse_metadata(F.when(F.col("p_partkey") % 10 == 0, "Title: none").otherwise(_info())))
    return files.select("p_partkey", t.page_count(F.col("m")).cast("long").alias("pages"), t.page_count_or_null(F.col("m")).cast("long").alias("pages_or_null"))


def b16_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("doc_id") % 10 == 0, F.concat("lang", F.lit("-XX"))).when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.upper("lang"))).otherwise(F.col("lang"))
    return _docs(spark, sf_dir).select("doc_id", t.language_code(given).alias("code"))


def b17_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.widened_language(F.lit("deu+eng"), t.language_code(F.col("lang"))).alias("languages"))


def b18_embedded_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's first page (up to the form feed), then its whole text; the tables hold no second extractor's text."""
    one, none = F.substring_index("text", "\f", 1), F.lit(None).cast("string")
    return _docs(spark, sf_dir).select("doc_id", t.embedded_text(one, F.col("text"), none).alias("embedded"), t.embedded_text(one, F.col("text"), none, 10).alias("embedded_10"))


def b19_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, content = _file()
    embedded = t.embedded_text(F.substring_index("p_name", " ", 1), F.lit(None).cast("string"), F.col("p_name"))
    return parts(spark, sf_dir, "p_name").select("p_partkey", (t.is_pdf(path, content) & ~embedded).alias("likely_scanned"))


def b20_enough_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = t.enough_or_null(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(kept).cast("long").alias("chars"), F.sha1(kept).alias("kept_sha1"))


def b21_markers_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers before, in the middle of and after the whole text."""
    half = (F.length("text") / 2).cast("int")
    text = F.concat(
        F.lit("[OCR skipped on page(s) 1-"), F.col("doc_id").cast("string"), F.lit("]\n "), F.substring("text", F.lit(1), half),
        F.lit("[OCR skipped on page(s) 4]"), F.substring("text", half + 1, F.length("text")), F.lit("[OCR skipped on page(s) 2, 3]"),
    )
    out = t.strip_ocr_markers(text)
    return _docs(spark, sf_dir).select("doc_id", F.length(out).cast("long").alias("chars"), F.sha1(out).alias("text_sha1"))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as its attachments."""
    k = F.col("l_partkey")
    names = F.array(*[F.lit(x) for x in ("factur-x.xml", "zugferd-invoice.xml", "ZUGFeRD-invoice.xml", "xrechnung.xml", "FACTUR-X.XML", "data.xml", "note.txt", "scan.png", "b.xml", "c.pdf")])
    content = F.when(k % 7 == 0, F.lit(None)).when(k % 3 == 0, F.concat(F.lit("<rsm:CrossIndustryInvoice n='"), k.cast("string"), F.lit("'/>"))).otherwise(F.concat(F.lit("<x>"), k.cast("string"), F.lit("</x>")))
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 1000000 + k).alias("ord"), F.element_at(names, (k % 10 + 1).cast("int")).alias("filename"), content.alias("content"))


ATTACHMENTS_SQL = """att AS (SELECT l_orderkey AS doc, l_linenumber * 1000000 + l_partkey AS ord,
    ['factur-x.xml', 'zugferd-invoice.xml', 'ZUGFeRD-invoice.xml', 'xrechnung.xml', 'FACTUR-X.XML', 'data.xml', 'note.txt', 'scan.png', 'b.xml', 'c.pdf'][(l_partkey % 10 + 1)::INT] AS filename,
    CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN '<rsm:CrossIndustryInvoice n=''' || l_partkey || '''/>' ELSE '<x>' || l_partkey || '</x>' END AS content FROM lineitem)"""


def b22_invoice_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attachments(spark, sf_dir)
    return rows.groupBy("filename").agg(F.count("*").alias("n"), F.bool_and(t.is_invoice_name(F.col("filename"))).alias("is_invoice"))


def b23_invoice_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attachments(spark, sf_dir).select("doc", "ord", t.is_invoice_content(F.col("content")).alias("looks"))


def b24_has_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return has_invoice(attachments(spark, sf_dir), "doc")


def b25_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoice_of(attachments(spark, sf_dir), "doc")


QUERIES = {
    "B1_predicates": b1_predicates, "B2_measures": b2_measures, "B3_metadata": b3_metadata, "B4_alternatives": b4_alternatives, "B5_longest": b5_longest,
    "B6_document_html": b6_document_html, "B7_content": b7_content, "B8_types": b8_types, "B9_content_html": b9_content_html, "B10_content_text": b10_content_text,
    "B11_body": b11_body, "B12_is_pdf": b12_is_pdf, "B13_version": b13_version, "B14_metadata_lines": b14_metadata_lines, "B15_page_count": b15_page_count,
    "B16_language": b16_language, "B17_widened": b17_widened, "B19_scanned": b19_scanned, 
    "B18_embedded_whole": b18_embedded_whole, "B20_enough_whole": b20_enough_whole, "B21_markers_whole": b21_markers_whole,
    "B22_invoice_names": b22_invoice_names, "B23_invoice_content": b23_invoice_content, "B24_has_invoice": b24_has_invoice, "B25_invoice": b25_invoice,
}

_CODES = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in LANGUAGE_CODES.items())
_VISIBLE = "strlen(regexp_replace({x}, '[ \\t\\n\\x0b\\f\\r]+', '', 'g'))"
_NAME = "doc_id || '.pdf'"
_FILE = "(SELECT *, '/f/' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' ELSE '.pdf' END AS path, repeat('x', (p_partkey % 4 * 400)::BIGINT) || '%PDF-1.' || (p_partkey % 8) || chr(10) || 'rest' AS body FROM part)"
_VALID = "lower(path) LIKE '%.pdf' AND contains(substr(body, 1, 1024), '%PDF-')"
_PAGE = f"""'<!DOCTYPE html><html><head><title>' || {_NAME} || '</title><meta name="generator" content="foliant"><meta name="source" content="' || {_NAME} || '">' ||
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE '<meta name="pdf-reader" content="pdftotext">' END || '<style>body {{ font-size: 12pt; }}</style></head><body>' ||
    CASE WHEN doc_id % 2 = 0 THEN '<div class="scanned-notice">Recognised text; it may hold errors.</div>' ELSE '' END || coalesce('<pre>' || {ESCAPE_SQL.format(x="text")} || '</pre>', '<p>No text.</p>') || '</body></html>'"""
_CONTENT = f"CASE WHEN doc_id % 2 = 0 THEN text ELSE '<!DOCTYPE html><html><head><title>' || {ESCAPE_SQL.format(x='source')} || '</title></head><body><pre>' || {ESCAPE_SQL.format(x='text')} || '</pre></body></html>' END"

ORACLE = {
    "B1_predicates": f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' || chr(10) || chr(9) WHEN doc_id % 11 = 0 THEN NULL ELSE text END AS text FROM documents) SELECT doc_id, coalesce({BLANK_SQL}, false) AS has_text, CASE WHEN coalesce({BLANK_SQL}, false) THEN length(text) ELSE 4 END AS chars FROM d",
    "B2_measures": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE replace(text, '. ', chr(13) || chr(10)) END AS text FROM documents)
        SELECT doc_id, coalesce(length(text), 0) AS chars, coalesce(len(regexp_extract_all(text, '\\r\\n|\\r|\\n')) + 1, 0) AS lines, length(text) - length(replace(text, chr(10), '')) + 1 AS provider_lines FROM d""",
    "B3_metadata": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Later' ELSE 'Other' END AS title, doc_id % 2 = 0 AND source IS NOT NULL AS has_author, 'none' AS keywords, lang AS subject FROM documents",
    "B4_alternatives": f"""WITH {ALTERNATIVES_SQL} SELECT conv_id, count(*) > 1 AS "any", coalesce(string_agg(DISTINCT reader, ',' ORDER BY reader) FILTER (WHERE reader <> 'unknown'), '') AS readers,
        coalesce(length(min_by(text, k) FILTER (WHERE reader = 'pdfbox')), -1) AS pdfbox_chars FROM turns GROUP BY conv_id""",
    "B5_longest": f"""WITH {ALTERNATIVES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, k) AS n FROM turns WHERE reader <> 'unknown' AND (k = 1 OR length(text) > 0))
        SELECT conv_id, reader, length(text) AS chars, is_scanned FROM (SELECT DISTINCT conv_id FROM turns) LEFT JOIN (SELECT * FROM r WHERE n = 1) USING (conv_id)""",
    "B6_document_html": f"SELECT doc_id, length(p) AS chars, sha1(p) AS page_sha1 FROM (SELECT doc_id, {_PAGE} AS p FROM documents)",
    "B7_content": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'html' ELSE 'text' END AS type, length(text) AS chars, source AS title FROM documents",
    "B8_types": "SELECT doc_id, doc_id % 3 = 0 AS is_html, doc_id % 3 = 1 AS is_text, doc_id % 3 = 2 AS is_file FROM documents",
    "B9_content_html": f"SELECT doc_id, length(p) AS chars, sha1(p) AS page_sha1 FROM (SELECT doc_id, {_CONTENT} AS p FROM documents)",
    "B10_content_text": "SELECT page_id, length(x) AS chars, sha1(x) AS text_sha1 FROM (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|</?[A-Za-z!?][^>]*>', '', 'g') AS x FROM pages)",
    "B11_body": "SELECT page_id, length(x) AS chars, sha1(x) AS body_sha1 FROM (SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<body[^>]*>(.*?)</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE html END AS x FROM pages)",
    "B12_is_pdf": f"SELECT p_partkey, {_VALID} AS valid FROM {_FILE}",
    "B13_version": f"SELECT p_partkey, nullif(regexp_extract(substr(body, 1, 8), '%PDF-(\\d+\\.\\d+)', 1), '') AS version FROM {_FILE}",
    "B14_metadata_lines": f"SELECT p_partkey, 5 AS keys, 'last' AS title, regexp_extract(i, 'Page size: +(.*)', 1) AS page_size, 'de' AS language FROM (SELECT p_partkey, {INFO_SQL} AS i FROM part)",
    "B15_page_count": "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_partkey % 9 END AS pages, nullif(CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_partkey % 9 END, 0) AS pages_or_null FROM part",
    "B16_language": f"WITH c(k, v) AS (VALUES {_CODES}), d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN lang || '-XX' WHEN doc_id % 3 = 0 THEN ' ' || upper(lang) ELSE lang END AS g FROM documents) SELECT doc_id, v AS code FROM d LEFT JOIN c ON k = lower(trim(g))",
    "B17_widened": f"SELECT doc_id, CASE WHEN c IN ('deu', 'eng') THEN 'deu+eng' ELSE c || '+deu+eng' END AS languages FROM (SELECT doc_id, {LANG_SQL} AS c FROM documents)",
    "B18_embedded_whole": f"SELECT doc_id, coalesce({_VISIBLE.format(x='one')} >= 20, false) OR coalesce({_VISIBLE.format(x='text')} >= 20, false) AS embedded, coalesce({_VISIBLE.format(x='one')} >= 10, false) OR coalesce({_VISIBLE.format(x='text')} >= 10, false) AS embedded_10 FROM (SELECT *, split_part(text, chr(12), 1) AS one FROM documents)",
    "B19_scanned": f"SELECT p_partkey, {_VALID} AND NOT ({_VISIBLE.format(x="split_part(p_name, ' ', 1)")} >= 20 OR {_VISIBLE.format(x='p_name')} >= 20) AS likely_scanned FROM {_FILE}",
    "B20_enough_whole": f"SELECT doc_id, length(kept) AS chars, sha1(kept) AS kept_sha1 FROM (SELECT doc_id, CASE WHEN {_VISIBLE.format(x='text')} >= 10 THEN text END AS kept FROM documents)",
    "B21_markers_whole": """SELECT doc_id, length(x) AS chars, sha1(x) AS text_sha1 FROM (SELECT doc_id, regexp_replace('[OCR skipped on page(s) 1-' || doc_id || ']' || chr(10) || ' ' || substr(text, 1, length(text) // 2) ||
        '[OCR skipped on page(s) 4]' || substr(text, length(text) // 2 + 1) || '[OCR skipped on page(s) 2, 3]', '\\[OCR skipped on page\\(s\\) [0-9, -]+\\]\\s*', '', 'g') AS x FROM documents)""",
    "B22_invoice_names": f"WITH {ATTACHMENTS_SQL} SELECT filename, count(*) AS n, lower(filename) IN ('factur-x.xml', 'zugferd-invoice.xml', 'xrechnung.xml') AS is_invoice FROM att GROUP BY filename",
    "B23_invoice_content": f"WITH {ATTACHMENTS_SQL} SELECT doc, ord, coalesce(contains(content, 'CrossIndustryInvoice'), false) AS looks FROM att",
    "B24_has_invoice": f"WITH {ATTACHMENTS_SQL} SELECT doc, bool_or(lower(filename) IN ('factur-x.xml', 'zugferd-invoice.xml', 'xrechnung.xml')) AS is_invoice FROM att GROUP BY doc",
    "B25_invoice": f"""WITH {ATTACHMENTS_SQL}, r AS (SELECT *, CASE WHEN content IS NOT NULL AND filename IN ('factur-x.xml', 'zugferd-invoice.xml', 'ZUGFeRD-invoice.xml', 'xrechnung.xml')
            THEN list_position(['factur-x.xml', 'zugferd-invoice.xml', 'ZUGFeRD-invoice.xml', 'xrechnung.xml'], filename) WHEN lower(filename) LIKE '%.xml' AND contains(content, 'CrossIndustryInvoice') THEN 9 END AS way FROM att),
        b AS (SELECT * FROM r WHERE way IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc ORDER BY way, ord) = 1)
        SELECT doc, filename, content FROM (SELECT DISTINCT doc FROM att) LEFT JOIN b USING (doc)""",
}
