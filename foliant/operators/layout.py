"""Layout reassembly: word boxes from tool output, and rows from word boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import php_trim, xml_entities

# How far apart two words' tops may be within a row, in points and in pixels.
Y_TOLERANCE, Y_TOLERANCE_PIXELS = 3.0, 15.0
WORD = r'<word\s+xMin="([\d.]+)"\s+yMin="([-\d.]+)"[^>]*>(.*?)</word>'


def words_of_bbox(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, page, seq, x, y, t) of the words in bounding-box XHTML; pages end with </page> and count from 0."""
    pages = docs.select(key, F.posexplode(F.split(xml, "</page>", -1)).alias("page", "body"))
    groups = [F.regexp_extract_all("body", F.lit(WORD), F.lit(k)) for k in (1, 2, 3)]
    words = pages.select(key, "page", F.posexplode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "xyt", strict=True)])).alias("seq", "w"))
    return words.select(key, "page", "seq", F.col("w.x").try_cast("double").alias("x"), F.col("w.y").try_cast("double").alias("y"), xml_entities(F.col("w.t")).alias("t"))


def words_of_tsv(docs: DataFrame, key: str, tsv: str) -> DataFrame:
    """(key, seq, x, y, t) of recognition TSV: the header, blank lines, short lines and empty texts are passed over."""
    lines = docs.select(key, F.posexplode(F.split(tsv, "\r?\n", -1)).alias("seq", "line")).where((F.col("seq") > 0) & (php_trim(F.col("line")) != ""))
    fields = lines.select(key, "seq", F.split("line", "\t", -1).alias("f")).where(F.size("f") >= 12)
    words = fields.select(key, "seq", F.col("f")[6].try_cast("double").alias("x"), F.col("f")[7].try_cast("double").alias("y"), php_trim(F.col("f")[11]).alias("t"))
    return words.where("t <> ''")


def rows_of_words(words: DataFrame, by: list[str], tolerance: float = Y_TOLERANCE) -> DataFrame:
    """(by, row, row_text): words in order of y; a gap over ``tolerance`` to the word before starts a row; rows run by x.

    Equal y and equal x keep the order of ``seq``. The gap is to the previous word, so a row may drift.
    """
    order = Window.partitionBy(*by).orderBy("y", "seq")
    gap = F.coalesce((F.col("y") - F.lag("y").over(order) > tolerance).cast("int"), F.lit(0))
    numbered = words.withColumn("_gap", gap).withColumn("row", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.array_sort(F.collect_list(F.struct("x", "y", "seq", "t")))
    return numbered.groupBy(*by, "row").agg(F.array_join(F.transform(row, lambda w: w["t"]), " ").alias("row_text"))


def text_of_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, text): the rows of each group joined by line feeds."""
    every = F.array_sort(F.collect_list(F.struct("row", "row_text")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(every, lambda r: r["row_text"]), "\n").alias("text"))


def row_aligned_text(docs: DataFrame, key: str, xml: str, tolerance: float = Y_TOLERANCE) -> DataFrame:
    """(key, text) of bounding-box XHTML: rows by page, pages joined by line feeds; without words an empty text."""
    pages = text_of_rows(rows_of_words(words_of_bbox(docs, key, xml), [key, "page"], tolerance), [key, "page"])
    every = F.array_sort(F.collect_list(F.struct("page", "text")))
    texts = pages.groupBy(key).agg(F.array_join(F.transform(every, lambda p: p["text"]), "\n").alias("text"))
    return docs.select(key).join(texts, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def ocr_row_aligned_text(pages: DataFrame, key: str, page: str, tsv: str, tolerance: float = Y_TOLERANCE_PIXELS) -> DataFrame:
    """(key, text) of recognition TSV, a row a page: rows by page, pages that have words joined by line feeds; else an empty text."""
    by = [key, page]
    words = words_of_tsv(pages.select(F.struct(*by).alias("_p"), tsv), "_p", tsv).select("_p.*", "seq", "x", "y", "t")
    each = text_of_rows(rows_of_words(words, by, tolerance), by)
    every = F.array_sort(F.collect_list(F.struct(page, "text")))
    texts = each.groupBy(key).agg(F.array_join(F.transform(every, lambda p: p["text"]), "\n").alias("text"))
    return pages.select(key).distinct().join(texts, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def bbox_line(x: Column, y: Column, t: Column) -> Column:
    return F.format_string('<word xMin="%s" yMin="%s" xMax="0" yMax="0">%s</word>', x.cast("string"), y.cast("string"), t)
