"""The texts that a document can be asked for, as variants over its candidates."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, has_text
from .layout import Y_TOLERANCE, Y_TOLERANCE_PIXELS, rows_of_words, text_of_rows
from .select import Options, extract_all, extract_text, extract_text_only, longest_result

COLUMNS = ["text", "reader", "is_scanned"]


@dataclass
class TextProvider:
    """documents: (key, has_embedded_text); candidates: (key, reader, priority, text) and, for pdftotext, its ``mode``;
    words, ocr_words: (key, page, seq, x, y, t) boxes in points and in pixels; seeds: (key, text) that stand for the default."""

    documents: DataFrame
    candidates: DataFrame
    key: str
    options: Options = field(default_factory=Options)
    words: DataFrame | None = None
    ocr_words: DataFrame | None = None
    seeds: DataFrame | None = None

    def document(self) -> DataFrame:
        """(key, text, reader, is_scanned): the default, or a document's seed where that isn't blank."""
        found = extract_text(self.documents, self.candidates, self.key, options=self.options)
        if self.seeds is None:
            return found
        seeds = self.seeds.groupBy(self.key).agg(F.min(blank_to_null(F.col("text"))).alias("_seed"))
        both = found.join(seeds, self.key, "left")
        seeded = F.col("_seed").isNotNull()
        return both.select(self.key, F.coalesce("_seed", "text").alias("text"), F.when(~seeded, F.col("reader")).alias("reader"), (F.col("is_scanned") & ~seeded).alias("is_scanned"))

    def text_only(self) -> DataFrame:
        return extract_text_only(self.documents, self.candidates, self.key)

    def ocr(self, language: str | None = None) -> DataFrame:
        o = replace(self.options, force_ocr=True, language=language or self.options.language)
        return extract_text(self.documents, self.candidates, self.key, options=o)

    def quality(self, threshold: float = 80.0, language: str | None = None) -> DataFrame:
        o = replace(self.options, threshold=threshold, language=language or self.options.language)
        return extract_text(self.documents, self.candidates, self.key, options=o)

    def by_reader(self, reader: str, mode: str | None = None) -> DataFrame:
        """That reader's first text that isn't blank, of one mode if it is given; no other reader's."""
        live = self.candidates.where((F.col("reader") == reader) & has_text(F.col("text")) & (F.lit(True) if mode is None else F.col("mode") == mode))
        first = live.groupBy(self.key).agg(F.min_by(F.struct("text", "reader"), "priority").alias("r"))
        both = self.documents.select(self.key).join(first, self.key, "left")
        return both.select(self.key, "r.text", "r.reader", F.lit(False).alias("is_scanned"))

    def layout(self) -> DataFrame:
        return self.by_reader("pdftotext", "layout")

    def raw(self) -> DataFrame:
        return self.by_reader("pdftotext", "raw")

    def _rows(self, words: DataFrame | None, tolerance: float, scanned: bool) -> DataFrame:
        none = self.documents.select(self.key)
        if words is None:
            return none.select(self.key, F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("reader"), F.lit(scanned).alias("is_scanned"))
        by = [self.key, "page"]
        pages = text_of_rows(rows_of_words(words, by, tolerance), by)
        every = F.array_sort(F.collect_list(F.struct("page", "text")))
        texts = pages.groupBy(self.key).agg(F.array_join(F.transform(every, lambda p: p["text"]), "\n").alias("text"))
        return none.join(texts, self.key, "left").select(self.key, "text", F.lit(None).cast("string").alias("reader"), F.lit(scanned).alias("is_scanned"))

    def row_aligned(self) -> DataFrame:
        return self._rows(self.words, Y_TOLERANCE, False)

    def ocr_row_aligned(self) -> DataFrame:
        return self._rows(self.ocr_words, Y_TOLERANCE_PIXELS, True)

    def everything(self) -> DataFrame:
        """(key, text, reader, is_scanned, alternatives, best): all readers' texts, and the longest of them."""
        found = extract_all(self.candidates, self.key)
        return found.withColumn("best", longest_result(*map(F.col, (*COLUMNS, "alternatives"))))

    def variants(self) -> DataFrame:
        """(key, variant, text, reader, is_scanned): a row for each document and variant."""
        named = {
            "default": self.document, "layout": self.layout, "raw": self.raw, "textonly": self.text_only, "ocr": self.ocr, "quality": self.quality,
            "rowaligned": self.row_aligned, "ocr-rowaligned": self.ocr_row_aligned,
        }
        out = None
        for name, make in named.items():
            rows = make().select(self.key, F.lit(name).alias("variant"), *COLUMNS)
            out = rows if out is None else out.unionByName(rows)
        return out
