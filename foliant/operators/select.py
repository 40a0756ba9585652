"""Selection among candidate extractions of a document: waterfalls, quality gates, cascades, page replacement.

Candidates are rows (key, reader, priority, text, ...). Which wins is an aggregate over a key, so any
number of candidates costs one shuffle on the key, with partial aggregation before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import LANGUAGE, THRESHOLD
from ..functions.quality import with_quality
from ..functions.text import blank_to_null, has_text, php_trim
from ..sources.registry import OCR_READERS, READERS, TEXT_READERS

# Segmentation modes tried in turn, and the finer resolution of the last try.
PSM_CASCADE, OCRMYPDF_CASCADE, DPI_STEP, DPI_MOST = [3, 6, 4, 1, 11, 12], [3, 6, 11], 150, 600


@dataclass(frozen=True)
class Options:
    """How to choose; the defaults are the configuration's."""

    language: str = LANGUAGE
    quality_check: bool = True
    threshold: float = THRESHOLD
    force_ocr: bool = False
    preferred: str | None = None
    text_only: bool = False


def _result() -> Column:
    return F.struct("text", "reader", F.col("reader").isin(OCR_READERS).alias("is_scanned"), "score")


def text_waterfall(candidates: DataFrame, key: str) -> DataFrame:
    """(key, result): the first text that isn't blank among readers of embedded text, by priority."""
    live = candidates.where(F.col("reader").isin(TEXT_READERS) & has_text(F.col("text"))).withColumn("score", F.lit(None).cast("double"))
    return live.groupBy(key).agg(F.min_by(_result(), F.struct("priority", "reader")).alias("result"))


def ocr_waterfall(candidates: DataFrame, key: str, options: Options = Options()) -> DataFrame:
    """(key, result): among recognisers, the first at the threshold, else the best score, the earliest of equals.

    Without the quality check, the first text that isn't blank.
    """
    live = candidates.where(F.col("reader").isin(OCR_READERS) & has_text(F.col("text")))
    scored = with_quality(live, "text", options.language)
    order = F.struct("priority", "reader")
    first = F.min_by(_result(), order)
    passing = F.min_by(_result(), F.when(F.col("score") >= options.threshold, order))
    best = F.max_by(_result(), F.struct(F.round("score", 12), -F.col("priority")))
    return scored.groupBy(key).agg((F.coalesce(passing, best) if options.quality_check else first).alias("result"))


def preferred_reader(candidates: DataFrame, key: str, reader: str | None, text_only: bool = False) -> DataFrame:
    """(key, result) of the reader asked for; none if unknown, blank, or a recogniser in text-only mode."""
    allowed = reader in READERS and not (text_only and reader in OCR_READERS)
    live = candidates.where(F.lit(allowed) & (F.col("reader") == F.lit(reader or "")) & has_text(F.col("text")))
    live = live.withColumn("score", F.lit(None).cast("double"))
    return live.groupBy(key).agg(F.min_by(_result(), "priority").alias("result"))


def _unpacked(df: DataFrame, key: str, result: Column) -> DataFrame:
    picked = df.withColumn("_r", result)
    return picked.select(key, F.col("_r.text").alias("text"), F.col("_r.reader").alias("reader"), F.coalesce(F.col("_r.is_scanned"), F.lit(False)).alias("is_scanned"))


def extract_text(documents: DataFrame, candidates: DataFrame, key: str, embedded: str = "has_embedded_text", options: Options = Options()) -> DataFrame:
    """(key, text, reader, is_scanned) of every document by the quality-gated choice.

    The preferred reader's text wins outright. With embedded text (and no forced recognition) the text
    waterfall holds, unless its score is under the threshold and recognition scores strictly higher; if no
    text reader yields anything, recognition isn't tried. Else the recognition waterfall. Else nothing.
    """
    base = documents.select(key, F.col(embedded).alias("_embedded"))
    both = base
    for name, found in (("preferred", preferred_reader(candidates, key, options.preferred)), ("by_text", text_waterfall(candidates, key)), ("by_ocr", ocr_waterfall(candidates, key, options))):
        both = both.join(found.withColumnRenamed("result", name), key, "left")
    embedded_way = F.col("_embedded") & F.lit(not options.force_ocr)
    better = F.lit(False)
    if options.quality_check and not options.force_ocr:  # what recognition offers has its score from its waterfall
        both = with_quality(both.withColumn("_t", F.when(embedded_way & F.col("preferred").isNull() & F.col("by_ocr").isNotNull(), F.col("by_text.text"))), "_t", options.language, "_t_score")
        better = F.col("by_text").isNotNull() & (F.col("_t_score") < options.threshold) & F.col("by_ocr").isNotNull() & (F.col("by_ocr.score") > F.col("_t_score"))
    chosen = F.when(F.col("preferred").isNotNull(), F.col("preferred")).when(embedded_way, F.when(better, F.col("by_ocr")).otherwise(F.col("by_text"))).otherwise(F.col("by_ocr"))
    return _unpacked(both, key, chosen)


def extract_text_only(documents: DataFrame, candidates: DataFrame, key: str, preferred: str | None = None) -> DataFrame:
    """(key, text, reader, is_scanned): the preferred text reader, else the text waterfall; never recognition."""
    first = preferred_reader(candidates, key, preferred, text_only=True).withColumnRenamed("result", "preferred")
    both = documents.select(key).join(first, key, "left").join(text_waterfall(candidates, key), key, "left")
    return _unpacked(both, key, F.coalesce("preferred", "result"))


def extract_all(candidates: DataFrame, key: str, ocr_only: bool = False) -> DataFrame:
    """(key, text, reader, is_scanned, alternatives): the first success by priority, the others beside it in order."""
    live = candidates.where(has_text(F.col("text")) & (F.col("reader").isin(OCR_READERS) if ocr_only else F.lit(True)))
    row = F.struct("priority", "reader", "text", F.col("reader").isin(OCR_READERS).alias("is_scanned"))
    got = live.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    rest = F.transform(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), lambda r: F.struct(r["reader"].alias("reader"), r["text"].alias("text"), r["is_scanned"].alias("is_scanned")))
    first = F.col("rows")[0]
    return got.select(key, first["text"].alias("text"), first["reader"].alias("reader"), first["is_scanned"].alias("is_scanned"), rest.alias("alternatives"))


def longest_result(text: Column, reader: Column, is_scanned: Column, alternatives: Column) -> Column:
    """The longest text: the primary if it has text and reader, then alternatives of known readers that are strictly longer."""
    known = F.filter(alternatives, lambda a: a["reader"].isin(list(READERS)) & (F.length(F.coalesce(a["text"], F.lit(""))) > 0))
    primary = F.struct(text.alias("text"), reader.alias("reader"), is_scanned.alias("is_scanned"))
    start = F.when(text.isNotNull() & reader.isNotNull(), primary)
    length = lambda r: F.coalesce(F.length(r["text"]), F.lit(0))
    return F.aggregate(known, start, lambda best, a: F.when(length(a) > length(best), F.struct(a["text"].alias("text"), a["reader"].alias("reader"), a["is_scanned"].alias("is_scanned"))).otherwise(best))


def available_readers(reader: Column, alternatives: Column) -> Column:
    """Readers with a result, the primary first, each once; unknown names are left out."""
    names = F.concat(F.array(reader), F.transform(alternatives, lambda a: a["reader"]))
    return F.array_distinct(F.filter(names, lambda n: n.isin(list(READERS))))


def text_by_reader(text: Column, reader: Column, alternatives: Column, wanted: str) -> Column:
    other = F.try_element_at(F.filter(alternatives, lambda a: a["reader"] == wanted), F.lit(1))
    return F.when(reader == wanted, text).otherwise(other["text"])


def dual_strategy(layout: Column, raw: Column, layout_score: Column, raw_score: Column) -> Column:
    """The raw text only where its score is strictly higher."""
    return F.when(raw.isNotNull() & (raw_score > F.coalesce(layout_score, F.lit(0.0))), raw).otherwise(layout)


def cascade(candidates: DataFrame, key: str, order: str, score: str = "score", threshold: float = THRESHOLD) -> DataFrame:
    """(key, ord, score): what trying settings in turn ends with: the first at the threshold, else the best, the earliest of equals."""
    passing = F.min_by(F.struct(order, score), F.when(F.col(score) >= threshold, F.col(order)))
    best = F.max_by(F.struct(order, score), F.struct(F.col(score), -F.col(order)))
    return candidates.groupBy(key).agg(F.coalesce(passing, best).alias("r")).select(key, F.col(f"r.{order}").alias(order), F.col(f"r.{score}").alias(score))


def running_best(candidates: DataFrame, key: str, order: str, score: str = "score") -> DataFrame:
    """The same step by step: each try with the best score so far, and whether it improves on all before."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return candidates.withColumn("best_so_far", F.max(score).over(w)).withColumn("improves", before.isNull() | (F.col(score) > before))


def settings_cascade(base_psm: int, dpi: int, cascade_of: list[int] = PSM_CASCADE) -> list[tuple[int, int, int]]:
    """(order, psm, dpi) of the tries: the base, the other modes, then the base again at a finer resolution."""
    modes = [base_psm, *[p for p in cascade_of if p != base_psm]]
    tries = [(k, p, dpi) for k, p in enumerate(modes)]
    finer = min(dpi + DPI_STEP, DPI_MOST)
    return [*tries, (len(tries), base_psm, finer)] if finer > dpi else tries


def selective_pages(pages: DataFrame, candidates: DataFrame, key: str, language: str = LANGUAGE, threshold: float = THRESHOLD) -> DataFrame:
    """Replaces low pages by recognised ones: (key, text, selective_ocr, low_quality_pages, mode).

    pages: (key, page, text), page from 1; candidates: (key, page, text). A document without low pages is
    kept; one with over half its pages low is left to whole-document recognition (mode full); else a low
    page is replaced where the candidate's score is strictly higher. Pages are joined by form feeds.
    """
    scored = with_quality(pages.withColumn("_t", php_trim(F.col("text"))), "_t", language).drop("_t")
    offered = with_quality(candidates.withColumn("_o", php_trim(F.col("text"))).drop("text"), "_o", language, "_o_score")
    both = scored.join(offered, [key, "page"], "left")
    low = F.col("score") < threshold
    replace = low & (F.coalesce(F.length("_o"), F.lit(0)) > 0) & (F.col("_o_score") > F.col("score"))
    row = F.struct("page", F.col("text").alias("old"), F.when(replace, F.col("_o")).otherwise(F.col("text")).alias("new"), low.alias("low"), F.coalesce(replace, F.lit(False)).alias("replaced"))
    got = both.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("p"))
    lows = F.transform(F.filter("p", lambda r: r["low"]), lambda r: r["page"])
    mode = F.when(F.size(lows) == 0, "keep").when(F.size(lows) > F.size("p") * 0.5, "full").otherwise("selective")
    got = got.select(key, "p", lows.alias("low_quality_pages"), mode.alias("mode"))
    selective = F.col("mode") == "selective"
    text = F.array_join(F.transform("p", lambda r: F.when(selective, r["new"]).otherwise(r["old"])), "\f")
    return got.select(key, text.alias("text"), (selective & F.exists("p", lambda r: r["replaced"])).alias("selective_ocr"), "low_quality_pages", "mode")


def first_text(*columns: Column) -> Column:
    """The first of several texts that isn't blank."""
    return F.coalesce(*map(blank_to_null, columns))


def join_ocr_pages(pages: DataFrame, key: str) -> DataFrame:
    """(key, text): recognised pages in page order with a marker between them."""
    every = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy(key).agg(F.array_join(F.transform(every, lambda p: p["text"]), "\n\n--- Seite ---\n\n").alias("text"))
