"""Page-range planning: which pages a split or a merge is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_range(pages: DataFrame, first: int, last: int, page: str = "page") -> DataFrame:
    """Pages first to last, both counted from 1; nothing if the range is none."""
    return pages.where(F.col(page).between(first, last) & F.lit(1 <= first <= last))


def single_pages(docs: DataFrame, key: str, count: Column) -> DataFrame:
    """(key, page, file): a file for each page."""
    numbered = docs.where(count > 0).select(key, F.explode(F.sequence(F.lit(1), count.cast("int"))).alias("page"))
    return numbered.select(key, "page", F.format_string("page_%03d.pdf", "page").alias("file"))


def page_blocks(docs: DataFrame, key: str, count: Column, size: int) -> DataFrame:
    """(key, part, first, last, file): blocks of ``size`` pages (at least 1), the last one clipped."""
    size = max(1, size)
    starts = F.sequence(F.lit(1), count.cast("int"), F.lit(size))
    blocks = docs.where(count > 0).select(key, count.cast("int").alias("_n"), F.posexplode(starts).alias("part", "first"))
    last = F.least(F.col("first") + size - 1, F.col("_n"))
    return blocks.select(key, (F.col("part") + 1).alias("part"), "first", last.alias("last"), F.format_string("part_%03d.pdf", F.col("part") + 1).alias("file"))


def merge_plan(files: DataFrame, key: str, order: list[str], name: str, valid: str) -> DataFrame:
    """(key, files, mergeable): files in order; a merge needs two or more, all valid."""
    got = files.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, name))).alias("f"), F.count("*").alias("n"), F.bool_and(F.coalesce(F.col(valid), F.lit(False))).alias("ok"))
    return got.select(key, F.transform("f", lambda x: x[name]).alias("files"), ((F.col("n") >= 2) & F.col("ok")).alias("mergeable"))
