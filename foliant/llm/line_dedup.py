"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

Runs are bucketed, sorted tables of (h1, h2, n): a 128-bit line hash and in how many documents it was
found. A new batch is merge-anti-joined with what the runs have settled (hashes that have reached the
threshold need no more counting) and adds the rest as a run of its own; once a level holds ``fanout``
runs they are merge-joined into one run of the next level. Runs share a bucketing, so those joins read
sorted buckets side by side without a shuffle of what is stored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, discard, free, named_column, new_folder, remove, row_key, stored, width

HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """Lines of a text at \\n; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line with blanks stripped at both ends and A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def hashed(line: Column, min_chars: int) -> Column:
    """128-bit hash of a line's key; null where the key is too short to count."""
    key = line_key(line)
    return F.when(
        F.length(key) >= min_chars,
        F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")),
    )


class LineRuns:
    """Levelled sorted runs of line hashes with document counts."""

    def __init__(self, spark: SparkSession, settle_at: int, buckets: int | None = None, fanout: int = 3):
        self.spark, self.settle_at, self.fanout = spark, settle_at, fanout
        self.buckets = buckets or width(spark)
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _save(self, counts: DataFrame) -> str:
        name, path = f"foliant_run_{uuid.uuid4().hex}", new_folder(self.spark, "run")
        out = counts.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
        out.option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.paths.pop(name))

    def _runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    @staticmethod
    def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = a.hint("merge").withColumnRenamed("n", "n_a"), b.withColumnRenamed("n", "n_b")
        both = a.join(b, HASH, "full_outer")
        return both.select(*HASH, (F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).cast("long").alias("n"))

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """What of a batch's (h1, h2, n) no run has settled yet."""
        for run in self._runs():
            counts = counts.join(run.where(F.col("n") >= self.settle_at).select(*HASH).hint("merge"), HASH, "left_anti")
        return counts

    def add(self, counts: DataFrame) -> None:
        """Adds a batch's (h1, h2, n), each hash once, as a run; compacts levels that are full."""
        self.levels[0].append(self._save(self.unsettled(counts)))
        at = 0
        while len(self.levels[at]) >= self.fanout:
            names, self.levels[at] = self.levels[at], []
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(self._save(reduce(self._merge, map(self.spark.table, names))))
            for name in names:
                self._drop(name)
            at += 1

    def totals(self) -> DataFrame:
        """(h1, h2, n) over all runs; exact below ``settle_at``, at least that where it was reached."""
        return reduce(self._merge, self._runs())

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = [[]]


def drop_common_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = 4,
) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text: lines found in ``min_docs`` rows or more lose all their places.

    A line's key is the line stripped of blanks and lower-cased in A-Z; keys under ``min_chars`` code points
    always stay. Every row counts as a document, repeats and rows without an id too. Null and empty texts
    have one empty line; texts are handled whole however long. An empty table gives an empty table. Columns of
    ``docs`` named n_lines, n_dropped or kept_text are replaced, all others pass through.
    """
    spark, names = docs.sparkSession, docs.columns
    keys = docs.select(*row_key(id_col, text_col), named_column(text_col).alias("_text"))

    # Runs: one scan counts in how many rows of each batch a line is found, map side first.
    per_row = keys.select(
        F.pmod(F.xxhash64("_k2", "_k1"), F.lit(batches)).cast("int").alias("batch"),
        F.explode(F.array_distinct(F.transform(lines_of(F.col("_text")), lambda x: hashed(x, min_chars)))).alias("h"),
    ).where("h IS NOT NULL")
    counted = stored(
        per_row.groupBy("batch", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2")).agg(F.count("*").alias("n")),
        "line-counts",
        by=["batch"],
    )
    runs = LineRuns(spark, min_docs)
    for batch in range(batches):
        runs.add(counted.where(F.col("batch") == batch).select(*HASH, "n"))
    common = stored(runs.totals().where(F.col("n") >= min_docs).select(*HASH), "common-lines")
    runs.close()
    discard(counted)

    # Places: only hashes travel; a hot line's rows are split by AQE's skew join or meet a small build side.
    # Lines are rows before they are hashed, so that hashing is compiled.
    places = keys.select("_k1", "_k2", F.posexplode(lines_of(F.col("_text"))).alias("_pos", "_line"))
    h = hashed(F.col("_line"), min_chars)
    places = places.select("_k1", "_k2", "_pos", h["h1"].alias("h1"), h["h2"].alias("h2")).where("h1 IS NOT NULL")
    dropped = places.join(common, HASH, "left_semi").groupBy("_k1", "_k2").agg(F.collect_set("_pos").alias("_places"))

    made = ["n_lines", "n_dropped", "kept_text"]
    k1, k2, places, own = free([*names, *made], "_k1", "_k2", "_places", "_lines")
    dropped = dropped.select(F.col("_k1").alias(k1), F.col("_k2").alias(k2), F.col("_places").alias(places))
    passed = [named_column(x) for x in names if x.lower() not in made]
    keyed = [c.alias(k) for c, k in zip(row_key(id_col, text_col), (k1, k2), strict=True)]
    out = docs.select(*map(named_column, names), *keyed).join(dropped, [k1, k2], "left")
    out = out.select(*passed, F.col(places), F.coalesce(named_column(text_col), F.lit("")).alias(k1), lines_of(named_column(text_col)).alias(own))
    stay = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(places))
    kept = F.array_join(F.transform(stay, lambda i: F.element_at(F.col(own), i + 1)), "\n")
    return out.select(
        *passed,
        F.size(own).cast("long").alias("n_lines"),
        F.coalesce(F.size(places).cast("long"), F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col(places).isNull(), F.col(k1)).otherwise(kept).alias("kept_text"),
    )
