"""A content-addressed result cache kept as Parquet: keys, lookup with an age limit, append of what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_text

#: Fixed value: days that a result stays valid; 0 is for ever.
TTL_DAYS = 30


def option_key(force_ocr: Column, text_only: Column, layout: Column, dual: Column, quality_check: Column, threshold: Column, language: Column, reader: Column) -> Column:
    """The key of a set of options: ``doc`` and what is set, joined by colons; null options are not set."""

    def yes(flag: Column, text: str) -> Column:
        return F.when(F.coalesce(flag, F.lit(False)), text)

    def bit(name: str, flag: Column) -> Column:
        return F.concat(F.lit(f"{name}="), F.when(flag, "1").otherwise("0"))

    return F.concat_ws(
        ":", F.lit("doc"), yes(force_ocr, "ocr"), yes(text_only, "textonly"), F.when(layout.isNotNull(), bit("layout", layout)), F.when(dual.isNotNull() & ~dual, "nodual"),
        F.when(quality_check.isNotNull(), bit("qc", quality_check)), F.concat(F.lit("qt="), threshold.cast("string")), F.concat(F.lit("lang="), language), F.concat(F.lit("reader="), reader),
    )


def content_key(content: Column, variant: Column, parameters: Column) -> Column:
    """SHA-1 of the content's SHA-1, the variant and the parameters, a map written in the order of its keys."""
    pairs = F.array_sort(F.map_entries(parameters))
    canonical = F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), F.coalesce(p["value"], F.lit("")))), "&")
    return F.sha1(F.concat_ws("|", F.sha1(content), variant, canonical))


def is_valid(stored_at: Column, now: Column, ttl_days: int = TTL_DAYS) -> Column:
    """A result as old as the limit is still valid."""
    return F.lit(True) if ttl_days == 0 else (F.unix_micros(now.cast("timestamp")) - F.unix_micros(stored_at.cast("timestamp"))) <= ttl_days * 86_400_000_000


def lookup(requests: DataFrame, cache: DataFrame, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Requests with the valid cached ``text`` of their ``key``, null where there is none."""
    live = cache.where(is_valid(F.col("stored_at"), now, ttl_days)).groupBy("key").agg(F.max_by("text", "stored_at").alias("text"))
    return requests.join(live, "key", "left")


def expired(cache: DataFrame, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    return cache.where(~is_valid(F.col("stored_at"), now, ttl_days))


def to_store(results: DataFrame, cache: DataFrame) -> DataFrame:
    """Results that aren't blank and whose key isn't cached yet, one for each key."""
    fresh = results.where(has_text(F.col("text"))).groupBy("key").agg(F.min("text").alias("text"))
    return fresh.join(cache.select("key"), "key", "left_anti")


class ResultCache:
    """The cache as a folder of Parquet files, appended to by Spark's commit protocol."""

    SCHEMA = "key string, text string, stored_at timestamp"

    def __init__(self, spark: SparkSession, path: str, ttl_days: int = TTL_DAYS, enabled: bool = True):
        self.spark, self.path, self.ttl_days, self.enabled = spark, path, ttl_days, enabled

    def table(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def get(self, requests: DataFrame, now: Column | None = None) -> DataFrame:
        if not self.enabled:
            return requests.withColumn("text", F.lit(None).cast("string"))
        return lookup(requests, self.table(), F.current_timestamp() if now is None else now, self.ttl_days)

    def put(self, results: DataFrame, now: Column | None = None) -> None:
        if self.enabled:
            rows = to_store(results, self.table()).withColumn("stored_at", F.current_timestamp() if now is None else now)
            rows.write.mode("append").parquet(self.path)

    def clear(self) -> None:
        self.spark.createDataFrame([], self.SCHEMA).write.mode("overwrite").parquet(self.path)
