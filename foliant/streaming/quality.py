"""The quality gate and the cache key over streams of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import LANGUAGE, THRESHOLD
from ..functions.quality import with_quality


def read_documents(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def gated(stream: DataFrame, text: str = "text", language: str = LANGUAGE, threshold: float = THRESHOLD) -> DataFrame:
    """Every document with its score and gate: stateless, the batch expressions as they are."""
    return with_quality(stream, text, language).withColumn("gate", F.when(F.col("score") < threshold, "ocr").otherwise("text"))


def first_seen(stream: DataFrame, at: str, text: str = "text", late: str = "10 minutes") -> DataFrame:
    """The first document of each content within the watermark; state is dropped behind it."""
    keyed = stream.withColumn("content_key", F.sha1(F.col(text))).withWatermark(at, late)
    return keyed.dropDuplicatesWithinWatermark(["content_key"])


def gate_counts(stream: DataFrame, at: str, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Documents of each gate in each window; late ones count until the watermark has passed."""
    counts = stream.withWatermark(at, late).groupBy(F.window(at, every), "gate").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    return counts.select(F.col("window.start").alias("start"), "gate", "n", "mean_score")
