"""The training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import new_folder, read
from foliant.llm.exact_dedup import drop_exact_duplicates
from foliant.llm.packing import pack
from foliant.llm.quality_rank import keep_quality
from foliant.llm.simhash import drop_near_duplicates
from foliant.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents predicted toxic."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose quality is under the threshold."""
    return keep_quality(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, the one with the largest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose shingles of five words are similar to 0.8 or more, the one with the least id.

    Op9's fingerprints link first, at five bits, which three segments serve as well as four; each link is verified by similarity.
    """
    return drop_near_duplicates(docs, shingle=5, differ=5, similarity=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: a row a piece."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Learnt scores and best-fit packing have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
