"""What the query modules share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt over all cores if it has fewer splits than those; a larger one is left as it is, without a shuffle.

    A small table of one file would otherwise be one task of expensive expressions.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Parts by key, dealt over all cores: even millions of them are one split of a file."""
    return spread(table(spark, sf_dir, "part").select("p_partkey", *columns))


def r6(x: Column) -> Column:
    """Rounded; a negative zero becomes zero."""
    return F.round(x, 6) + F.lit(0.0)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LANG_SQL = "CASE lang WHEN 'de' THEN 'deu' WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' END"
PHP_TRIM_SQL = "trim({x}, ' '||chr(9)||chr(10)||chr(13)||chr(11))"
