"""What made queries slow on large tables: one task for millions of rows, and work that grew with the square of a row's lines."""

import time

import pytest
from pyspark.sql import functions as F

from compare import SF
from foliant.functions import text as t
from foliant.plans import geometry, registry

OF_PARTS = ["B12_is_pdf", "B13_version", "B14_metadata_lines", "B15_page_count", "B19_scanned", "C1_page_size", "C2_units", "C8_from_name", "C10_file_format", "C14_effective", "C15_margins", "O3_command", "O4_invoice_name"]


@pytest.mark.parametrize("name", OF_PARTS)
def test_parts_are_dealt_out(spark, name):
    assert registry.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_metadata_lines_are_read_once(spark):
    lines = F.concat_ws("\n", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda k: F.concat(F.lit("Key "), (k % 390).cast("string"), F.lit(": "), (k + F.col("id")).cast("string"))))
    began = time.perf_counter()
    got = spark.range(100).repartition(4).select("id", t.parse_metadata(lines).alias("m")).collect()
    assert time.perf_counter() - began < 12
    assert all(r["m"] == {f"Key {k % 390}": str(k + r["id"]) for k in range(1, 401)} for r in got)


def test_metadata_only_where_no_size_is_printed(spark, monkeypatch):
    sized = "Pages: 2\nPage size: 3 x 4 pts\nPage    1 size: 5 x 6 pts\nPage    2 size: 7 x 8 pts"
    monkeypatch.setattr(geometry, "parse_metadata", lambda x: F.when(x.contains("Page    1"), F.raise_error(F.lit("needless"))).otherwise(t.parse_metadata(x)))
    docs = spark.createDataFrame([(1, sized), (2, "Pages: 2\nPage size: 3 x 4 pts"), (3, None), (4, "Pages: 2")], "doc long, output string").repartition(2)
    assert sorted(map(tuple, geometry.all_page_sizes(docs).collect())) == [(1, 1, 5.0, 6.0), (1, 2, 7.0, 8.0), (2, 1, 3.0, 4.0), (2, 2, 3.0, 4.0)]
