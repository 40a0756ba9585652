from helpers import normal
from pyspark.sql import functions as F

from foliant.llm.common import ascii_lower


def test_only_ascii_letters_are_lowered(spark):
    """Each character there is, alone with an ASCII letter."""
    every = [k for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000]
    rows = [(k, chr(k) + "A") for k in every]
    df = spark.createDataFrame(rows, "k int, t string").select("k", ascii_lower(F.col("t")).alias("x"))
    wrong = [r["k"] for r in df.collect() if r["x"] != normal(chr(r["k"]) + "A")]
    assert not wrong
