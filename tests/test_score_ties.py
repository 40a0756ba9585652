"""Scores at 0 and at equal ranks come out as the queries' SQL has them."""

import pytest

from compare import connection
from foliant.functions import quality as q
from foliant.plans import registry

GOOD = "The annual report of the company and the balance sheet were prepared with the audit for this business."


def severe(lone: int) -> str:
    """A text of 300 characters for each letter that stands alone: the missing-character score is 0."""
    return ("abcd e fg " + "h" * 290) * lone


def test_no_score_above_zero(spark):
    assert all(len(severe(k)) == 300 * k for k in range(4, 30))
    rows = spark.createDataFrame([(severe(k),) for k in range(4, 30)], "text string")
    assert {r["score"] for r in q.with_quality(rows, "text", "deu").collect()} == {0.0}


def test_average_leaves_out_zero(spark, tmp_path):
    turns = [(k, t, "user", x) for k in range(4, 30) for t, x in enumerate((GOOD, severe(k)))]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {r[0]: r for r in connection(str(tmp_path)).execute(registry.ORACLE["A7_page_scores"]).fetchall()}
    for r in registry.QUERIES["A7_page_scores"](spark, str(tmp_path)).collect():
        assert r["average_score"] == r["score_sum"] == want[r["conv_id"]][3]


@pytest.mark.parametrize("name", ["A8_best_result", "E11_language"])
def test_no_language_without_a_score(spark, tmp_path, name):
    docs = [(k, severe(k)) for k in range(4, 30)] + [(100 + k, severe(k)[3:]) for k in range(4, 30)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["language"] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[1] for r in connection(str(tmp_path)).execute(registry.ORACLE[name]).fetchall()}


def test_equal_to_twelve_digits_is_a_tie(spark):
    rows = spark.createDataFrame([(1, 0, "deu", "a", 50.0), (1, 1, "eng", "b", 50.00000000000001), (2, 0, "deu", "a", 50.0), (2, 1, "eng", "b", 50.0001)], "k int, o int, language string, text string, score double")
    assert {r["k"]: r["language"] for r in q._best(rows, "k", "o", "text", "language").collect()} == {1: "deu", 2: "eng"}
