"""The text queries see more of a text than its first characters."""

import hashlib
import re

from foliant.plans import registry

LONG = [(1, " " * 60 + "a" * 25), (2, "ab\f" + "c d " * 30), (3, "ab \f cd"), (4, "x" * 12), (5, None), (6, ""), (7, "y " * 30 + "[OCR skipped on page(s) 9]\n tail")]


def rows(spark, tmp_path, name):
    spark.createDataFrame(LONG, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return {r["doc_id"]: r for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}


def visible(text):
    return len(re.sub("[ \t\n\x0b\f\r]+", "", text or "").encode())


def test_embedded(spark, tmp_path):
    got = rows(spark, tmp_path, "B18_embedded_whole")
    assert {k: (r["embedded"], r["embedded_10"]) for k, r in got.items()} == {k: (visible(x) >= 20, visible(x) >= 10) for k, x in LONG}


def test_enough(spark, tmp_path):
    got = rows(spark, tmp_path, "B20_enough_whole")
    kept = {k: x if visible(x) >= 10 else None for k, x in LONG}
    assert {k: (r["chars"], r["kept_sha1"]) for k, r in got.items()} == {k: (None, None) if x is None else (len(x), hashlib.sha1(x.encode()).hexdigest()) for k, x in kept.items()}


def test_markers(spark, tmp_path):
    got = rows(spark, tmp_path, "B21_markers_whole")
    mark = r"\[OCR skipped on page\(s\) [0-9, -]+\]\s*"
    for k, x in LONG:
        if x is None:
            assert got[k]["chars"] is None
            continue
        h = len(x) // 2
        out = re.sub(mark, "", f"[OCR skipped on page(s) 1-{k}]\n {x[:h]}[OCR skipped on page(s) 4]{x[h:]}[OCR skipped on page(s) 2, 3]")
        assert (got[k]["chars"], got[k]["text_sha1"]) == (len(out), hashlib.sha1(out.encode()).hexdigest())
