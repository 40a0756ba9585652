"""Scores against an independent scorer over bytes, and against stated cases."""

import re

import pytest
from pyspark.sql import functions as F

from compare import SF
from foliant.functions import lexicon as lex
from foliant.functions import quality as q
from foliant.functions.text import language_code


def _n(pattern: str, data: bytes, flags: int = 0) -> int:
    return len(re.findall(pattern.encode(), data, flags))


def score(text: str, language: str) -> float:
    t = text.strip(" \t\n\r\0\x0b")
    if t in ("", "0"):
        return 0.0
    raw = text.encode()
    norm = re.sub(rb"(?m)^ | $", b"", re.sub(rb"[ \t\x0b\f\r]+", b" ", raw))
    shown = norm.decode()
    single = len(re.findall(r"(?<=[^\W\d_]) [^\W\d_] (?=[^\W\d_]{2})", shown))
    known = sum(_n(p, norm, re.I) for p, _ in lex.BROKEN_WORDS)
    missing = max(0.0, min(100.0, 100 - 15 * (2 * single + 3 * known) / max(1, len(shown) / 1000)))
    if missing < 30:
        return missing
    deu, eng = "deu" in language, "eng" in language
    listed = set(lex.GERMAN_WORDS if deu and not eng else lex.ENGLISH_WORDS if eng and not deu else lex.GERMAN_WORDS + lex.ENGLISH_WORDS)
    tokens = [w.decode() for w in re.split(rb"[ \t\n\x0b\f\r]+", text.lower().encode())]
    hits = sum(re.sub(r"[\W\d_]", "", w) in listed for w in tokens)
    words = min(100.0, hits / min(len(tokens), 500) * 1000)
    wrong = _n("[a-z]ii[a-z]", raw, re.I) + _n("ae(?![rl])", raw, re.I) + _n("oe(?![uv])", raw, re.I) + _n("ue(?![lrst])", raw, re.I)
    umlauts = len(re.findall("[äöüÄÖÜß]", text))
    um = (100 - 5 * wrong if umlauts >= len(text) * 0.0025 else 50 - 10 * wrong) if deu else 80 - 2 * wrong
    errors = sum(_n(p.removeprefix("(?i)"), raw, re.I if p.startswith("(?i)") else 0) for p in lex.ERROR_PATTERNS[:4])
    errors += len(re.findall(r"""[^\s\w.,;:\-()\[\]"'/&%€$§!?@#+=*]""", text))
    clean = max(0.0, min(100.0, 100 - errors / (len(text) / 100) * 10))
    parts = [w.decode() for w in re.split(rb"[ \t\n\x0b\f\r]+", raw)]
    mean = sum(map(len, parts)) / len(parts)
    length = 50 if len(parts) < 10 else 100 if 4 <= mean <= 8 else 80 if 3 <= mean <= 10 else 60 if 2 <= mean <= 12 else 40
    return sum(a * b for a, b in zip((words, max(0, min(100, um)), clean, length, missing), lex.WEIGHTS, strict=True))


def test_equals_byte_scorer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("language", language_code(F.col("lang")))
    got = q.with_quality(docs.select("doc_id", "text", "language"), "text", F.col("language")).collect()
    for r in got:
        assert r["score"] == pytest.approx(score(r["text"], r["language"]), abs=1e-6), r["doc_id"]


CASES = [
    ("Der Jahresabschluss wurde geprüft. Für die Gesellschaft sind über das Geschäftsjahr keine Verluste und größere Gebühren entstanden.", "deu", lambda s: s > 50),
    ("The annual financial statement of the company has been prepared with the report and the balance sheet for this business.", "eng", lambda s: s > 50),
    ("", "deu", lambda s: s == 0),
    ("0", "deu", lambda s: s == 0),
    ("   \\n\\t  ", "deu", lambda s: s < 50),
    ("f r f r f r f r f r", "deu", lambda s: s < 30),
    (None, "deu", lambda s: s == 0),
    ("\f", "eng", lambda s: s > 0),
]


def test_stated_cases(spark):
    rows = spark.createDataFrame([(k, t, lang) for k, (t, lang, _) in enumerate(CASES)], "k int, text string, language string")
    got = {r["k"]: r["score"] for r in q.with_quality(rows, "text", F.col("language")).collect()}
    assert all(check(got[k]) for k, (_, _, check) in enumerate(CASES)), got


def test_broken_umlauts_score_lower(spark):
    rows = spark.createDataFrame([(0, "für die Prüfung über größere Beträge"), (1, "fiir die Priifung iiber groeßere Betraege")], "k int, text string")
    a, b = (r["score"] for r in q.with_quality(rows, "text", "deu").orderBy("k").collect())
    assert a > b


def test_ascii_boundaries(spark):
    rows = spark.createDataFrame([("äf r x und mehr " * 5, )], "text string")
    n = rows.select(F.regexp_count("text", F.lit(lex.for_java(r"(?i)\bf\s+r\b")))).first()[0]
    assert n == 5


def test_pages(spark):
    good = "The annual report of the company and the balance sheet were prepared with the audit for this business. "
    rows = spark.createDataFrame([(1, good + "\f"), (2, good)], "k int, text string")
    got = {r["k"]: r for r in q.page_scores(rows, "k", language="eng").collect()}
    assert got[1]["low_quality_pages"] == [2] and got[1]["scores"][1] == 0 and got[1]["average_score"] == pytest.approx(got[1]["scores"][0])
    assert got[2]["low_quality_pages"] == []
    kept = {r["k"]: r for r in q.page_scores(rows, "k", language="eng", drop_trailing_empty=True).collect()}
    assert len(kept[1]["scores"]) == 1


def test_best_result(spark):
    rows = spark.createDataFrame([(1, 0, "deu", "Prüfungsvermerk über größere Beträge für die Gesellschaft"), (1, 1, "eng", "Prufungsvermerk uber grosere Betrage fur die Gesellschaft"), (2, 0, "deu", ""), (3, 0, "eng", "0")], "k int, o int, language string, text string")
    got = {r["k"]: (r["language"], r["score"]) for r in q.best_result(rows, "k", "o").collect()}
    assert got[1][0] == "deu" and got[1][1] > 0 and got[2] == ("", 0) and got[3] == ("", 0)
