"""Text-quality queries A1 to A8, and the same in DuckDB SQL (whose regex engine has no look-around)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions.lexicon import BROKEN_WORDS, ENGLISH_WORDS, ERROR_PATTERNS, GERMAN_WORDS, WRONG_UMLAUTS
from ..functions.text import language_code
from .common import LANG_SQL, PHP_TRIM_SQL, quoted, r6, spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return docs.withColumn("language", language_code(F.col("lang")))


def a1_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = q.with_quality(_documents(spark, sf_dir), "text", F.col("language"))
    return scored.select("doc_id", "language", r6(F.col("score")).alias("score"), F.when(F.round("score", 6) < q.THRESHOLD, "ocr").otherwise("text").alias("gate"))


def _part(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        score = q.PARTS[name](F.col("text"), F.col("language"))
        return _documents(spark, sf_dir).select("doc_id", r6(score.cast("double")).alias(name))

    return query


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a document whose pages are its turns."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\f").alias("text"))


def a7_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = q.page_scores(_pages(spark, sf_dir), "conv_id")
    return got.select(
        "conv_id",
        F.size("scores").cast("long").alias("pages"),
        r6(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)).alias("score_sum"),
        r6(F.col("average_score")).alias("average_score"),
        F.array_join(F.col("low_quality_pages").cast("array<string>"), ",").alias("low_pages"),
    )


def a8_best_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = q.best_language(docs, "doc_id", ["deu", "eng", "deu+eng"])
    return best.select("doc_id", "language", r6(F.col("score")).alias("score"), F.length("text").cast("long").alias("chars"))


def _n(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(pattern)}))"


def scores_sql(source: str, keep: str) -> str:
    """CTEs that end in ``scored``: the ``keep`` columns of ``source`` (which has text and language) with the five scores and score."""
    wrong = " + ".join(_n("text", f"(?i){p}") + (f" - {_n('text', f'(?i){p}{f}')}" if f else "") for p, f in WRONG_UMLAUTS)
    errors = " + ".join(_n("text", p) for p in ERROR_PATTERNS)
    known = " + ".join(_n("norm", f"(?i){p}") for p, _ in BROKEN_WORDS)
    both = [*dict.fromkeys(GERMAN_WORDS + ENGLISH_WORDS)]

    def hits(words: list[str]) -> str:
        return f"len(list_filter(toks, lambda w: list_contains([{', '.join(map(quoted, words))}], regexp_replace(w, '[^\\p{{L}}]', '', 'g'))))"

    return f"""
        prepared AS (
            SELECT {keep}, text, language,
                   regexp_split_to_array(lower(text), '\\s+') AS toks, regexp_split_to_array(text, '\\s+') AS words,
                   regexp_replace(regexp_replace(text, '[ \\t\\x0b\\f\\r]+', ' ', 'g'), '(?m)^ | $', '', 'g') AS norm
            FROM {source}
        ), counted AS (
            SELECT *, CASE WHEN contains(language, 'deu') AND NOT contains(language, 'eng') THEN {hits(GERMAN_WORDS)}
                           WHEN contains(language, 'eng') AND NOT contains(language, 'deu') THEN {hits(ENGLISH_WORDS)}
                           ELSE {hits(both)} END AS hits,
                   {_n("text", "[äöüÄÖÜß]")} AS umlauts, {wrong} AS wrong, {errors} AS errors, {known} AS known,
                   {_n("regexp_replace(norm, '(\\p{L})', '\\1\\1', 'g')", "\\p{L} \\p{L}{2} \\p{L}{3}")} AS single,
                   list_sum(list_transform(words, lambda w: length(w))) / len(words) AS mean_length
            FROM prepared
        ), parts AS (
            SELECT *, least(100.0, hits / least(len(toks), 500) * 1000) AS word_score,
                   greatest(0.0, least(100.0, CASE WHEN contains(language, 'deu') THEN
                       CASE WHEN umlauts >= length(text) * 0.005 * 0.5 THEN 100 - 5 * wrong ELSE 50 - 10 * wrong END
                       ELSE 80 - 2 * wrong END)) AS umlaut_score,
                   CASE WHEN length(text) = 0 THEN 0.0 ELSE greatest(0.0, least(100.0, 100 - errors / (length(text) / 100) * 10)) END AS clean_score,
                   CASE WHEN len(words) < 10 THEN 50.0 WHEN mean_length BETWEEN 4 AND 8 THEN 100.0 WHEN mean_length BETWEEN 3 AND 10 THEN 80.0
                        WHEN mean_length BETWEEN 2 AND 12 THEN 60.0 ELSE 40.0 END AS length_score,
                   greatest(0.0, least(100.0, 100 - 15 * (2 * single + 3 * known) / greatest(1.0, length(norm) / 1000))) AS missing_score
            FROM counted
        ), scored AS (
            SELECT *, CASE WHEN text IS NULL OR {PHP_TRIM_SQL.format(x="text")} IN ('', '0') THEN 0.0 WHEN missing_score < 30 THEN missing_score
                      ELSE word_score * 0.35 + umlaut_score * 0.25 + clean_score * 0.15 + length_score * 0.10 + missing_score * 0.15 END AS score
            FROM parts
        )"""


_DOCS = f"(SELECT doc_id, text, {LANG_SQL} AS language FROM documents)"

QUERIES = {
    "A1_quality_score": a1_quality_score,
    "A2_word_score": _part("word_score"),
    "A3_umlaut_score": _part("umlaut_score"),
    "A4_clean_score": _part("clean_score"),
    "A5_length_score": _part("length_score"),
    "A6_missing_score": _part("missing_score"),
    "A7_page_scores": a7_page_scores,
    "A8_best_result": a8_best_result,
}

ORACLE = {
    "A1_quality_score": f"WITH {scores_sql(_DOCS, 'doc_id')} SELECT doc_id, language, round(score, 6) AS score, CASE WHEN round(score, 6) < 60 THEN 'ocr' ELSE 'text' END AS gate FROM scored",
    **{f"A{k}_{name}": f"WITH {scores_sql(_DOCS, 'doc_id')} SELECT doc_id, round({name}::DOUBLE, 6) AS {name} FROM scored" for k, name in zip(range(2, 7), q.PARTS, strict=True)},
    "A7_page_scores": f"""
        WITH pages AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS page, {PHP_TRIM_SQL.format(x="text")} AS text, 'deu+eng' AS language FROM conversations),
        {scores_sql("pages", "conv_id, page")}
        SELECT conv_id, count(*) AS pages, round(sum(score), 6) AS score_sum, round(coalesce(avg(score) FILTER (WHERE score > 0), 0.0), 6) AS average_score,
               coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (WHERE score < 60), '') AS low_pages
        FROM scored GROUP BY conv_id""",
    "A8_best_result": f"""
        WITH rows AS (SELECT doc_id, text, u.ord, u.language FROM documents, (VALUES (0, 'deu'), (1, 'eng'), (2, 'deu+eng')) u(ord, language)),
        {scores_sql("rows", "doc_id, ord")}
        SELECT doc_id, CASE WHEN score > 0 THEN language ELSE '' END AS language, round(score, 6) AS score, CASE WHEN score > 0 THEN length(text) ELSE 0 END AS chars
        FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, ord) = 1""",
}
