"""Text-quality scoring as Column expressions: five weighted scores of 0 to 100, page scores, best of several.

No Python runs per row. Each raw count is a column of its own, so that it is computed once. Blanks are
collapsed once for all that counts tokens; listed words are counted by one pattern that shares the words'
beginnings, so no token becomes a value of its own. Broken words are looked for only in texts that hold what
the word's matches always hold, a plain substring search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import BROKEN_WORDS, ENGLISH_WORDS, ERROR_PATTERNS, GERMAN_WORDS, LANGUAGE, SEVERE, THRESHOLD, UMLAUTS, WEIGHTS, WRONG_UMLAUTS, for_java
from .text import php_trim


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(for_java(pattern))).cast("double")


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def _holds(text: Column, *literals: str) -> Column:
    found = text.contains(literals[0])
    for x in literals[1:]:
        found = found | text.contains(x)
    return found


def flattened(text: Column) -> Column:
    """Each run of ASCII blanks as one space."""
    return F.when(_holds(text, "  ", *"\n\t\r\f\x0b"), F.regexp_replace(text, r"\s{2,}|[^\S ]", " ")).otherwise(text)


def _visible(flat: Column) -> Column:
    return F.length(F.replace(flat, F.lit(" "), F.lit("")))


def token_count(text: Column, flat: Column | None = None) -> Column:
    """Tokens between ASCII blanks; empty edges count."""
    flat = flattened(text) if flat is None else flat
    return F.length(flat) - _visible(flat) + 1


def normalised(text: Column) -> Column:
    """Runs of blanks but line feeds become one space; spaces at line edges go."""
    single = F.when(_holds(text, "  ", *"\t\r\f\x0b"), F.regexp_replace(text, r"[^\S\n]{2,}|[\t\x0b\f\r]", " ")).otherwise(text)
    return F.regexp_replace(single, "(?md)^ | $", "")


def missing_score(text: Column, norm: Column | None = None, low: Column | None = None) -> Column:
    """Letters that stand alone before a word, and known words with a letter lost, for each 1000 characters.

    ``low``: the text in lower case, each run of blanks as one space.
    """
    t = normalised(text) if norm is None else norm
    low = F.lower(flattened(text)) if low is None else low
    single = _count(t, r" (?<=\p{L} )\p{L} (?=\p{L}{2})")
    known = F.lit(0.0)
    for pattern, literal in BROKEN_WORDS:
        known = known + _count_where(low, literal, _count(t, f"(?i){pattern}"))
    # Multiplied before it is divided: the other way round a score of 0 comes out as 1e-14, which counts as above 0.
    return _clamp(100 - 15 * (2 * single + 3 * known) / F.greatest(F.lit(1.0), F.length(t) / 1000))


def one_of(words: list[str]) -> str:
    """A pattern for any of the words, which branches letter by letter."""
    below: dict[str, list[str]] = {}
    for w in words:
        if w:
            below.setdefault(w[0], []).append(w[1:])
    found = "|".join(c + one_of(rest) for c, rest in below.items())
    return (f"(?:{found})" + ("?+" if "" in words else "")) if found else ""


def hits(text: Column, words: list[str], flat: Column | None = None) -> Column:
    """How many tokens, cleaned of all but letters, the list holds."""
    flat = flattened(text) if flat is None else flat
    clean = F.concat(F.lit(" "), F.regexp_replace(F.lower(flat), r"[^\p{L} ]+", ""))
    return F.regexp_count(clean, F.lit(f" {one_of(words)}(?= |$)"))


BOTH_WORDS = [*dict.fromkeys(GERMAN_WORDS + ENGLISH_WORDS)]


def _of_language(language: Column, german: Column, english: Column, both: Column) -> Column:
    deu, eng = language.contains("deu"), language.contains("eng")
    return F.when(deu & ~eng, german).when(eng & ~deu, english).otherwise(both)


def listed(text: Column, language: Column, flat: Column | None = None) -> Column:
    """Hits in the language's list: of the three counts only the one that is asked for runs."""
    return _of_language(language, *(hits(text, words, flat) for words in (GERMAN_WORDS, ENGLISH_WORDS, BOTH_WORDS)))


def word_score(text: Column, language: Column, n: Column | None = None, flat: Column | None = None) -> Column:
    """Share of tokens in the language's list, over 500 tokens at most, ten times over."""
    flat = flattened(text) if flat is None else flat
    n = listed(text, language, flat) if n is None else n
    return F.least(F.lit(100.0), n / F.least(token_count(text, flat), F.lit(500)) * 1000)


def _count_where(low: Column, literal: str, n: Column) -> Column:
    """The count where the text holds what every match does; else the pattern needn't run."""
    return F.when(low.contains(literal), n).otherwise(0.0) if literal else n


def _literal(pattern: str) -> str:
    """The letters that every match of a pattern like ``[a-z]fl[a-z]`` or ``ae`` holds; none of others."""
    body = pattern.removeprefix("(?i)").removeprefix("[a-z]").removesuffix("[a-z]")
    return body if body.isalpha() else ""


DOUBLED = "[a-z]ii[a-z]"  # a sign of wrong umlauts as well as of errors


def doubled(text: Column, low: Column) -> Column:
    return _count_where(low, "ii", _count(text, f"(?i){DOUBLED}"))


def wrong_umlauts(text: Column, low: Column | None = None, ii: Column | None = None) -> Column:
    low, wrong = F.lower(text) if low is None else low, F.lit(0.0)
    for pattern, follower in WRONG_UMLAUTS:
        n = _count(text, f"(?i){pattern}(?!{follower})" if follower else f"(?i){pattern}")
        wrong = wrong + (ii if ii is not None and pattern == DOUBLED else _count_where(low, _literal(pattern), n))
    return wrong


def umlaut_score(text: Column, language: Column, wrong: Column | None = None, umlauts: Column | None = None) -> Column:
    wrong = wrong_umlauts(text) if wrong is None else wrong
    umlauts = _count(text, UMLAUTS) if umlauts is None else umlauts
    german = F.when(umlauts >= F.length(text) * 0.005 * 0.5, 100 - 5 * wrong).otherwise(50 - 10 * wrong)
    return _clamp(F.when(language.contains("deu"), german).otherwise(80 - 2 * wrong))


def clean_score(text: Column, low: Column | None = None, ii: Column | None = None) -> Column:
    low = F.lower(text) if low is None else low
    errors = sum((ii if ii is not None and p == f"(?i){DOUBLED}" else _count_where(low, _literal(p), _count(text, p)) for p in ERROR_PATTERNS), F.lit(0.0))
    return F.when(F.length(text) == 0, 0.0).otherwise(_clamp(100 - errors / (F.length(text) / 100) * 10))


def length_score(text: Column, flat: Column | None = None) -> Column:
    flat = flattened(text) if flat is None else flat
    n = token_count(text, flat)
    mean = _visible(flat) / n
    return F.when(n < 10, 50.0).when(mean.between(4, 8), 100.0).when(mean.between(3, 10), 80.0).when(mean.between(2, 12), 60.0).otherwise(40.0)


PARTS: dict[str, Callable] = {
    "word_score": word_score,
    "umlaut_score": umlaut_score,
    "clean_score": lambda t, _: clean_score(t),
    "length_score": lambda t, _: length_score(t),
    "missing_score": lambda t, _: missing_score(t),
}
MEASURES = ["_flat", "_hits", "_german", "_english", "_both", "_wrong", "_umlauts", "_clean_score", "_length_score", "_missing_score"]


def with_measures(df: DataFrame, text: str = "text", language: Column | None = None) -> DataFrame:
    """What scoring a text needs beside its language, each computed once a text; hits only in ``language`` if that is given."""
    t = F.col(text)
    out = df.withColumns({"_flat": flattened(t), "_norm": normalised(t), "_low": F.lower(t), "_umlauts": _count(t, UMLAUTS)})
    flat, low, ii = F.col("_flat"), F.col("_low"), F.col("_ii")
    out = out.withColumn("_ii", doubled(t, low))
    out = out.withColumns({"_wrong": wrong_umlauts(t, low, ii), "_clean_score": clean_score(t, low, ii), "_length_score": length_score(t, flat)})
    counts = {"_german": hits(t, GERMAN_WORDS, flat), "_english": hits(t, ENGLISH_WORDS, flat), "_both": hits(t, BOTH_WORDS, flat)} if language is None else {"_hits": listed(t, language, flat)}
    out = out.withColumns({"_low": F.lower(flat)} | counts)
    return out.withColumn("_missing_score", missing_score(t, F.col("_norm"), F.col("_low"))).drop("_norm", "_low", "_ii")


def scored(measured: DataFrame, text: str, language: Column, into: str = "score", parts: bool = False) -> DataFrame:
    """The score of texts with measures, in a language for each row."""
    t = F.col(text)
    n = F.col("_hits") if "_hits" in measured.columns else _of_language(language, F.col("_german"), F.col("_english"), F.col("_both"))
    out = measured.withColumns({"_word_score": word_score(t, language, n, F.col("_flat")), "_umlaut_score": umlaut_score(t, language, F.col("_wrong"), F.col("_umlauts"))})
    total = sum((F.col(f"_{k}") * w for k, w in zip(PARTS, WEIGHTS, strict=True)), F.lit(0.0))
    blank = t.isNull() | php_trim(t).isin("", "0")
    score = F.when(blank, 0.0).when(F.col("_missing_score") < SEVERE, F.col("_missing_score")).otherwise(total)
    out = out.withColumn(into, score).drop(*[m for m in MEASURES if m.removeprefix("_") not in PARTS])
    return out.withColumnsRenamed({f"_{k}": k for k in PARTS}) if parts else out.drop(*[f"_{k}" for k in PARTS])


def with_quality(df: DataFrame, text: str = "text", language: str | Column = LANGUAGE, into: str = "score", parts: bool = False) -> DataFrame:
    """``df`` with the quality score of a text column; with ``parts`` the five scores stay as columns.

    Null, blank and "0" texts score 0. A text whose missing-character score is severe scores just that.
    """
    language = F.lit(language) if isinstance(language, str) else language
    return scored(with_measures(df, text, language), text, language, into, parts)


def page_scores(df: DataFrame, key: str, text: str = "text", language: str = LANGUAGE, threshold: float = THRESHOLD, drop_trailing_empty: bool = False) -> DataFrame:
    """(key, scores, average_score, low_quality_pages) of form-feed separated pages, numbered from 1.

    An empty page scores 0 and is low; the average is over pages above 0. A trailing form feed makes an
    empty last page unless ``drop_trailing_empty``.
    """
    t = F.regexp_replace(F.col(text), "\f$", "") if drop_trailing_empty else F.col(text)
    pages = df.select(key, F.posexplode(F.split(t, "\f", -1)).alias("page", "page_text")).withColumn("page_text", php_trim(F.col("page_text")))
    rows = with_quality(pages, "page_text", language)
    row = F.struct("page", "score")
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.avg(F.when(F.col("score") > 0, F.col("score"))).alias("average"))
    return got.select(
        key,
        F.transform("rows", lambda r: r["score"]).alias("scores"),
        F.coalesce("average", F.lit(0.0)).alias("average_score"),
        F.transform(F.filter("rows", lambda r: (r["score"] < threshold) | (r["score"] == 0)), lambda r: r["page"] + 1).alias("low_quality_pages"),
    )


def best_language(df: DataFrame, key: str, languages: list[str], text: str = "text") -> DataFrame:
    """``best_result`` of one text in several languages, in their order: the text is measured once."""
    measured = with_measures(df.select(key, text), text)
    listed = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(x).alias("language")) for k, x in enumerate(languages)])
    rows = measured.withColumn("c", F.explode(listed)).withColumns({"ord": F.col("c.ord"), "language": F.col("c.language")}).drop("c")
    return _best(scored(rows, text, F.col("language")), key, "ord", text, "language")


def best_result(df: DataFrame, key: str, order: str, text: str = "text", language: str = "language") -> DataFrame:
    """Of each key's candidates the text with the highest score above 0, the first in ``order`` among equals.

    A key without one gets empty text and language and 0. Every candidate is scored in its own language.
    """
    return _best(with_quality(df, text, F.col(language)), key, order, text, language)


def _best(rows: DataFrame, key: str, order: str, text: str, language: str) -> DataFrame:
    rows = rows.withColumn("score", F.when(F.col(text).isin("", "0"), 0.0).otherwise(F.col("score")))
    best = F.max_by(F.struct(F.col(text).alias("text"), F.col(language).alias("language"), "score"), F.when(F.col("score") > 0, F.struct(F.round("score", 12), -F.col(order))))
    empty = F.struct(F.lit("").alias("text"), F.lit("").alias("language"), F.lit(0.0).alias("score"))
    return rows.groupBy(key).agg(F.coalesce(best, empty).alias("best")).select(key, "best.text", "best.language", "best.score")
