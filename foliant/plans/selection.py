"""Layout (D), selection (E), cache (F), page planning (G) and capability (H, M, P) queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions.text import blank_to_null
from ..operators import cache, layout, pages, select
from ..operators.provider import TextProvider
from ..sources import registry as reg
from ..sources.writers import attachment_name, wkhtmltopdf_command
from .common import PHP_TRIM_SQL, parts, quoted, r6, spread, table
from .quality import scores_sql

# D: words from lineitem


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")


def _bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a bounding-box document of two pages: lines with odd and with even part keys."""
    word = layout.bbox_line((F.col("l_partkey") % 500).cast("double"), F.col("l_quantity"), F.concat("l_returnflag", F.lit("&amp;"), F.col("l_partkey").cast("string")))
    rows = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", word.alias("w")))).alias("r"))

    def page(odd: int) -> Column:
        return F.array_join(F.transform(F.filter("r", lambda x: x["l_partkey"] % 2 == odd), lambda x: x["w"]), "\n")

    return rows.select("l_orderkey", F.concat(F.lit("<doc><page>"), page(1), F.lit("</page><page>"), page(0), F.lit("</page></doc>")).alias("xml"))


BBOX_SQL = """w AS (SELECT l_orderkey, CASE WHEN l_partkey % 2 = 1 THEN 0 ELSE 1 END AS page, l_linenumber, l_partkey, (l_partkey % 500)::DOUBLE AS x, l_quantity AS y, l_returnflag || '&' || l_partkey AS t,
    row_number() OVER (PARTITION BY l_orderkey, l_partkey % 2 ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) - 1 AS seq FROM lineitem)"""


def d1_bbox_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.words_of_bbox(_bbox(spark, sf_dir), "l_orderkey", "xml").select("l_orderkey", "page", "x", "y", "t")


def d2_tsv_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as recognition TSV: part keys that end in 0 have a blank text, those that end in 5 lack a field."""
    k = F.col("l_partkey")
    text = F.when(k % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), k.cast("string")))
    fields = [F.lit("5")] * 6 + [(k % 900).cast("string"), F.col("l_quantity").cast("int").cast("string")] + [F.lit("1")] * (3)
    line = F.concat_ws("\t", *fields, F.when(k % 10 == 5, F.lit(None)).otherwise(text))
    rows = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("w")))).alias("r"))
    docs = rows.select("l_orderkey", F.concat(F.lit("level\tpage\n\n"), F.array_join(F.transform("r", lambda x: x["w"]), "\r\n")).alias("tsv"))
    return layout.words_of_tsv(docs, "l_orderkey", "tsv").select("l_orderkey", "x", "y", "t")


def d3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _lines(spark, sf_dir).select("l_orderkey", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("seq"), F.col("l_returnflag").alias("t"))
    return layout.rows_of_words(words, ["l_orderkey"]).select("l_orderkey", F.col("row").cast("long").alias("row"), "row_text")


def d4_row_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.row_aligned_text(_bbox(spark, sf_dir), "l_orderkey", "xml").withColumn("text", F.replace("text", F.lit("\n"), F.lit("/")))


def d5_ocr_row_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as recognition TSV on two pages: lines with odd and with even part keys."""
    k = F.col("l_partkey")
    fields = [F.lit("5")] * 6 + [(k % 900).cast("string"), (F.col("l_quantity").cast("int") * 4).cast("string")] + [F.lit("1")] * 3
    line = F.concat_ws("\t", *fields, k.cast("string"))
    rows = _lines(spark, sf_dir).groupBy("l_orderkey", (k % 2).alias("page")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("w")))).alias("r"))
    pages = rows.select("l_orderkey", "page", F.concat(F.lit("level\n"), F.array_join(F.transform("r", lambda x: x["w"]), "\n")).alias("tsv"))
    return layout.ocr_row_aligned_text(pages, "l_orderkey", "page", "tsv").withColumn("text", F.replace("text", F.lit("\n"), F.lit("/")))


# E: candidates from conversations

READER_SQL = "['pdftotext', 'pdfbox', 'tesseract', 'ocrmypdf'][(turn % 4 + 1)::INT]"
CANDIDATES_SQL = f"""cand AS (SELECT conv_id, turn, {READER_SQL} AS reader, [10, 30, 50, 60][(turn % 4 + 1)::INT] * 1000 + turn AS priority,
    CASE WHEN turn % 5 = 4 THEN '  ' ELSE text END AS text, 'deu+eng' AS language FROM conversations), live AS (SELECT * FROM cand WHERE {PHP_TRIM_SQL.format(x="text")} <> '')"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as what readers made of a document; every fifth is blank."""
    at = (F.col("turn") % 4 + 1).cast("int")
    reader = F.element_at(F.array(*[F.lit(x) for x in reg.READERS]), at)
    priority = F.element_at(F.array(*[F.lit(v[0]) for v in reg.READERS.values()]), at) * 1000 + F.col("turn")
    text = F.when(F.col("turn") % 5 == 4, "  ").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reader.alias("reader"), priority.alias("priority"), text.alias("text"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("has_embedded_text", F.col("conv_id") % 3 != 0)


def _told(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "reader", "is_scanned", F.sha1("text").alias("text_sha1"))


def _extract(**options: object):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _told(select.extract_text(_documents(spark, sf_dir), spread(_candidates(spark, sf_dir)), "conv_id", options=select.Options(**options)))

    return query


def _unpack(df: DataFrame) -> DataFrame:
    return df.select("conv_id", F.col("result.reader").alias("reader"), F.sha1("result.text").alias("text_sha1"))


def e2_text_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unpack(select.text_waterfall(_candidates(spark, sf_dir), "conv_id"))


def e3_ocr_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unpack(select.ocr_waterfall(spread(_candidates(spark, sf_dir)), "conv_id"))


def e4_selective(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", (F.col("turn") + 1).alias("page")).agg(F.min("text").alias("text"))
    other = turns.select((F.col("conv_id") + 1).alias("conv_id"), "page", "text")
    got = select.selective_pages(turns, other, "conv_id")
    return got.select("conv_id", F.sha1("text").alias("text_sha1"), "selective_ocr", F.array_join(F.col("low_quality_pages").cast("array<string>"), ",").alias("low_pages"), "mode")


def e5_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unpack(select.preferred_reader(_candidates(spark, sf_dir), "conv_id", "pdfbox"))


def e6_text_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(select.extract_text_only(_documents(spark, sf_dir), _candidates(spark, sf_dir), "conv_id", preferred="tesseract"))


def e7_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = select.extract_all(_candidates(spark, sf_dir), "conv_id")
    return got.select("conv_id", "reader", "is_scanned", F.array_join(F.transform("alternatives", lambda a: a["reader"]), ",").alias("others"))


def e8_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = select.Options()
    return spark.createDataFrame([(o.quality_check, o.threshold, o.language)], "quality_check boolean, threshold double, language string")


def e9_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.withColumn("raw", F.replace("text", F.lit("e"), F.lit("ii")))
    both = q.with_quality(q.with_quality(docs.withColumn("swap", F.col("doc_id") % 2 == 0).select("doc_id", F.when(F.col("swap"), F.col("raw")).otherwise(F.col("text")).alias("layout"), F.when(F.col("swap"), F.col("text")).otherwise(F.col("raw")).alias("raw")), "layout", into="ls"), "raw", into="rs")
    return both.select("doc_id", F.sha1(select.dual_strategy(F.col("layout"), F.col("raw"), F.round("ls", 9), F.round("rs", 9))).alias("text_sha1"))


def _tries(spark: SparkSession, sf_dir: str, modes: list[tuple[int, int, int]]) -> DataFrame:
    tries = F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(p).alias("psm"), F.lit(d).alias("dpi")) for o, p, d in modes]))
    rows = table(spark, sf_dir, "documents").select("doc_id", tries.alias("t")).select("doc_id", "t.*")
    return rows.withColumn("score", ((F.col("doc_id") * 37 + F.col("psm") * 101 + F.col("dpi")) % 83).cast("double"))


def _cascade(modes: list[tuple[int, int, int]]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select.cascade(_tries(spark, sf_dir, modes), "doc_id", "ord")

    return query


def _cascade_sql(modes: list[tuple[int, int, int]]) -> str:
    rows = ", ".join(f"({o}, {p}, {d})" for o, p, d in modes)
    return f"""WITH t(ord, psm, dpi) AS (VALUES {rows}), s AS (SELECT doc_id, ord, ((doc_id * 37 + psm * 101 + dpi) % 83)::DOUBLE AS score FROM documents, t)
        SELECT doc_id, ord, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN score >= 60 THEN 0 ELSE 1 END, CASE WHEN score >= 60 THEN ord END, score DESC, ord) = 1"""


TESSERACT, OCRMYPDF = select.settings_cascade(3, 300), [t for t in select.settings_cascade(11, 300, select.OCRMYPDF_CASCADE) if t[2] == 300]


def e11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    marks = {"deu": "f r ", "eng": "", "deu+eng": "ae "}
    each = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(x).alias("language"), F.concat(F.lit(m), F.col("text")).alias("text")) for k, (x, m) in enumerate(marks.items())])
    best = q.best_result(docs.select("doc_id", F.explode(each).alias("c")).select("doc_id", "c.*"), "doc_id", "ord")
    return best.select("doc_id", "language", r6(F.col("score")).alias("score"))


def e13_first_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.when(F.col("doc_id") % 2 == 0, "  ").when(F.col("doc_id") % 3 == 0, F.col("source"))
    two = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", select.first_text(one, two).alias("found"))


def e14_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for each of four variants: what its option set chooses."""
    docs, cands = _documents(spark, sf_dir), spread(_candidates(spark, sf_dir))
    sets = {"default": select.Options(), "ocr": select.Options(force_ocr=True), "quality": select.Options(threshold=80.0)}
    rows = [_told(select.extract_text(docs, cands, "conv_id", options=o)).withColumn("variant", F.lit(n)) for n, o in sets.items()]
    rows.append(_told(select.extract_text_only(docs, cands, "conv_id")).withColumn("variant", F.lit("textonly")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("variant").agg(F.count("*").alias("n"), F.count("text_sha1").alias("with_text"), F.sum(F.col("is_scanned").cast("long")).alias("scanned"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as words, two in a line."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    return turns.select("conv_id", F.lit(0).alias("page"), F.col("turn").alias("seq"), (F.col("turn") % 3).cast("double").alias("x"), (F.floor(F.col("turn") / 2) * 10).cast("double").alias("y"), F.concat(F.lit("w"), F.col("turn").cast("string")).alias("t"))


def e14_all_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the eight variants of a document as a row."""
    mode = F.when(F.col("reader") == "pdftotext", F.when(F.col("turn") % 8 == 0, "layout").otherwise("raw"))
    boxes = _boxes(spark, sf_dir)
    provider = TextProvider(_documents(spark, sf_dir), spread(_candidates(spark, sf_dir)).withColumn("mode", mode), "conv_id", words=boxes, ocr_words=boxes)
    return provider.variants().select("conv_id", "variant", "reader", "is_scanned", F.sha1("text").alias("text_sha1"))


def e15_by_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = _candidates(spark, sf_dir).where(F.col("reader") == "tesseract").groupBy("conv_id").agg(F.min_by("text", "priority").alias("t"))
    return _documents(spark, sf_dir).join(only, "conv_id", "left").select("conv_id", F.sha1(blank_to_null(F.col("t"))).alias("text_sha1"))


def e16_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = select.extract_all(_candidates(spark, sf_dir), "conv_id")
    best = select.longest_result(F.col("text"), F.col("reader"), F.col("is_scanned"), F.col("alternatives"))
    return got.withColumn("b", best).select("conv_id", "reader", "is_scanned", F.length("b.text").cast("long").alias("default_chars"))


def e17_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default texts seeded where the given text isn't blank."""
    text = F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(blank_to_null(text)).alias("seeded"), F.count("*").alias("given"))


E1_SQL = f"""WITH {CANDIDATES_SQL}, {scores_sql("live", "conv_id, turn, reader, priority")},
    docs AS (SELECT DISTINCT conv_id, conv_id % 3 <> 0 AS emb FROM conversations),
    t AS (SELECT * FROM scored WHERE reader IN ('pdftotext', 'pdfbox') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY priority) = 1),
    o AS (SELECT * FROM scored WHERE reader IN ('tesseract', 'ocrmypdf') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN score >= {{limit}} THEN 0 ELSE 1 END, CASE WHEN score >= {{limit}} THEN priority END, round(score, 12) DESC, priority) = 1),
    j AS (SELECT docs.conv_id, emb, t.reader AS tr, t.text AS tt, t.score AS ts, o.reader AS orr, o.text AS ot, o.score AS os FROM docs LEFT JOIN t USING (conv_id) LEFT JOIN o USING (conv_id)),
    c AS (SELECT *, {{way}} AS use_o FROM j)
    SELECT conv_id, CASE WHEN use_o THEN orr ELSE tr END AS reader, coalesce(use_o AND orr IS NOT NULL, false) AS is_scanned, sha1(CASE WHEN use_o THEN ot ELSE tt END) AS text_sha1 FROM c"""
_GATE = "CASE WHEN emb THEN coalesce(tt IS NOT NULL AND ts < {limit} AND os > ts, false) ELSE true END"


# F: cache

NOW = "2024-03-01 00:00:00"


def f1_option_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")

    def maybe(m: int, value: Column) -> Column:
        return F.when(k % m != 0, value)

    key = cache.option_key(k % 2 == 0, k % 3 == 0, maybe(5, k % 7 == 0), maybe(4, k % 2 == 0), maybe(6, k % 5 == 0), maybe(2, (k % 90).cast("int")), maybe(7, F.lit("deu")), maybe(8, F.lit("pdfbox")))
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"))


def f2_provider_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's cached variants by key; a cached null is a value."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("variant"), (F.col("turn") % 3).cast("string")).alias("key"), F.when(F.col("turn") % 4 != 0, F.col("text")).alias("text"))
    return rows.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"), F.max(F.when(F.col("text").isNotNull(), 1).otherwise(0)).cast("boolean").alias("has_text"))


def f3_content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = F.create_map(F.lit("psm"), (F.col("doc_id") % 7).cast("string"), F.lit("dpi"), F.lit("300"), F.lit("lang"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", cache.content_key(F.col("text"), F.lit("tesseract"), params).alias("key"))


def _events_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("-"), (F.col("user_id") % 200).cast("string")).alias("key"), F.col("props").alias("text"), F.col("ts").alias("stored_at"), "event_id")


def f4_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "view").otherwise("click"), F.lit("-"), (F.col("o_orderkey") % 250).cast("string")).alias("key"))
    latest = F.max("stored_at")
    cached = _events_cache(spark, sf_dir).groupBy("key").agg(latest.alias("stored_at"), F.count("*").cast("string").alias("text"))
    got = cache.lookup(wanted, cached, F.lit(NOW).cast("timestamp"), 30)
    return got.select("o_orderkey", "key", "text")


def f5_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _events_cache(spark, sf_dir).where("event_id % 2 = 0")
    results = _events_cache(spark, sf_dir).where("event_id % 2 = 1").withColumn("text", F.when(F.col("event_id") % 10 == 1, " ").otherwise(F.col("text")))
    return cache.to_store(results, stored)


def f6_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.expired(_events_cache(spark, sf_dir), F.lit(NOW).cast("timestamp"), 30).groupBy("key").agg(F.count("*").alias("n"))


# G: pages

def g1_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").alias("page"), "l_partkey")
    return pages.page_range(lines, 2, 3)


def _counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey") % 17


def g2_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = _counts(spark, sf_dir)
    return pages.single_pages(docs, "o_orderkey", n)


def g3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = _counts(spark, sf_dir)
    return pages.page_blocks(docs, "o_orderkey", n, 3)


def g4_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _lines(spark, sf_dir).withColumn("file", F.format_string("f%d.pdf", F.col("l_partkey"))).withColumn("valid", F.col("l_partkey") % 10 != 0)
    plan = pages.merge_plan(files, "l_orderkey", ["l_linenumber", "l_partkey"], "file", "valid")
    return plan.select("l_orderkey", F.array_join("files", "+").alias("files"), "mergeable")


# H, M, O: capabilities and names

def h5_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.reader_dim(spark)


def h4_reader_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.reader_dim(spark).groupBy("is_ocr_only").agg(F.count("*").alias("n"), F.min_by("reader", "priority").alias("first"))


def m4_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.writer_dim(spark)


def m1_writer_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which writer takes an order: the preferred one if it can run here, else the first that can."""
    names = F.array(*[F.lit(x) for x in reg.LISTED_WRITERS])
    wanted = F.element_at(names, (F.col("o_orderkey") % 3 + 1).cast("int"))
    dim = F.broadcast(reg.writer_dim(spark).where(F.col("writer").isin(reg.LISTED_WRITERS)))
    first = dim.where(~F.col("requires_external_tool")).agg(F.min_by("writer", "priority").alias("first"))
    both = table(spark, sf_dir, "orders").select("o_orderkey", wanted.alias("wanted")).join(dim, F.col("wanted") == F.col("writer")).join(F.broadcast(first), F.lit(True))
    return both.select("o_orderkey", F.when(F.col("requires_external_tool"), F.col("first")).otherwise(F.col("wanted")).alias("writer"))


def o3_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    command = wkhtmltopdf_command(F.when(k % 2 == 0, "A5").otherwise("A4"), F.when(k % 3 == 0, "Landscape"), (k % 20).cast("int"), F.lit("in.html"), F.lit("out.pdf"))
    return parts(spark, sf_dir).select("p_partkey", command.alias("command"))


def o4_invoice_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, "own.xml")
    return parts(spark, sf_dir).select("p_partkey", attachment_name(given).alias("name"))


QUERIES = {
    "D1_bbox_words": d1_bbox_words, "D2_tsv_words": d2_tsv_words, "D3_rows": d3_rows, "D4_row_aligned": d4_row_aligned, "D5_ocr_row_aligned": d5_ocr_row_aligned,
    "E1_extract_text": _extract(), "E2_text_waterfall": e2_text_waterfall, "E3_ocr_waterfall": e3_ocr_waterfall, "E4_selective": e4_selective,
    "E5_preferred": e5_preferred, "E6_text_only": e6_text_only, "E7_all": e7_all, "E8_settings": e8_settings, "E9_dual": e9_dual,
    "E10_tesseract_cascade": _cascade(TESSERACT), "E11_language": e11_language, "E12_ocrmypdf_cascade": _cascade(OCRMYPDF), "E13_first_text": e13_first_text,
    "E14_variants": e14_variants, "E14_all_variants": e14_all_variants, "E15_by_reader": e15_by_reader, "E16_provider": e16_provider, "E17_seed": e17_seed,
    "F1_option_key": f1_option_key, "F2_provider_cache": f2_provider_cache, "F3_content_key": f3_content_key, "F4_get": f4_get, "F5_put": f5_put, "F6_expired": f6_expired,
    "G1_range": g1_range, "G2_single": g2_single, "G3_blocks": g3_blocks, "G4_merge": g4_merge,
    "H4_reader_queries": h4_reader_queries, "H5_readers": h5_readers, "M1_writer_choice": m1_writer_choice, "M4_writers": m4_writers, "O3_command": o3_command, "O4_invoice_name": o4_invoice_name,
}

_ROWS_SQL = """g AS (SELECT *, CASE WHEN y - lag(y) OVER o > 3 THEN 1 ELSE 0 END AS gap FROM {w} WINDOW o AS (PARTITION BY {by} ORDER BY y, seq)),
    r AS (SELECT *, sum(gap) OVER (PARTITION BY {by} ORDER BY y, seq ROWS UNBOUNDED PRECEDING) AS row FROM g),
    l AS (SELECT {by}, row, string_agg(t, ' ' ORDER BY x, y, seq) AS row_text FROM r GROUP BY {by}, row)"""
_READER_ROWS = ", ".join(f"({quoted(n)}, {p}, {s}, {t}, {s and not t}, {quoted(d)})" for n, (p, s, t, d) in reg.READERS.items())
_WRITER_ROWS = ", ".join(f"({quoted(n)}, {p}, {h}, {t}, {x}, {quoted(d)})" for n, (p, h, t, x, d) in reg.WRITERS.items())
_READERS_SQL = f"d(reader, priority, supports_scanned, supports_text, is_ocr_only, description) AS (VALUES {_READER_ROWS})"
_WRITERS_SQL = f"d(writer, priority, supports_html, supports_text, requires_external_tool, description) AS (VALUES {_WRITER_ROWS})"
_FIRST_TEXT = f"WITH {CANDIDATES_SQL} SELECT conv_id, reader, sha1(text) AS text_sha1 FROM live WHERE reader IN ({{readers}}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY priority) = 1"
_EVENTS = "(SELECT event_type || '-' || (user_id % 200) AS key, props AS text, ts AS stored_at, event_id FROM events)"
_EXTRACT = {n: E1_SQL.replace("{limit}", str(limit)).replace("{way}", way.replace("{limit}", str(limit))) for n, limit, way in (("default", 60, _GATE), ("ocr", 60, "true"), ("quality", 80, _GATE))}
_TEXT_ONLY = f"WITH {CANDIDATES_SQL}, t AS (SELECT * FROM live WHERE reader IN ('pdftotext', 'pdfbox') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY priority) = 1) SELECT conv_id, reader, false AS is_scanned, sha1(text) AS text_sha1 FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN t USING (conv_id)"
_OF_MODE = f"WITH {CANDIDATES_SQL}, t AS (SELECT conv_id, reader, text FROM live WHERE reader = 'pdftotext' AND turn % 8 = {{k}} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY priority) = 1) SELECT conv_id, reader, false AS is_scanned, sha1(text) AS text_sha1 FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN t USING (conv_id)"
_WORDS = "(SELECT conv_id, turn // 2 AS line, turn, string_agg('w' || turn, '') AS t FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY ALL)"
_MODES = {
    "layout": _OF_MODE.format(k=0), "raw": _OF_MODE.format(k=4),
    "rowaligned": f"SELECT conv_id, NULL::VARCHAR AS reader, false AS is_scanned, sha1(string_agg(t, chr(10) ORDER BY line)) AS text_sha1 FROM (SELECT conv_id, line, string_agg(t, ' ' ORDER BY turn % 3, turn) AS t FROM {_WORDS} GROUP BY ALL) GROUP BY conv_id",
    "ocr-rowaligned": f"SELECT conv_id, NULL::VARCHAR AS reader, true AS is_scanned, sha1(string_agg(t, ' ' ORDER BY turn % 3, turn)) AS text_sha1 FROM {_WORDS} GROUP BY conv_id",
}

ORACLE = {
    "D1_bbox_words": f"WITH {BBOX_SQL} SELECT l_orderkey, page, x, y, t FROM w",
    "D2_tsv_words": "SELECT l_orderkey, (l_partkey % 900)::DOUBLE AS x, l_quantity::INT::DOUBLE AS y, l_partkey::VARCHAR AS t FROM lineitem WHERE l_partkey % 10 NOT IN (0, 5)",
    "D3_rows": f"WITH w AS (SELECT l_orderkey, l_extendedprice AS x, l_quantity AS y, l_linenumber * 10000000 + l_partkey AS seq, l_returnflag AS t FROM lineitem), {_ROWS_SQL.format(w='w', by='l_orderkey')} SELECT l_orderkey, row::BIGINT AS row, row_text FROM l",
    "D4_row_aligned": f"""WITH {BBOX_SQL}, {_ROWS_SQL.format(w='w', by='l_orderkey, page')}, p AS (SELECT l_orderkey, page, string_agg(row_text, '/' ORDER BY row) AS text FROM l GROUP BY ALL)
        SELECT l_orderkey, string_agg(text, '/' ORDER BY page) AS text FROM p GROUP BY l_orderkey""",
    "D5_ocr_row_aligned": f"""WITH w AS (SELECT l_orderkey, l_partkey % 2 AS page, (l_partkey % 900)::DOUBLE AS x, (l_quantity::INT * 4)::DOUBLE AS y, l_partkey::VARCHAR AS t,
            row_number() OVER (PARTITION BY l_orderkey, l_partkey % 2 ORDER BY l_linenumber, l_partkey, l_quantity) AS seq FROM lineitem),
        {_ROWS_SQL.replace("> 3", "> 15").format(w='w', by='l_orderkey, page')}, p AS (SELECT l_orderkey, page, string_agg(row_text, '/' ORDER BY row) AS text FROM l GROUP BY ALL)
        SELECT l_orderkey, string_agg(text, '/' ORDER BY page) AS text FROM p GROUP BY l_orderkey""",
    "E14_all_variants": "SELECT conv_id, variant, reader, is_scanned, text_sha1 FROM (" + " UNION ALL ".join(f"SELECT conv_id, {quoted(n)} AS variant, reader, is_scanned, text_sha1 FROM ({q})" for n, q in (*_EXTRACT.items(), ("textonly", _TEXT_ONLY), *_MODES.items())) + ")",
    "E1_extract_text": _EXTRACT["default"],
    "E2_text_waterfall": _FIRST_TEXT.format(readers="'pdftotext', 'pdfbox'"),
    "E3_ocr_waterfall": f"""WITH {CANDIDATES_SQL}, {scores_sql("live", "conv_id, turn, reader, priority")} SELECT conv_id, reader, sha1(text) AS text_sha1 FROM scored WHERE reader IN ('tesseract', 'ocrmypdf')
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN score >= 60 THEN 0 ELSE 1 END, CASE WHEN score >= 60 THEN priority END, round(score, 12) DESC, priority) = 1""",
    "E4_selective": f"""WITH turns AS (SELECT conv_id, turn + 1 AS page, min(text) AS text FROM conversations GROUP BY ALL),
        every AS (SELECT conv_id, page, 0 AS other, text AS raw, {PHP_TRIM_SQL.format(x="text")} AS text, 'deu+eng' AS language FROM turns UNION ALL SELECT conv_id + 1, page, 1, text, {PHP_TRIM_SQL.format(x="text")}, 'deu+eng' FROM turns),
        {scores_sql("every", "conv_id, page, other, raw")},
        b AS (SELECT a.conv_id, a.page, a.raw, a.score, o.text AS ot, o.score AS os FROM (SELECT * FROM scored WHERE other = 0) a LEFT JOIN (SELECT * FROM scored WHERE other = 1) o USING (conv_id, page)),
        m AS (SELECT conv_id, count(*) FILTER (WHERE score < 60) AS low, count(*) AS n FROM b GROUP BY conv_id),
        p AS (SELECT *, CASE WHEN low = 0 THEN 'keep' WHEN low > n * 0.5 THEN 'full' ELSE 'selective' END AS mode FROM b JOIN m USING (conv_id)),
        x AS (SELECT *, mode = 'selective' AND score < 60 AND coalesce(length(ot), 0) > 0 AND coalesce(os > score, false) AS rep FROM p)
        SELECT conv_id, sha1(string_agg(CASE WHEN rep THEN ot ELSE raw END, chr(12) ORDER BY page)) AS text_sha1, bool_or(rep) AS selective_ocr, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (WHERE score < 60), '') AS low_pages, any_value(mode) AS mode FROM x GROUP BY conv_id""",
    "E5_preferred": _FIRST_TEXT.format(readers="'pdfbox'"),
    "E6_text_only": _TEXT_ONLY,
    "E7_all": f"""WITH {CANDIDATES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY priority) AS k FROM live)
        SELECT conv_id, min_by(reader, k) AS reader, min_by(reader, k) IN ('tesseract', 'ocrmypdf') AS is_scanned, coalesce(string_agg(reader, ',' ORDER BY k) FILTER (WHERE k > 1), '') AS others FROM r GROUP BY conv_id""",
    "E8_settings": "SELECT true AS quality_check, 60.0::DOUBLE AS threshold, 'deu+eng' AS language",
    "E9_dual": f"""WITH v AS (SELECT doc_id, 0 AS raw, CASE WHEN doc_id % 2 = 0 THEN replace(text, 'e', 'ii') ELSE text END AS text, 'deu+eng' AS language FROM documents
            UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 2 = 0 THEN text ELSE replace(text, 'e', 'ii') END, 'deu+eng' FROM documents), {scores_sql("v", "doc_id, raw")}
        SELECT doc_id, sha1(text) AS text_sha1 FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, raw) = 1""",
    "E10_tesseract_cascade": _cascade_sql(TESSERACT),
    "E11_language": f"""WITH v AS (SELECT doc_id, o AS ord, l AS language, m || text AS text FROM documents, (VALUES (0, 'deu', 'f r '), (1, 'eng', ''), (2, 'deu+eng', 'ae ')) x(o, l, m)), {scores_sql("v", "doc_id, ord")}
        SELECT doc_id, CASE WHEN score > 0 THEN language ELSE '' END AS language, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, ord) = 1""",
    "E12_ocrmypdf_cascade": _cascade_sql(OCRMYPDF),
    "E13_first_text": "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 <> 0 AND doc_id % 3 = 0 THEN source END, CASE WHEN doc_id % 5 <> 0 THEN lang END) AS found FROM documents",
    "E14_variants": "SELECT variant, count(*) AS n, count(text_sha1) AS with_text, sum(is_scanned::BIGINT)::BIGINT AS scanned FROM (" + " UNION ALL ".join(f"SELECT *, {quoted(n)} AS variant FROM ({s})" for n, s in (*_EXTRACT.items(), ("textonly", _TEXT_ONLY))) + ") GROUP BY variant",
    "E15_by_reader": f"WITH {CANDIDATES_SQL}, t AS (SELECT conv_id, min_by(text, priority) AS t FROM cand WHERE reader = 'tesseract' GROUP BY conv_id) SELECT conv_id, sha1(CASE WHEN {PHP_TRIM_SQL.format(x='t')} <> '' THEN t END) AS text_sha1 FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN t USING (conv_id)",
    "E16_provider": f"WITH {CANDIDATES_SQL} SELECT conv_id, min_by(reader, priority) AS reader, min_by(reader, priority) IN ('tesseract', 'ocrmypdf') AS is_scanned, max(length(text)) AS default_chars FROM live GROUP BY conv_id",
    "E17_seed": f"SELECT conv_id, count(*) FILTER (WHERE turn % 3 <> 0 AND {PHP_TRIM_SQL.format(x='text')} <> '') AS seeded, count(*) AS given FROM conversations GROUP BY conv_id",
    "F1_option_key": """SELECT o_orderkey, concat_ws(':', 'doc', CASE WHEN k % 2 = 0 THEN 'ocr' END, CASE WHEN k % 3 = 0 THEN 'textonly' END, CASE WHEN k % 5 <> 0 THEN 'layout=' || (k % 7 = 0)::INT END, CASE WHEN k % 4 <> 0 AND k % 2 <> 0 THEN 'nodual' END,
        CASE WHEN k % 6 <> 0 THEN 'qc=' || (k % 5 = 0)::INT END, CASE WHEN k % 2 <> 0 THEN 'qt=' || (k % 90) END, CASE WHEN k % 7 <> 0 THEN 'lang=deu' END, CASE WHEN k % 8 <> 0 THEN 'reader=pdfbox' END) AS key FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""",
    "F2_provider_cache": "SELECT conv_id, string_agg(DISTINCT 'variant' || (turn % 3), ',' ORDER BY 'variant' || (turn % 3)) AS keys, bool_or(turn % 4 <> 0 AND text IS NOT NULL) AS has_text FROM conversations GROUP BY conv_id",
    "F3_content_key": "SELECT doc_id, sha1(sha1(text) || '|tesseract|dpi=300&lang=' || lang || '&psm=' || (doc_id % 7)) AS key FROM documents",
    "F4_get": f"""WITH c AS (SELECT key, max(stored_at) AS stored_at, count(*)::VARCHAR AS text FROM {_EVENTS} GROUP BY key)
        SELECT o_orderkey, w.key, c.text FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'view' ELSE 'click' END || '-' || (o_orderkey % 250) AS key FROM orders) w
        LEFT JOIN c ON c.key = w.key AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(stored_at) <= 30 * 86400000000""",
    "F5_put": f"""WITH r AS (SELECT key, CASE WHEN event_id % 10 = 1 THEN ' ' ELSE text END AS text FROM {_EVENTS} WHERE event_id % 2 = 1)
        SELECT key, min(text) AS text FROM r WHERE {PHP_TRIM_SQL.format(x="text")} <> '' AND key NOT IN (SELECT key FROM {_EVENTS} WHERE event_id % 2 = 0) GROUP BY key""",
    "F6_expired": f"SELECT key, count(*) AS n FROM {_EVENTS} WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(stored_at) > 30 * 86400000000 GROUP BY key",
    "G1_range": "SELECT l_orderkey, l_linenumber AS page, l_partkey FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3",
    "G2_single": "SELECT o_orderkey, p::INT AS page, printf('page_%03d.pdf', p) AS file FROM (SELECT o_orderkey, unnest(range(1, o_orderkey % 17 + 1)) AS p FROM orders)",
    "G3_blocks": "SELECT o_orderkey, ((f - 1) // 3 + 1)::INT AS part, f::INT AS first, least(f + 2, o_orderkey % 17)::INT AS last, printf('part_%03d.pdf', (f - 1) // 3 + 1) AS file FROM (SELECT o_orderkey, unnest(range(1, o_orderkey % 17 + 1, 3)) AS f FROM orders)",
    "G4_merge": "SELECT l_orderkey, string_agg('f' || l_partkey || '.pdf', '+' ORDER BY l_linenumber, l_partkey) AS files, count(*) >= 2 AND bool_and(l_partkey % 10 <> 0) AS mergeable FROM lineitem GROUP BY l_orderkey",
    "H4_reader_queries": f"WITH {_READERS_SQL} SELECT is_ocr_only, count(*) AS n, min_by(reader, priority) AS first FROM d GROUP BY is_ocr_only",
    "H5_readers": f"WITH {_READERS_SQL} SELECT * FROM d",
    "M1_writer_choice": "SELECT o_orderkey, ['dompdf', 'tcpdf', 'dompdf'][(o_orderkey % 3 + 1)::INT] AS writer FROM orders",
    "M4_writers": f"WITH {_WRITERS_SQL} SELECT * FROM d",
    "O3_command": "SELECT p_partkey, concat_ws(' ', 'wkhtmltopdf', '--encoding UTF-8', '--page-size ' || CASE WHEN p_partkey % 2 = 0 THEN 'A5' ELSE 'A4' END, CASE WHEN p_partkey % 3 = 0 THEN '--orientation Landscape' END, '--margin-top ' || (p_partkey % 20) || 'mm', 'in.html', 'out.pdf') AS command FROM part",
    "O4_invoice_name": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 'own.xml' ELSE 'factur-x.xml' END AS name FROM part",
}
