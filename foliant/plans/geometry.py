"""Page-geometry queries C1 to C17 over sizes made from ``part``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import page_count, parse_metadata
from .common import parts, quoted, r6, table

_ROWS = ", ".join(f"({k}, {quoted(n)}, {w}::DOUBLE, {h}::DOUBLE, {g.DETECTION_ORDER.index(n)})" for k, (n, w, h) in enumerate(g.PAPER_FORMATS))
FORMATS_SQL = f"formats(declared, name, fw, fh, detect_ord) AS (VALUES {_ROWS})"
#: A page for each part: a format by its key, moved by up to 8 points, turned for every third.
SIZES_SQL = f"""{FORMATS_SQL}, sizes AS (
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN fh ELSE fw END + (p_partkey % 17 - 8) AS w, CASE WHEN p_partkey % 3 = 0 THEN fw ELSE fh END + (p_partkey % 5 - 2) AS h
    FROM part JOIN formats ON p_partkey % 26 = declared)"""
MATCH_SQL = "(abs(w - fw) <= 5 AND abs(h - fh) <= 5 OR abs(w - fh) <= 5 AND abs(h - fw) <= 5)"
DETECT_SQL = f"(SELECT min_by(name, detect_ord) FROM formats WHERE {MATCH_SQL})"


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    formats = F.broadcast(g.paper_formats(spark))
    both = parts(spark, sf_dir).join(formats, F.col("p_partkey") % 26 == F.col("declared"))
    turn, fw, fh = F.col("p_partkey") % 3 == 0, F.col("format_width"), F.col("format_height")
    w = F.when(turn, fh).otherwise(fw) + (F.col("p_partkey") % 17 - 8)
    return both.select("p_partkey", w.alias("w"), (F.when(turn, fw).otherwise(fh) + (F.col("p_partkey") % 5 - 2)).alias("h"))




def _w() -> tuple[Column, Column]:
    return F.col("w"), F.col("h")


def _info() -> Column:
    """What a PDF information tool would print for a part."""
    k = F.col("p_partkey")
    return F.concat(
        F.lit("Title:   Part "), k.cast("string"), F.lit("\nPages:          "), (k % 9).cast("string"), F.lit("\nPage size:      "),
        F.col("p_size").cast("string"), F.lit(".5 x "), (k % 700 + 100).cast("string"), F.lit(".3 pts (custom)\nPage rot:       "), ((k % 4) * 90).cast("string"), F.lit("\nLanguage: de\nTitle: last"),
    )


INFO_SQL = "'Title:   Part ' || p_partkey || chr(10) || 'Pages:          ' || (p_partkey % 9) || chr(10) || 'Page size:      ' || p_size || '.5 x ' || (p_partkey % 700 + 100) || '.3 pts (custom)' || chr(10) || 'Page rot:       ' || ((p_partkey % 4) * 90) || chr(10) || 'Language: de' || chr(10) || 'Title: last'"


def c1_page_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = parts(spark, sf_dir, "p_size").withColumn("s", g.parse_page_size(_info()))
    mm, inch = g.from_mm(F.col("p_size").cast("double")), g.from_inches(F.col("p_size").cast("double"))
    return pages.select("p_partkey", F.col("s.width_pt").alias("width_pt"), F.col("s.height_pt").alias("height_pt"), r6(mm).alias("from_mm"), r6(inch).alias("from_inches"), g.parse_page_size(F.lit("invalid")).isNull().alias("no_match"))


def c2_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = _w()
    mm, inch = g.in_unit(w, h, "mm"), g.in_unit(w, h, "in")
    return sizes(spark, sf_dir).select("p_partkey", r6(mm["width"]).alias("w_mm"), r6(mm["height"]).alias("h_mm"), r6(inch["width"]).alias("w_in"), r6(inch["height"]).alias("h_in"), r6(g.area(w, h)).alias("area"), r6(g.aspect_ratio(w, h)).alias("ratio"))


def c3_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = _w()
    return sizes(spark, sf_dir).select("p_partkey", g.is_landscape(w, h).alias("landscape"), g.is_portrait(w, h).alias("portrait"), g.is_square(w, h).alias("square"))


def c4_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = g.paper_formats(spark)
    return f.select("name", F.col("format_width").alias("w_pt"), F.col("format_height").alias("h_pt"), r6(g.to_mm(F.col("format_width"))).alias("w_mm"), r6(g.to_inches(F.col("format_height"))).alias("h_in"))


def c5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = g.matching_formats(sizes(spark, sf_dir), "w", "h")
    strict = g.matches(*_w(), F.col("format_width"), F.col("format_height"), ignore_orientation=False)
    return found.select("p_partkey", "name", strict.alias("unturned"))


def c6_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).select("p_partkey", g.detect_format(*_w()).alias("format"))


def c7_format_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.matching_formats(sizes(spark, sf_dir), "w", "h").where(g.is_landscape(*_w())).select("p_partkey", "name")


def c8_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("A4", "a4", "LETTER", "JIS-B4", "jisb4", "jb5", "legal ", "c_5", "invalid", "")])
    given = F.element_at(names, (F.col("p_partkey") % 10 + 1).cast("int"))
    return parts(spark, sf_dir).select("p_partkey", given.alias("given"), g.format_of_name(given).alias("format"))


def c9_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).select("p_partkey", g.size_description(*_w()).alias("description"))


def c10_file_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = parts(spark, sf_dir, "p_size").withColumn("m", parse_metadata(_info()))
    size = g.parse_page_size(F.try_element_at("m", F.lit("Page size")))
    files = files.select("p_partkey", size["width_pt"].alias("w"), size["height_pt"].alias("h"))
    return files.select("p_partkey", "w", "h", g.is_landscape(*_w()).alias("landscape"), (F.coalesce(g.detect_format(*_w()), F.lit("")) == "A8").alias("is_a8"), g.size_description(*_w()).alias("description"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, lines as pages; every fifth order prints no sizes of its pages."""
    line = F.format_string("Page %4d size: %s x %s pts", F.col("l_linenumber"), (F.col("l_quantity").cast("int") + 200).cast("string"), (F.col("l_orderkey") % 3 + F.col("l_linenumber") * 2).cast("string"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.struct("l_linenumber", line.alias("line")).alias("x"))
    docs = lines.groupBy("doc").agg(F.array_sort(F.collect_list("x")).alias("x"))
    body = F.when(F.col("doc") % 5 == 0, "").otherwise(F.array_join(F.transform("x", lambda x: x["line"]), "\n"))
    return docs.select("doc", F.concat(F.lit("Pages: "), F.size("x").cast("string"), F.lit("\nPage size: 595.28 x 841.89 pts (A4)\n"), body).alias("output"))


def all_page_sizes(docs: DataFrame) -> DataFrame:
    """(doc, page_number, width_pt, height_pt): printed sizes, or the default size on every page where none is."""
    read = docs.select("doc", "output", g.page_size_lines(F.col("output")).alias("sizes"))
    read = read.select("doc", "sizes", F.when(F.size("sizes") == 0, parse_metadata(F.col("output"))).alias("m"))
    default = g.parse_page_size(F.try_element_at("m", F.lit("Page size")))
    n = page_count(F.col("m"))
    repeated = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("page_number"), default["width_pt"].alias("width_pt"), default["height_pt"].alias("height_pt")))
    every = F.when(F.size("sizes") > 0, F.col("sizes")).when((n > 0) & default.isNotNull(), repeated)
    return read.select("doc", F.explode(every).alias("p")).select("doc", "p.page_number", "p.width_pt", "p.height_pt")


def c11_page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_page_sizes(_pages(spark, sf_dir))


def c12_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.uniform_sizes(all_page_sizes(_pages(spark, sf_dir)), "doc", 12.0)


def c13_start_psm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).select("p_partkey", g.start_psm(*_w()).cast("long").alias("psm"))


def c14_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = parts(spark, sf_dir, "p_size").withColumn("m", parse_metadata(_info()))
    s = g.effective_size(F.try_element_at("m", F.lit("Page size")), F.try_element_at("m", F.lit("Page rot")).try_cast("int"))
    return files.select("p_partkey", s["width_pt"].alias("width_pt"), s["height_pt"].alias("height_pt"))


def _margins() -> Column:
    k = F.col("p_partkey")
    values = F.array(*[(k % m).cast("double") for m in (7, 11, 13, 17, 19)])
    return F.slice(values, F.lit(1), (k % 6).cast("int"))


MARGINS_SQL = "[(p_partkey % 7)::DOUBLE, (p_partkey % 11)::DOUBLE, (p_partkey % 13)::DOUBLE, (p_partkey % 17)::DOUBLE, (p_partkey % 19)::DOUBLE]"
MARGIN_SQL = f"""margin AS (SELECT p_partkey, {MARGINS_SQL} AS v, p_partkey % 6 AS n FROM part), box AS (
    SELECT p_partkey, CASE WHEN n BETWEEN 1 AND 4 THEN v[1] ELSE 0 END AS t, CASE WHEN n = 1 THEN v[1] WHEN n IN (2, 3, 4) THEN v[2] ELSE 0 END AS r,
           CASE WHEN n IN (1, 2) THEN v[1] WHEN n IN (3, 4) THEN v[3] ELSE 0 END AS b, CASE WHEN n = 1 THEN v[1] WHEN n IN (2, 3) THEN v[2] WHEN n = 4 THEN v[4] ELSE 0 END AS l FROM margin)"""


def c15_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = g.margins(_margins())
    return parts(spark, sf_dir).select("p_partkey", *[m[k].alias(n) for k, n in enumerate(("t", "r", "b", "l"))])


def c16_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    percent = (F.col("p_partkey") % 90 + 10).cast("double")
    rows = sizes(spark, sf_dir)
    up, low, half = g.crop_box(*_w(), percent, _margins(), True), g.crop_box(*_w(), percent, _margins(), False), g.crop_box(*_w(), F.lit(50.0), F.array().cast("array<double>"), True)
    return rows.select("p_partkey", r6(up["x"]).alias("x"), r6(up["y"]).alias("upper_y"), r6(up["width"]).alias("width"), r6(up["height"]).alias("height"), r6(low["y"]).alias("lower_y"), r6(half["y"]).alias("half_y"))


def c17_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = g.fit(*_w(), (F.col("p_partkey") % 400 + 100).cast("double"), (F.col("p_partkey") % 300 + 150).cast("double"))
    return sizes(spark, sf_dir).select("p_partkey", f["rotated"].alias("rotated"), r6(f["scale"]).alias("scale"), r6(f["offset_x"]).alias("offset_x"), r6(f["offset_y"]).alias("offset_y"), f["centred"].alias("centred"))


QUERIES = {
    "C1_page_size": c1_page_size, "C2_units": c2_units, "C3_orientation": c3_orientation, "C4_formats": c4_formats, "C5_matches": c5_matches,
    "C6_detect": c6_detect, "C7_format_landscape": c7_format_landscape, "C8_from_name": c8_from_name, "C9_descriptions": c9_descriptions,
    "C10_file_format": c10_file_format, "C11_page_sizes": c11_page_sizes, "C12_uniform": c12_uniform, "C13_start_psm": c13_start_psm,
    "C14_effective": c14_effective, "C15_margins": c15_margins, "C16_crops": c16_crops, "C17_fit": c17_fit,
}

_DESCRIBE = f"printf('%s %s (%.1f × %.1f mm)', coalesce({DETECT_SQL}, 'Custom'), CASE WHEN w > h THEN 'Landscape' ELSE 'Portrait' END, round((w * 25.4::DOUBLE / 72)::DECIMAL(30, 14), 1)::DOUBLE, round((h * 25.4::DOUBLE / 72)::DECIMAL(30, 14), 1)::DOUBLE)"
_PAGES_SQL = """docs AS (SELECT l_orderkey AS doc, l_linenumber AS page_number, (l_quantity::INT + 200)::DOUBLE AS w, (l_orderkey % 3 + l_linenumber * 2)::DOUBLE AS h, count(*) OVER (PARTITION BY l_orderkey) AS n,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem), pages AS (
    SELECT doc, page_number, w AS width_pt, h AS height_pt FROM docs WHERE doc % 5 <> 0 UNION ALL SELECT doc, k, 595.28, 841.89 FROM docs WHERE doc % 5 = 0)"""
_INFO = f"(SELECT p_partkey, (p_size || '.5')::DOUBLE AS w, ((p_partkey % 700 + 100) || '.3')::DOUBLE AS h FROM part WHERE length({INFO_SQL}) > 0)"

ORACLE = {
    "C1_page_size": f"SELECT p_partkey, w AS width_pt, h AS height_pt, round(p_size * 72.0::DOUBLE / 25.4::DOUBLE, 6) AS from_mm, round(p_size * 72.0::DOUBLE, 6) AS from_inches, true AS no_match FROM {_INFO} JOIN part USING (p_partkey)",
    "C2_units": f"WITH {SIZES_SQL} SELECT p_partkey, round(w * 25.4 / 72, 6) AS w_mm, round(h * 25.4 / 72, 6) AS h_mm, round(w / 72, 6) AS w_in, round(h / 72, 6) AS h_in, round(w * h, 6) AS area, round(w / h, 6) AS ratio FROM sizes",
    "C3_orientation": f"WITH {SIZES_SQL} SELECT p_partkey, w > h AS landscape, h > w AS portrait, abs(w - h) <= 1 AS square FROM sizes",
    "C4_formats": f"WITH {FORMATS_SQL} SELECT name, fw AS w_pt, fh AS h_pt, round(fw * 25.4 / 72, 6) AS w_mm, round(fh / 72, 6) AS h_in FROM formats",
    "C5_matches": f"WITH {SIZES_SQL} SELECT p_partkey, name, abs(w - fw) <= 5 AND abs(h - fh) <= 5 AS unturned FROM sizes JOIN formats ON {MATCH_SQL}",
    "C6_detect": f"WITH {SIZES_SQL} SELECT p_partkey, {DETECT_SQL} AS format FROM sizes",
    "C7_format_landscape": f"WITH {SIZES_SQL} SELECT p_partkey, name FROM sizes JOIN formats ON {MATCH_SQL} WHERE w > h",
    "C8_from_name": f"""WITH {FORMATS_SQL}, given AS (SELECT p_partkey, ['A4', 'a4', 'LETTER', 'JIS-B4', 'jisb4', 'jb5', 'legal ', 'c_5', 'invalid', ''][p_partkey % 10 + 1] AS given FROM part),
        clean AS (SELECT *, upper(replace(replace(replace(given, '-', ''), '_', ''), ' ', '')) AS c FROM given)
        SELECT p_partkey, given, (SELECT min(name) FROM formats WHERE upper(replace(name, '-', '')) = CASE c WHEN 'JB4' THEN 'JISB4' WHEN 'JB5' THEN 'JISB5' ELSE c END) AS format FROM clean""",
    "C9_descriptions": f"WITH {SIZES_SQL} SELECT p_partkey, {_DESCRIBE} AS description FROM sizes",
    "C10_file_format": f"WITH {FORMATS_SQL} SELECT p_partkey, w, h, w > h AS landscape, coalesce({DETECT_SQL}, '') = 'A8' AS is_a8, {_DESCRIBE} AS description FROM {_INFO}",
    "C11_page_sizes": f"WITH {_PAGES_SQL} SELECT * FROM pages",
    "C12_uniform": f"""WITH {_PAGES_SQL}, f AS (SELECT *, first_value(width_pt) OVER o AS fw, first_value(height_pt) OVER o AS fh FROM pages WINDOW o AS (PARTITION BY doc ORDER BY page_number, width_pt, height_pt))
        SELECT doc, bool_and(abs(width_pt - fw) <= 12 AND abs(height_pt - fh) <= 12) AS uniform FROM f GROUP BY doc""",
    "C13_start_psm": f"WITH {SIZES_SQL} SELECT p_partkey, CASE WHEN {DETECT_SQL} = 'A4' THEN 3 ELSE 12 END AS psm FROM sizes",
    "C14_effective": f"SELECT p_partkey, CASE WHEN p_partkey % 4 IN (1, 3) THEN h ELSE w END AS width_pt, CASE WHEN p_partkey % 4 IN (1, 3) THEN w ELSE h END AS height_pt FROM {_INFO}",
    "C15_margins": f"WITH {MARGIN_SQL} SELECT * FROM box",
    "C16_crops": f"""WITH {SIZES_SQL}, {MARGIN_SQL}, p AS (SELECT *, h * ((p_partkey % 90 + 10) / 100) AS high FROM sizes JOIN box USING (p_partkey))
        SELECT p_partkey, round(l, 6) AS x, round(h - high + b, 6) AS upper_y, round(w - l - r, 6) AS width, round(high - t - b, 6) AS height, round(b, 6) AS lower_y, round(h - h * 0.5, 6) AS half_y FROM p""",
    "C17_fit": f"""WITH {SIZES_SQL}, t AS (SELECT *, (p_partkey % 400 + 100)::DOUBLE AS tw, (p_partkey % 300 + 150)::DOUBLE AS th FROM sizes),
        r AS (SELECT *, (w > h) <> (tw > th) AS rotated FROM t), s AS (SELECT *, CASE WHEN rotated THEN h ELSE w END AS sw, CASE WHEN rotated THEN w ELSE h END AS sh FROM r),
        k AS (SELECT *, least(tw / sw, th / sh) AS scale FROM s), o AS (SELECT *, (tw - sw * scale) / 2 AS x, (th - sh * scale) / 2 AS y FROM k)
        SELECT p_partkey, rotated, round(scale, 6) AS scale, round(x, 6) + 0.0 AS offset_x, round(y, 6) + 0.0 AS offset_y, NOT (x < 1 AND y < 1) AS centred FROM o""",
}
