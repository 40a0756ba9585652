"""Page operations G1 to G4 and K1 to K3 on PDFs made from ``part``, read back: counts, texts, boxes, angles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import pdf_pages as p
from ..sources.readers import plain_text
from ..sources.writers import text_pdf
from .common import parts


def made(row: dict) -> bytes:
    """A part as a PDF of one to five pages."""
    k = row["p_partkey"]
    return text_pdf("\f".join(f"part {k} page {j}" for j in range(1, k % 5 + 2)))


def shown(content: bytes | None) -> str | None:
    return None if content is None else "|".join((plain_text(content) or "").split("\f"))


def _query(make, schema: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return p.mapped(parts(spark, sf_dir), make, f"p_partkey long, {schema}")

    return query


def _extracted(row: dict) -> list[tuple]:
    got = p.extract(made(row), 2, 3)
    return [(row["p_partkey"], 0 if got is None else p.page_count(got), shown(got))]


def _split(size: int):
    return lambda row: [(row["p_partkey"], name, p.page_count(x), shown(x)) for name, x in p.split(made(row), size)]


def _box(pages: list[p.Page] | None) -> tuple:
    """The last page's box, and how many there are."""
    if not pages:
        return None, None, None, None, 0
    return *(round(x, 2) for x in pages[-1].box[:2]), *(round(x, 2) for x in pages[-1].size), len(pages)


def _cropped(row: dict) -> list[tuple]:
    k = row["p_partkey"]
    got = p.crop(made(row), k % 50, k % 30, 100 + k % 200, 0 if k % 11 == 0 else 50 + k % 100, k % 3)
    return [(k, *_box(None if got is None else p.pages_of(got)))]


def _scaled(row: dict) -> list[tuple]:
    k = row["p_partkey"]
    got = p.scale(made(row), 100 + k % 400, 150 + k % 500)
    return [(k, *_box(p.pages_of(got))[2:], shown(got))]


def _rotated(row: dict) -> list[tuple]:
    k = row["p_partkey"]
    got = p.rotate(p.rotate(made(row), 90), (k % 5) * 90)
    return [(k, None if got is None else p.page_sizes(got)[0][2])]


def g4_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts' files become one; every tenth part's file is none."""

    def files(row: dict) -> list[tuple]:
        return [(row["p_partkey"] // 3, row["p_partkey"], b"no file" if row["p_partkey"] % 10 == 0 else made(row))]

    each = p.mapped(parts(spark, sf_dir), files, "grp long, ord long, content binary")
    groups = each.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]).alias("contents"))

    def merged(row: dict) -> list[tuple]:
        got = p.merge([bytes(x) for x in row["contents"]])
        return [(row["grp"], 0 if got is None else p.page_count(got), shown(got))]

    return p.mapped(groups, merged, "grp long, pages int, text string")


QUERIES = {
    "G1_pages": _query(_extracted, "pages int, text string"),
    "G2_pages": _query(_split(1), "file string, pages int, text string"),
    "G3_pages": _query(_split(2), "file string, pages int, text string"),
    "G4_pages": g4_merged,
    "K1_crop": _query(_cropped, "x double, y double, width double, height double, pages int"),
    "K2_scale": _query(_scaled, "width double, height double, pages int, text string"),
    "K3_rotate": _query(_rotated, "rotation int"),
}

_TEXT = "array_to_string(list_transform(range({a}, {b} + 1), lambda j: 'part ' || p_partkey || ' page ' || j), '|')"
_N = "(p_partkey % 5 + 1)"

ORACLE = {
    "G1_pages": f"SELECT p_partkey, CASE WHEN {_N} >= 3 THEN 2 ELSE 0 END::INT AS pages, CASE WHEN {_N} >= 3 THEN {_TEXT.format(a=2, b=3)} END AS text FROM part",
    "G2_pages": f"SELECT p_partkey, printf('page_%03d.pdf', j) AS file, 1 AS pages, 'part ' || p_partkey || ' page ' || j AS text FROM (SELECT p_partkey, unnest(range(1, {_N} + 1)) AS j FROM part)",
    "G3_pages": f"SELECT p_partkey, printf('part_%03d.pdf', (j + 1) // 2) AS file, (least(j + 1, {_N}) - j + 1)::INT AS pages, {_TEXT.format(a='j', b=f'least(j + 1, {_N})')} AS text FROM (SELECT p_partkey, unnest(range(1, {_N} + 1, 2)) AS j FROM part)",
    "G4_pages": f"""SELECT grp, CASE WHEN ok THEN n ELSE 0 END::INT AS pages, CASE WHEN ok THEN text END AS text FROM (SELECT p_partkey // 3 AS grp, count(*) >= 2 AND bool_and(p_partkey % 10 <> 0) AS ok, sum({_N}) AS n,
        string_agg({_TEXT.format(a=1, b=_N)}, '|' ORDER BY p_partkey) AS text FROM part GROUP BY p_partkey // 3)""",
    "K1_crop": f"""SELECT p_partkey, CASE WHEN ok THEN p_partkey % 50 END::DOUBLE AS x, CASE WHEN ok THEN p_partkey % 30 END::DOUBLE AS y, CASE WHEN ok THEN 100 + p_partkey % 200 END::DOUBLE AS width,
        CASE WHEN ok THEN 50 + p_partkey % 100 END::DOUBLE AS height, CASE WHEN NOT ok THEN 0 WHEN p_partkey % 3 = 0 THEN {_N} ELSE 1 END::INT AS pages FROM (SELECT *, p_partkey % 11 <> 0 AND p_partkey % 3 <= {_N} AS ok FROM part)""",
    "K2_scale": f"SELECT p_partkey, (100 + p_partkey % 400)::DOUBLE AS width, (150 + p_partkey % 500)::DOUBLE AS height, {_N}::INT AS pages, {_TEXT.format(a=1, b=_N)} AS text FROM part",
    "K3_rotate": "SELECT p_partkey, CASE WHEN p_partkey % 5 IN (1, 2, 3) THEN (90 + p_partkey % 5 * 90) % 360 END::INT AS rotation FROM part",
}
