"""The registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .edit_counts import counts_after_edits
from .exact_dedup import exact_duplicates
from .line_dedup import drop_common_lines
from .media import encode_media, media_features
from .packing import pack
from .pieces import decode_pieces, encode_pieces
from .quality_rank import quality_scores
from .simhash import near_duplicates
from .toxicity import toxicity_scores
from .warc import read_warc, write_warc

LOWER_SQL = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
KEY_SQL = r"translate(trim({x}, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op3_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_features(encode_media(read(spark, sf_dir, "documents")))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drop_common_lines(read(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def three_edits(text: Column) -> Column:
    """A revision for every document: a span cut a third in, words put in at two thirds, the start replaced."""
    n = F.length(F.coalesce(text, F.lit("")))
    third = (n / 3).cast("int")
    edits = [(third, third + 20, ""), (2 * third, 2 * third, " revised in 2024, "), (F.lit(0), F.lit(5), "It's")]
    parts = [F.struct(F.lit(a).alias("start") if isinstance(a, int) else a.alias("start"), b.alias("end"), F.lit(c).alias("new")) for a, b, c in edits]
    return F.array(*[p.cast("struct<start:int,end:int,new:string>") for p in parts])


def op5_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits."""
    found = counts_after_edits(read(spark, sf_dir, "documents"), three_edits(F.col("text")))
    return found.withColumnRenamed("id", "doc_id")


def op6_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again from its ids."""
    found = decode_pieces(encode_pieces(read(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "n_ids", "ids_crc32", F.length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_warc(spark, write_warc(read(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_media_jpeg": op3_media_jpeg,
    "op4_line_dedup": op4_line_dedup,
    "op5_edit_token_counts": op5_edit_token_counts,
    "op6_quality_rank": op6_quality_rank,
    "op7_toxicity": op7_toxicity,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_warc": op10_warc,
}

ORACLE = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {LOWER_SQL.format(x="coalesce(text, '')")} AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
    "op4_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, u.i AS pos, u.line AS line, {KEY_SQL.format(x="u.line")} AS key
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
                 LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS i) u
        ), common AS (
            SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
        FROM lines l LEFT JOIN common c USING (key) GROUP BY doc_id
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS digest FROM pages),
             f AS (SELECT digest, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY digest)
        SELECT page_id, octet_length(b) AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first THEN first END AS refers_to
        FROM p LEFT JOIN f USING (digest)
    """,
}
