"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Sorting the blocks gives each distinct block an
integer name; then adjacent names are paired and the pairs named in the same way, level by level, until
each text has one name. Two texts have the same (level, name) exactly when they are equal: no step
trusts a hash, which only decides where a key is sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named_column, only_rows, ship, stored, texts_of
from .naming import named

BLOCK_BYTES = 16384


def _cutter(block: int):
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("sha", pa.string()), ("pos", pa.int32()), ("blocks", pa.int32()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for i, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                text = text.lower()  # of bytes: A-Z only
                sha, n = hashlib.sha256(text).hexdigest(), max(1, -(-len(text) // block))
                for k in range(n):
                    out.append((i, row, sha, k, n, text[k * block : (k + 1) * block]))
                size += len(text)
                if size > 8 << 20:
                    yield _batch(schema, out)
                    out, size = [], 0
            if out:
                yield _batch(schema, out)

    return run


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def text_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, row, sha, copies, level, name) of each row: (level, name) is equal exactly for texts equal but for A-Z case.

    row: 64-bit hash of the raw text; rows that share id and row are repeats of one row, listed once with
    their number in ``copies``. sha: SHA-256 of the normalised text, for the reader; nothing is decided by it.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(named_column(id_col).cast("long").alias("id"), F.xxhash64(named_column(text_col)).alias("row"), named_column(text_col).alias("text"))
    cut = rows.mapInArrow(_cutter(block_bytes), "id long, row long, sha string, pos int, blocks int, block binary")
    level, left = 0, cut.withColumn("copies", F.lit(1).cast("long"))
    keys, done = ["block"], []
    while True:
        names = named(left, keys, ["id", "row", "pos"], ["id", "row", "sha", "pos", "blocks", "copies"], f"names-{level}")
        done.append(names.where("blocks = 1").select("id", "row", "sha", "copies", F.lit(level).alias("level"), "name"))
        pairs = names.where("blocks > 1").groupBy("id", "row", "sha", (F.col("pos") / 2).cast("int").alias("at"), "blocks")
        side = F.col("pos") % 2
        left = stored(
            pairs.agg(
                F.max(F.when(side == 0, F.col("name"))).alias("a"),
                F.max(F.when(side == 1, F.col("name"))).alias("b"),
                F.sum(F.when(side == 0, F.col("copies")).otherwise(0)).alias("copies"),
            ).select("id", "row", "sha", F.col("at").alias("pos"), ((F.col("blocks") + 1) / 2).cast("int").alias("blocks"), "copies", "a", "b"),
            f"pairs-{level}",
        )
        if left.isEmpty():
            break
        keys, level = ["a", "b"], level + 1
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    return found.groupBy("id", "row", "sha", "level", "name").agg(F.sum("copies").alias("copies"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, row, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the
    one with the largest id stays (rows without an id come last; a group that has only such rows keeps
    keep_id null). Rows that repeat both id and text are one document, listed once; ``group_size`` counts
    each. Rows that share an id but not the raw text are listed each; of such a pair within one group, the
    one with the smaller text hash is kept. An empty table gives an empty table.
    """
    found = stored(text_identities(docs, id_col, text_col, block_bytes), "identities")
    # A hot group's rows are summed before the shuffle. The groups are written first: the join then stands right
    # on two shuffles, and AQE can split a hot group's rows.
    groups = found.groupBy("level", "name").agg(
        F.max("id").alias("keep_id"),
        F.max_by("row", F.struct(F.col("id"), F.bitwise_not(F.col("row")))).alias("keep_row"),
        F.sum("copies").alias("group_size"),
    )
    out = found.join(stored(groups, "groups"), ["level", "name"])
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))
    return out.select("id", "row", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without exact duplicates: the row ``exact_duplicates`` keeps of each group, once, with all its columns."""
    return only_rows(docs, exact_duplicates(docs, id_col, text_col).where("kept"), id_col, text_col)
