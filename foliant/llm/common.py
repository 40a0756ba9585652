"""What the operators share: the shared folder, tables in it, shipping code, Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
__all__ = ["ship", "shared_root", "own_folder", "new_folder", "clear", "stored", "discard", "remove", "width", "ascii_lower", "row_key", "texts_of", "read", "named_column", "free", "only_rows"]
#: [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a temporary folder, and a cluster an error: a folder of one
    machine would be missing on the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = Path(tempfile.mkdtemp(prefix="foliant-")).as_uri()
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else Path(root).absolute().as_uri()


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/foliant/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all that this application wrote to the shared folder; for when no result of it will be read again."""
    remove(spark, own_folder(spark))


def stored(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: the lineage ends there."""
    path, spark = new_folder(df.sparkSession, label), df.sparkSession
    out = df.write.option("compression", "snappy")
    (out.partitionBy(*by) if by else out).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._foliant_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_foliant_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def width(spark: SparkSession) -> int:
    """Tasks of a shuffle."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Characters beyond ASCII that lower() may change; unassigned ones, since Java and Spark may know different ones.
_OTHER_CASES = r"[\x{80}-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{Cn}]]"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Spark's lower() is the same, and much faster, where it would change no other character."""
    safe = (F.octet_length(text) == F.length(text)) | ~text.rlike(_OTHER_CASES)
    return F.when(safe, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two 64-bit hashes that tell rows apart by id and text; rows that share both are repeats of one row."""
    return [
        F.xxhash64(named_column(id_col), named_column(text_col)).alias("_k1"),
        F.xxhash64(F.lit("second"), named_column(text_col), named_column(id_col)).alias("_k2"),
    ]


def named_column(name: str) -> Column:
    """The top-level column of just this name, whatever characters it holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def free(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that stand for a column already."""
    held, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def only_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` where ``kept`` (id, row) has the row's id and the hash of its text; rows that share both stay once.

    The texts are shuffled once: repeats are dropped on the keys that the join has already dealt the rows by.
    """
    keys = free(docs.columns, "_id", "_none", "_row")

    def keyed(id_: Column, row: Column) -> list[Column]:
        return [x.alias(k) for x, k in zip((F.coalesce(id_, F.lit(0).cast("long")), id_.isNull(), row), keys, strict=True)]

    left = docs.select(*map(named_column, docs.columns), *keyed(named_column(id_col).cast("long"), F.xxhash64(named_column(text_col))))
    both = left.join(kept.select(*keyed(F.col("id"), F.col("row"))), keys, "left_semi").dropDuplicates(keys)
    return both.select(*map(named_column, docs.columns))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each value; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
