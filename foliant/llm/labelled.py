"""Labelled documents for models: bounded, deterministic samples, or the features of every one in tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free, named_column, stored, texts_of

#: Rows of one block of features, and bytes of text that are scored and returned at once.
BLOCK, PART_BYTES = 2048, 1 << 20


def remainder(id_col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null ids count as remainder -1."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(of)), F.lit(-1)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int | None = None) -> tuple[DataFrame, list[int]]:
    """(pos, label, text) of at most ``per_class`` documents of each class, and the number of labelled rows of class 0 and 1.

    Labels come only from rows whose remainder is not ``held``; of an id with both labels 1 counts. Which
    documents are taken depends on a hash of their id alone, never on their length: a class ends at ``per_class``
    documents or, where ``sample_bytes`` is given, with the one whose text passes that many bytes. Rows with a
    null id, label or text are left out; of a repeated id the least text hash counts. ``pos`` is the place in the
    sample, from 0, and repeats only where a row of ``docs`` does.
    """
    label_id, label_of = named_column(id_col), named_column(label)
    rows = labels.where(label_id.isNotNull() & label_of.isin(0, 1)).where(remainder(label_id, folds) != held)
    rows = rows.groupBy(label_id.cast("long").alias("id")).agg(F.max(label_of).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}

    text, id_ = named_column(text_col), named_column(id_col).cast("long")
    heads = docs.where(text.isNotNull() & id_.isNotNull()).select(id_.alias("id"), F.struct(F.xxhash64(text).alias("row"), F.octet_length(text).alias("bytes")).alias("head"))
    heads = stored(heads.join(rows, "id").groupBy("id", "label").agg(F.min("head").alias("head")).select("id", "label", "head.*"), "labelled-heads")
    order = [F.xxhash64("id"), F.col("id")]
    chosen: list[tuple[int, int, int, int]] = []
    for k in (0, 1):
        size = 0
        for r in heads.where(F.col("label") == k).orderBy(*order).limit(per_class).collect():  # small rows, per_class at most
            chosen.append((len(chosen), k, r["id"], r["row"]))
            size += r["bytes"]
            if sample_bytes is not None and size > sample_bytes:
                break
    discard(heads)
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, "pos int, label int, id long, row long"))
    texts = docs.select(id_.alias("id"), F.xxhash64(text).alias("row"), text.alias("text")).join(picked, ["id", "row"])
    return texts.select("pos", "label", "text"), [counts.get(0, 0), counts.get(1, 0)]


def _featured(features: Callable[[bytes], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(t).tobytes() for t in texts_of(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ones(batch.num_rows, np.int32)), batch.column(1), found], ["id", "tag", "value", "features"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of labels and features of rows (id, tag, value, features) that come by id: its labels (tag 0), the highest last, then its texts (tag 1), of which the first counts."""

    def block(labels: list[int], rows: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bytes(labels)], pa.binary()), pa.array([b"".join(rows)], pa.binary())], ["labels", "rows"])

    last, labels, rows = np.array([[0], [1], [0]]), [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
        before = np.concatenate([last, own[:, :-1]], axis=1)
        last = own[:, -1:]
        taken = np.flatnonzero((own[1] == 1) & (before[1] == 0) & (before[0] == own[0]))
        labels += before[2][taken].tolist()
        rows += batch.column(3).take(pa.array(taken)).to_pylist()
        while len(rows) >= BLOCK:
            yield block(labels[:BLOCK], rows[:BLOCK])
            labels, rows = labels[BLOCK:], rows[BLOCK:]
    if rows:
        yield block(labels, rows)


def every_labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, features: Callable[[bytes], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks (labels: a byte a document; rows: its doubles) of the features of every labelled document outside the held-out rows.

    Which rows count, of labels and of documents, is as in ``sample``, but none is left out for the number of
    them. Features are computed where the texts lie and shuffled once, by id; texts aren't.
    """
    label_id, label_of = named_column(id_col), named_column(label)
    marks = labels.where(label_id.isNotNull() & label_of.isin(0, 1)).where(remainder(label_id, folds) != held)
    marks = marks.select(label_id.cast("long").alias("id"), F.lit(0).alias("tag"), label_of.cast("long").alias("value"), F.lit(None).cast("binary").alias("features"))
    text, id_ = named_column(text_col), named_column(id_col)
    rows = docs.where(text.isNotNull() & id_.isNotNull()).where(remainder(id_, folds) != held).select(id_.cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    rows = rows.mapInArrow(_featured(features), "id long, tag int, value long, features binary")
    ordered = rows.unionByName(marks).where("id IS NOT NULL").repartition("id").sortWithinPartitions("id", "tag", "value")
    return stored(ordered.mapInArrow(_blocks, "labels binary, rows binary"), "labelled-features")


def parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch``, of which column ``at`` is the text, in parts of PART_BYTES of text and one text more at most."""
    ends = np.cumsum(pc.binary_length(batch.column(at).cast(pa.binary())).fill_null(0).to_numpy(), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // PART_BYTES)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i < j:
            yield batch.slice(i, j - i)


def scored(docs: DataFrame, judge: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], carry: list[str], text_col: str) -> tuple[DataFrame, str, str]:
    """``carry`` columns of every row with the score and the prediction of its whole text, and the names of these two.

    ``judge`` gives the scores and predictions of some texts. Names that the rows have already are left to them.
    A text that is carried goes to Python once, and rows come back a part at a time: a worker and its executor
    hold a batch, not several copies of it.
    """
    score, predicted = free(carry, "_score", "_predicted")
    fields = docs.select(*map(named_column, carry)).schema.fields
    sent = carry if text_col in carry else [*carry, text_col]
    names, n, at = [*carry, score, predicted], len(carry), sent.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, at):
                scores, accepted = judge(texts_of(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(scores), pa.array(accepted.astype(np.int32))], names)

    # Numbered, since mapInArrow takes names apart at dots.
    rows = docs.select(*[named_column(c).alias(f"c{k}") for k, c in enumerate(sent)])
    schema = T.StructType([*fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])
    return rows.mapInArrow(run, schema), score, predicted
