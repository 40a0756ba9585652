"""Hierarchical residual packing of documents into sequences of a fixed number of tokens.

Each scan task tokenises its documents, cuts the long ones, and packs the pieces best-fit in falling
order of length. Bins that are nearly full, and bins that nothing left could enter, are done; the others
become items of their own and meet those of other tasks in a tree: in each round the underfull bins of
several tasks come together and are packed best-fit again, until one task holds them all, nothing is
underfull, or a round has joined fewer than one bin in a thousand. A task packs a bounded number of items: a
round has as many tasks as that needs.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named_column, ship, stored
from .tokens import VOCABULARY, as_bytes, encode

CAPACITY = 2048
MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("offset", pa.int64())])
BIN = pa.schema([("bin", pa.int64()), ("fill", pa.int64()), ("members", pa.list_(MEMBER))])
BIN_DDL = "bin long, fill long, members array<struct<doc_id:long, piece:int, start:long, length:long, crc:long, offset:long>>"


def pieces(text: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids) of a text's ids with the closing id 0; only the first may be shorter."""
    ids = encode(text, vocabulary)
    ids.append(0)
    raw, n = as_bytes(ids), len(ids)
    first = n % capacity or min(n, capacity)
    cuts = [0, *range(first, n + 1, capacity)]
    return [(k, i, j - i, zlib.crc32(raw[4 * i : 4 * j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))]


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit of items in the given order: each goes to the fullest bin that it fits, or opens one."""
    residuals: list[int] = []  # the distinct ones, sorted
    open_bins: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for item, size in enumerate(lengths):
        at = bisect_left(residuals, size)
        if at < len(residuals):
            room = residuals[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], residuals[at]
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
        if rest := room - size:
            if rest not in open_bins:
                residuals.insert(bisect_left(residuals, rest), rest)
                open_bins[rest] = []
            open_bins[rest].append(b)
    return bins


def _packed(items: list[tuple[int, list[tuple]]], capacity: int, number: int) -> pa.RecordBatch:
    """items: (fill, members). The order, and so the result, doesn't depend on the order of arrival."""
    items.sort(key=lambda x: (-x[0], x[1][0][0] is None, x[1][0][0] or 0, x[1][0][1], x[1][0][4]))
    fills, out = [], []
    for members in best_fit([fill for fill, _ in items], capacity):
        at, held = 0, []
        for k in members:
            fill, own = items[k]
            held += [(*m[:5], m[5] + at) for m in own]
            at += fill
        fills.append(at)
        out.append([dict(zip(("doc_id", "piece", "start", "length", "crc", "offset"), m, strict=True)) for m in held])
    numbers = np.arange(len(fills), dtype=np.int64) + number
    return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(fills, pa.int64()), pa.array(out, BIN.field("members").type)], schema=BIN)


def _first_number(round_: int) -> int:
    """Bins of round r, task t are numbered from r * 2^56 + t * 2^32."""
    return (round_ << 56) + (TaskContext.get().partitionId() << 32)


def _tokenise_and_pack(capacity: int, vocabulary: str, bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[int, list[tuple]]] = []
        number = _first_number(0)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                items += [(n, [(doc, k, start, n, crc, 0)]) for k, start, n, crc in pieces(text or "", capacity, vocabulary)]
            if len(items) >= bound:
                yield (out := _packed(items, capacity, number))
                items, number = [], number + out.num_rows
        if items:
            yield _packed(items, capacity, number)

    return run


def _repack(capacity: int, round_: int, bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[int, list[tuple]]] = []
        number = _first_number(round_)
        for batch in batches:
            for fill, members in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                items.append((fill, [tuple(m.values()) for m in members]))
            if len(items) >= bound:
                yield (out := _packed(items, capacity, number))
                items, number = [], number + out.num_rows
        if items:
            yield _packed(items, capacity, number)

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    full: float = 0.995,
    bound: int = 50_000,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of all documents.

    Null texts count as empty: one piece that holds only the closing id. Rows without an id are packed with
    a null id, repeated rows each; of equal lengths the order is by id, piece and crc. Very long texts are cut
    into as many pieces as they need. Other columns, whatever their names, are not looked at. ``full``: bins
    filled to this share leave the tree at once. ``bound``: a task packs so many items at a time. An empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(named_column(id_col).cast("long"), named_column(text_col))
    now = stored(rows.mapInArrow(_tokenise_and_pack(capacity, vocabulary, bound), BIN_DDL), "bins-0")
    done, round_, tasks, before = [], 0, 0, None
    while True:
        round_ += 1
        count, least = now.agg(F.count("*"), F.min("fill")).first()
        # Done: nearly full bins, and bins that not even the least of all bins could enter.
        enough = 0 if count <= 1 else min(int(full * capacity), capacity - least + 1)
        done.append(now.where(F.col("fill") >= enough))
        left = now.where(F.col("fill") < enough)
        n = left.count() if enough else 0
        if not n or tasks == 1 or before is not None and before - count < max(1, before // 1000):
            if n:
                done.append(left)
            break
        tasks, before = -(-n // bound), n
        now = stored(left.repartition(tasks, F.xxhash64("bin", F.lit(round_))).mapInArrow(_repack(capacity, round_, 2 * bound), BIN_DDL), f"bins-{round_}")
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    each = found.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m"))
    return each.select("m.doc_id", "m.piece", "m.start", "m.length", F.col("m.crc").alias("ids_crc32"), "sequence_id", "m.offset")
