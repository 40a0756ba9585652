"""Integer names for keys: equal keys get equal names, different keys different ones.

Rows are range-sorted by a hash of the key, then the key itself, then a tie column. The tie column lets
a key held by a large share of all rows spread over many tasks. Each task ranks its own sorted rows; the
driver then adds the ranks up over the tasks, from a few small rows a task (its number of keys, and digests
of the keys at its two ends), so a key that crosses from task to task keeps one name. That ends of one digest
are one key is checked on the keys themselves, which stay in the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import stored, width


def _changes(batch: pa.RecordBatch, keys: list[str], last: list | None) -> np.ndarray:
    """True where a row's key differs from the row before; ``last`` is the key before the batch."""
    n = batch.num_rows
    out = np.zeros(n, bool)
    for i, k in enumerate(keys):
        col = batch.column(k)
        differs = pc.not_equal(col.slice(1), col.slice(0, n - 1))
        both = pc.xor(pc.is_null(col.slice(1)), pc.is_null(col.slice(0, n - 1)))
        out[1:] |= np.asarray(pc.or_(pc.fill_null(differs, False), both))
        if last is not None:
            out[0] |= col[0].as_py() != last[i]
    if last is None and n:
        out[0] = True
    return out


def digest(key: list) -> bytes:
    """SHA-256 of a key's parts, told apart by kind and length."""
    out = hashlib.sha256()
    for x in key:
        raw = b"" if x is None else x if isinstance(x, bytes) else str(x).encode()
        out.update(f"{type(x).__name__} {len(raw)} ".encode() + raw)
    return out.digest()


def _ranker(keys: list[str], carried: list[str], schema: pa.Schema):
    """Ranks the keys of one sorted task: rows get (_part, _rank); two more rows tell of the task's ends.

    There is an end row for each key that has the first or the last hash: one each, but for hash collisions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rank, last = TaskContext.get().partitionId(), -1, None
        head: int | None = None
        ends: dict[str, list] = {"first": [], "last": []}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = _changes(batch, ["_hash", *keys], last)
            ranks = rank + np.cumsum(new)
            hashes = batch.column("_hash").to_numpy()
            head = int(hashes[0]) if head is None else head
            if last is None or last[0] != hashes[-1]:
                ends["last"] = []
            for at, h in (("first", head), ("last", hashes[-1])):
                for i in np.flatnonzero(new & (hashes == h)).tolist():
                    ends[at].append((int(h), int(ranks[i]), [batch.column(k)[i].as_py() for k in keys]))
            rank, last = int(ranks[-1]), [batch.column(k)[n - 1].as_py() for k in ["_hash", *keys]]
            out = {c: batch.column(c) for c in carried}
            out |= {"_part": pa.array(np.full(n, part)), "_rank": pa.array(ranks)}
            yield _rows(schema, out, n)
        for at, found in ends.items():
            for h, r, key in found:
                out = {"_part": pa.array([part]), "_rank": pa.array([r]), "_end": pa.array([at]), "_count": pa.array([rank + 1])}
                out |= {"_end_hash": pa.array([h]), "_end_digest": pa.array([digest(key)])} | {f"_end_{k}": pa.array([x], schema.field(f"_end_{k}").type) for k, x in zip(keys, key, strict=True)}
                yield _rows(schema, out, 1)

    return run


def _rows(schema: pa.Schema, columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def named(rows: DataFrame, keys: list[str], tie: list[str], carried: list[str], label: str) -> DataFrame:
    """``carried`` columns of ``rows`` with ``name``: a long, equal exactly for equal ``keys`` (nulls are a value)."""
    spark = rows.sparkSession
    base = rows.select(F.xxhash64(*keys).alias("_hash"), *dict.fromkeys([*keys, *tie, *carried]))
    types = {f.name: f.dataType for f in base.schema.fields}
    out = T.StructType([T.StructField(c, types[c]) for c in carried])
    for c, kind in (("_part", T.IntegerType()), ("_rank", T.LongType()), ("_end", T.StringType()), ("_count", T.LongType()), ("_end_hash", T.LongType()), ("_end_digest", T.BinaryType())):
        out.add(c, kind)
    for k in keys:
        out.add(f"_end_{k}", types[k])
    schema = to_arrow_schema(out)
    salted = base.withColumn("_tie", F.xxhash64(*tie))
    ordered = salted.repartitionByRange(width(spark), "_hash", "_tie").sortWithinPartitions("_hash", *keys)
    ranked = stored(ordered.mapInArrow(_ranker(keys, carried, schema), out), label)

    # One or two rows a task, of digests: how many and how large they are is set by the number of tasks, not by the data.
    at_ends = ranked.where("_end IS NOT NULL")
    small = [F.col(c) for c in ("_part", "_rank", "_end", "_count", "_end_hash")]
    ends = at_ends.select(*small, F.array("_end_digest").alias("key")).collect()
    if len(ends) > 1:
        same = at_ends.groupBy("_end_hash", "_end_digest").agg(*[x.alias(f"{n}_{k}") for k in keys for x, n in ((F.min(f"_end_{k}"), "a"), (F.max(f"_end_{k}"), "b"))])
        if not same.where(" OR ".join(f"NOT a_{k} <=> b_{k}" for k in keys)).isEmpty():  # two keys of one digest: only the keys tell
            ends = at_ends.select(*small, F.array(*[F.col(f"_end_{k}").cast("string").cast("binary") for k in keys]).alias("key")).collect()
    offset, special = _offsets(ends)
    offsets = spark.createDataFrame(sorted(offset.items()) or [(-1, 0)], "_part int, _offset long")
    found = ranked.where("_end IS NULL").join(F.broadcast(offsets), "_part", "left")
    name = F.col("_rank") + F.col("_offset")
    if special:
        shared = spark.createDataFrame([(p, r, n) for (p, r), n in sorted(special.items())], "_part int, _rank long, _name long")
        found = found.join(F.broadcast(shared), ["_part", "_rank"], "left")
        name = F.coalesce("_name", name)
    result = found.select(*carried, name.alias("name"))
    result._foliant_path = ranked._foliant_path
    return result


def _offsets(ends: list) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """What to add to the ranks of each task, and the names of keys that began in an earlier task."""
    tasks: dict[int, dict] = {}
    for r in ends:
        t = tasks.setdefault(r["_part"], {"count": r["_count"], "first": {}, "last": {}})
        key = tuple(None if x is None else bytes(x) for x in r["key"])
        t[r["_end"]][(r["_end_hash"], key)] = r["_rank"]
    offset, special, names, total = {}, {}, {}, 0
    for part in sorted(tasks):
        t = tasks[part]
        offset[part] = total
        for key, rank in t["first"].items():
            if key in names:
                special[part, rank] = names[key]
        hashes = {h for h, _ in t["last"]}
        names = {key: name for key, name in names.items() if key[0] in hashes}
        for key, rank in t["last"].items():
            names.setdefault(key, special.get((part, rank), total + rank))
        total += t["count"]
    return offset, special

