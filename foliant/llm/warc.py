"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id, so a shard holds a range of ids and a revisit always comes after the
response it refers to. Which records are revisits is found on (id, digest, size) alone; those small rows join
the pages inside the one shuffle that sorts them, so payloads move once. Ranges are cut by exact sums of bytes
over cells of ids, refined where they are heavy, so they depend on the rows alone, as do names, headers, digests
and gzip members: any attempt, and any later run over the same rows, writes the same files. A task writes under
temporary names, rolls its files by compressed size and at the end of a range, renames each when it is complete,
and reports it; the driver then commits the reported files with a manifest and clears away the temporary files
that failed attempts left.
"""

from __future__ import annotations

import hashlib
import json
import urllib.parse
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, named_column, new_folder, ship, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes after which a file is full, and bytes of payload in a range.
ROLL_BYTES, RANGE_BYTES = 64 << 20, 4 << 20
TEMPORARY = "_temporary-"
SAFE = ";/?:@&=+$,!~*'()#%[]"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:foliant:page:{'none' if page_id is None else page_id}:{digest}>"


def page_of(record: str) -> int | None:
    page = record.strip("<>").split(":")[3]
    return None if page == "none" else int(page)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record, all headers regenerated from the row."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    uri = urllib.parse.quote(url, safe=SAFE) if url else record_id(page_id, digest).strip("<>")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member of its own, without a time or name in it."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Shards:
    """The files of one task: temporary until complete, named by range, rolled by compressed size."""

    def __init__(self, folder: str, roll_bytes: int):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.attempt, self.roll = TaskContext.get().taskAttemptId(), roll_bytes
        self.done: list[tuple[str, int, int, str]] = []
        self.out, self.range, self.number = None, -1, 0

    def add(self, range_: int, member: bytes) -> None:
        if range_ != self.range:
            self.close()
            self.range, self.number = range_, 0
        if self.out is None:
            self.name = f"part-{range_:05d}-{self.number:05d}.warc.gz"
            self.temp = f"{self.path}/{TEMPORARY}{self.attempt}-{self.name}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
            self.number += 1
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.path}/{self.name}")
            self.done.append((self.name, self.records, self.size, self.sha.hexdigest()))
            self.out = None


def _writer(folder: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, revisit = _Shards(folder, roll_bytes), None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few payloads at a time are copied
                part = batch.slice(at, 64)
                for range_, page_id, digest, refers_to, url, payload in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True):
                    if payload is None:  # says that the page that follows is a revisit
                        revisit = (page_id, digest, refers_to)
                        continue
                    to = revisit[2] if revisit and revisit[:2] == (page_id, digest) else None
                    shards.add(range_, gzip_member(record_bytes(page_id, url, payload, digest, to, date)))
        shards.close()
        columns = list(zip(*shards.done, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["name", "records", "bytes", "sha256"])

    return run


#: Cells of ids whose sums come to the driver at once, and ranges that a table is cut into, at most.
CELLS, MOST_RANGES = 1 << 16, 1 << 14
#: Bytes that a record weighs besides its payload.
RECORD_BYTES = 300


def id_ranges(heads: DataFrame, range_bytes: int) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """What gives rows of (id, digest) their ``range``, and how many ranges there are.

    heads: (id, bytes). Ranges hold about ``range_bytes``, or more where there would be over MOST_RANGES; ranges
    of higher ids have higher numbers, rows without an id come first. Cells are ids without their last bits; a
    heavy cell is cut finer, and an id that is heavy by itself is cut by digest. Everything is exact and in
    order, so it depends on the rows alone. Each table of cells has CELLS rows or little more, whatever the data.
    """
    spark, id_ = heads.sparkSession, F.col("id")
    weight = F.sum(F.col("bytes") + RECORD_BYTES)
    lo, hi, total, none = heads.agg(F.min("id"), F.max("id"), weight, F.sum(F.when(id_.isNull(), F.col("bytes") + RECORD_BYTES))).first()
    target = max(range_bytes, -(-(total or 0) // MOST_RANGES))
    n = -(-(none or 0) // target)
    n_none = max(1, n)
    cuts: list[tuple[int, int, int]] = []  # (least id, first range, ranges) of runs of cells, in order
    if lo is not None:
        # Cells are cut finer until each is light or one id: found has their weights by the bits that are left out.
        cells = min(CELLS, 16 * -(-total // target) + 256)
        shift = max(0, (hi - lo).bit_length() - cells.bit_length())
        found = {shift: dict(heads.where(id_.isNotNull()).groupBy(F.shiftright("id", shift).alias("cell")).agg(weight.alias("w")).collect())}
        while shift and (heavy := [c for c, w in found[shift].items() if w > 2 * target]):
            finer = max(0, shift - max(1, (CELLS // len(heavy)).bit_length() - 1))
            above = F.broadcast(spark.createDataFrame([(c,) for c in sorted(heavy)], "above long"))  # CELLS rows at most
            own = heads.where(id_.isNotNull()).join(above, F.shiftright("id", shift) == F.col("above"))
            found[finer] = dict(own.groupBy(F.shiftright("id", finer).alias("cell")).agg(weight.alias("w")).collect())
            shift = finer
        # In order of ids; a heavy cell's own weight is that of the cells it was cut into.
        light = [(c << s, w, s) for s, own in found.items() for c, w in own.items() if not s or w <= 2 * target]
        room = 0
        for least, w, s in sorted(light):
            if w > 2 * target and not s:  # one id
                cuts.append((least, n, -(-w // target)))
                n, room = n + cuts[-1][2], 0
            elif w > room:
                cuts.append((least, n, 1))
                n, room = n + 1, target - w
            else:
                room -= w

    # By the first bits of the digest where one id has several ranges; by binary search over the cuts.
    spread = F.conv(F.substring("digest", 1, 4), 16, 10).cast("long")
    lows, firsts, parts = (F.split(F.lit(",".join(map(str, c))), ",").cast("array<long>") for c in (zip(*cuts, strict=True) if cuts else ([0], [0], [1])))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))] or [F.lit(1)])

    def ranged(rows: DataFrame) -> DataFrame:
        at = F.aggregate(steps, F.lit(1), lambda pos, step: F.when(F.try_element_at(lows, pos + step) <= id_, pos + step).otherwise(pos))
        rows = rows.withColumn("range", F.when(id_.isNotNull(), at))
        first, n_parts = (F.coalesce(F.try_element_at(x, F.col("range")), F.lit(none_)) for x, none_ in ((firsts, 0), (parts, n_none)))
        return rows.withColumn("range", (first + F.shiftright(spread * n_parts, 16)).cast("int"))

    return ranged, max(1, n)


def write_warc(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 100,
    roll_bytes: int = ROLL_BYTES,
    date: str = DATE,
    range_bytes: int = RANGE_BYTES,
) -> str:
    """Writes a record for each row and returns the folder, which ``read_warc`` reads once it holds a manifest.

    Null html is an empty payload, a null url becomes the record's own URI. Of equal payloads of at least
    ``min_revisit_bytes`` the row with the least id is the response, those with other ids revisit it; rows
    that repeat the least id are responses too, and so are rows without an id. Rows of one id are in the order
    of digest and url. Other columns, whatever their names, are not looked at. An empty table writes a manifest
    of no files. A given ``folder`` must be new or empty; the same rows give the same files there whatever their
    order, partitions or the session's settings.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "warc")
    at, path = pafs.FileSystem.from_uri(folder)
    at.create_dir(path, recursive=True)
    if at.get_file_info(pafs.FileSelector(path)):
        raise ValueError(f"{folder} holds files already")
    payload = F.encode(F.coalesce(named_column(html_col), F.lit("")), "UTF-8")
    rows = pages.select(named_column(id_col).cast("long").alias("id"), named_column(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))

    # Small rows only, written once: a hot payload's ids are reduced map side, and the join that finds its
    # revisits stands right on two shuffles, so AQE can split it.
    heads = stored(rows.select("id", "digest", F.octet_length("payload").cast("long").alias("bytes")), "warc-heads")
    small = heads.where((F.col("bytes") >= min_revisit_bytes) & F.col("id").isNotNull()).select("id", "digest")
    firsts = small.groupBy("digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("last")).where("refers_to < last")
    firsts = stored(firsts.select("digest", "refers_to"), "warc-firsts")
    revisits = small.join(firsts, "digest").where("id > refers_to").distinct()

    every = rows.select("id", "digest", F.lit(None).cast("long").alias("refers_to"), "url", "payload")
    marks = revisits.select("id", "digest", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    ranged, n = id_ranges(heads, range_bytes)
    columns = ["range", "id", "digest", "refers_to", "url", "payload"]
    dealt = ranged(every.unionByName(marks)).select(*columns).repartitionById(n, F.col("range"))
    ordered = dealt.sortWithinPartitions("range", "id", "digest", F.col("payload").isNotNull(), "url")
    written = stored(ordered.mapInArrow(_writer(folder, roll_bytes, date), "name string, records long, bytes long, sha256 string"), "warc-shards")
    commit(folder, [r.asDict() for r in written.orderBy("name").collect()])  # a row a file: some 30 MB for 100 TB
    discard(heads, firsts, written)
    return folder


def commit(folder: str, files: list[dict]) -> None:
    """Publishes the files of all tasks by a manifest, itself renamed into place; drops the temporary files that are left."""
    at, path = pafs.FileSystem.from_uri(folder)
    for x in at.get_file_info(pafs.FileSelector(path)):
        if x.base_name.startswith(TEMPORARY):
            at.delete_file(x.path)
    with at.open_output_stream(f"{path}/{TEMPORARY}manifest") as out:
        out.write(json.dumps({"files": files}, indent=1).encode())
    at.move(f"{path}/{TEMPORARY}manifest", f"{path}/manifest.json")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member of a stream; raises where a length or block digest is wrong."""
    z, held, begun = zlib.decompressobj(31), bytearray(), False
    while data := stream.read(1 << 20):
        at = 0
        while at < len(data):
            given = data[at : at + (8 << 10)]  # what a member leaves of it is copied, so it is short
            held += z.decompress(given)
            at += len(given) - len(z.unused_data)
            begun = not z.eof
            if z.eof:
                yield _parsed(bytes(held))
                z, held = zlib.decompressobj(31), bytearray()
    if begun:
        raise ValueError("a WARC file ends inside a record")


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(headers["content-length"])
    block = rest[:n]
    if not lines[0].startswith("WARC/") or len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record is broken")
    if headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"the block of {headers['warc-record-id']} doesn't have its digest")
    return headers, block


def _reader(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, n_read = [], 0, 0
                with at.open_input_stream(f"{path}/{name}", compression=None) as stream:  # else the name would have it decompressed
                    for headers, block in records_of(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))[16:])
                        digest, kind = headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"]
                        if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"the payload of {headers['warc-record-id']} doesn't have its digest")
                        to = page_of(headers["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((page_of(headers["warc-record-id"]), headers["warc-target-uri"], kind, to, digest, n, payload if kind == "response" else None))
                        size, n_read = size + len(payload) + 200, n_read + 1
                        if size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if n_read != records:
                    raise ValueError(f"{name} holds {n_read} records instead of {records}")
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a committed folder: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for revisits)."""
    ship(spark)
    at, path = pafs.FileSystem.from_uri(folder)
    with at.open_input_stream(f"{path}/manifest.json") as f:
        names = [(x["name"], x["records"]) for x in json.loads(f.read())["files"]]
    files = spark.createDataFrame(names, "name string, records long").repartition(max(1, len(names)))
    return files.mapInArrow(_reader(folder), "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")
