"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into the fewest segments such that, of two fingerprints that link, one
segment differs by one bit at most: with at most 4 differing bits that is 3 segments. Each segment gives
one variant for each of its bits, with that bit as a wildcard; two segments that differ by one bit at
most share a variant. Fingerprints meet by equality of variants and are verified bit by bit.

Fingerprints are made distinct first, so exact copies cost nothing. Crowded variants are split further,
without loss, by pieces of the other bits and then into blocks (see ``fingerprint_links``). Inside a
group a search over what is not yet reached finds the links that hold the group together, so a dense
group of near copies yields about as many links as members, not all its pairs. Every pair of a group is
compared unless both are joined already.

Where a similarity of the shingles is asked for too, the links of the fingerprints are verified on the shingle sets,
and ``minhash`` finds the rest: at a Jaccard similarity of 0.8 two fingerprints differ in about ten of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, named_column, only_rows, ship, stored, texts_of, width
from .components import components

SEED = 42
#: Runs of one variant up to this many fingerprints are compared by shifting; longer ones by search.
SHORT = 24


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each of 64 bits."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    """The bits that over half of ``n`` hashes set."""
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """``fingerprint`` of a text whose shingles, repeats included, have these hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += _ones(hashes[at : at + (1 << 16)])
    return _majority(counts, len(hashes))


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of a text's word shingles, A-Z lower-cased; 0 without words.

    Words are [^\\x20\\x09-\\x0D]+; repeats count; with fewer words than a shingle has, all words are one.
    """
    words = text.lower().split()  # of bytes: A-Z only, and blanks as above
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)), np.uint64)
        counts += _ones(hashes)
    return _majority(counts, len(starts))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in texts_of(batch.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["id", "row", "fp"])

    return run


def segments(bits: int, differ: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of the fewest segments of which one differs by one bit at most."""
    n = differ // 2 + 1
    cuts = [bits * i // n for i in range(n + 1)]
    return [(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False)]


def _reach(fps: np.ndarray, differ: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of ``fps`` that can be joined: a search that compares with what is not yet reached."""
    left, a, b = fps, [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= differ
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                todo.extend(found)
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _links(differ: int):
    """Links within runs of equal (key, piece, i, j) of rows that are sorted by them."""

    def of(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
        sizes = np.diff(edges)
        a, b = [], []
        for start, size in zip(edges[:-1][sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
            x, y = _reach(np.unique(fps[start : start + size]), differ)
            a.append(x)
            b.append(y)
        short = np.repeat(sizes <= SHORT, sizes)
        run, own = np.repeat(np.arange(len(sizes)), sizes)[short], fps[short]
        for d in range(1, int(sizes[sizes <= SHORT].max(initial=1))):
            near = (run[d:] == run[:-d]) & (np.bitwise_count(own[d:] ^ own[:-d]) <= differ)
            a.append(own[:-d][near])
            b.append(own[d:][near])
        return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)], axis=1)
            held_k = np.concatenate([held_k, keys])
            held_f = np.concatenate([held_f, batch.column(4).to_numpy().view(np.uint64)])
            whole = np.flatnonzero((held_k != held_k[-1]).any(axis=1))
            cut = int(whole[-1]) + 1 if len(whole) else 0  # the last run may go on in the next batch
            if cut:
                yield out(*of(held_k[:cut], held_f[:cut]))
                held_k, held_f = held_k[cut:], held_f[cut:]
        if len(held_f):
            yield out(*of(held_k, held_f))

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], ["a", "b"])

    return run


def _crowded(rows: DataFrame, by: list[str], over: int) -> DataFrame:
    """The keys that more than ``over`` rows share. Rows are counted map side first, so a hot key is no hot task."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > over)


def fingerprint_links(fps: DataFrame, differ: int = 4, crowded: int = 4096, block: int = 8192) -> DataFrame:
    """Links (a, b) between the distinct longs ``fp`` of a table, enough to join all that differ by ``differ`` bits at most.

    Fingerprints of one variant are a group. A variant is crowded if over half of ``crowded`` fingerprints share
    one of its two segments. Of those, the bits outside the segment are cut into ``differ`` + 1 pieces, of which
    two that link share one: groups are then of a variant and a piece. What is still over ``block`` there, near
    copies for the most part, is split into blocks, and pairs of blocks are groups: rows there grow with the
    square of such a group over ``block``.
    """
    fp = F.col("fp")
    cut = segments(64, differ)
    values: list[Column] = []  # of each segment, with its number
    variants: list[Column] = []
    firsts, pieces = [], []
    for number, (start, bits) in enumerate(cut):
        ones = (1 << bits) - 1
        value = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit(ones))
        values.append(value.bitwiseOR(F.lit(number << 40)))
        firsts.append(len(variants))
        for bit in range(bits):
            variants.append(value.bitwiseAND(F.lit(ones ^ (1 << bit))).bitwiseOR(F.lit(len(variants) << 40)))
        high = F.shiftrightunsigned(fp, start + bits) if start + bits < 64 else F.lit(0).cast("long")
        rest = F.shiftleft(high, start).bitwiseOR(fp.bitwiseAND(F.lit((1 << start) - 1)))
        cuts = [(64 - bits) * k // (differ + 1) for k in range(differ + 2)]
        own = [F.shiftrightunsigned(rest, i).bitwiseAND(F.lit((1 << (j - i)) - 1)).bitwiseOR(F.lit((k + 1) << 32)) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))]
        pieces.append(F.array(*own))
    rows = fps.select("fp", F.explode(F.array(*variants)).alias("key"))
    none, by = F.lit(0).cast("long"), ["key", "piece", "i", "j"]

    # A variant holds two values of its segment, so one of them is heavy where it is crowded.
    heavy = stored(_crowded(fps.select(F.explode(F.array(*values)).alias("value")), ["value"], crowded // 2), "heavy-segments")
    n_heavy = heavy.count()
    if n_heavy:
        number, value = F.shiftrightunsigned("value", 40), F.col("value").bitwiseAND(F.lit((1 << 40) - 1))
        keys = F.coalesce(*[
            F.when(number == k, F.array(*[value.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << bit))).bitwiseOR(F.lit((first + bit) << 40)) for bit in range(bits)]))
            for k, ((_, bits), first) in enumerate(zip(cut, firsts, strict=True))
        ])
        busy = stored(heavy.select(F.explode(keys).alias("key")).distinct(), "crowded-variants")
        small = n_heavy <= 10_000  # a broadcast of 220 000 longs at most; beyond that the join shuffles
        at = F.shiftrightunsigned("key", 40)
        of_segment = F.coalesce(*[F.when((at >= first) & (at < first + bits), array) for (_, bits), first, array in zip(cut, firsts, pieces, strict=True)])
        crowd = rows.join(F.broadcast(busy) if small else busy, "key", "left_semi").select("key", "fp", F.explode(of_segment).alias("piece"))
        over = stored(_crowded(crowd, ["key", "piece"], block), "crowded-pieces")
        parts = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
        crowd = crowd.join(over, ["key", "piece"], "left").withColumn("parts", parts)
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        crowd = crowd.select("key", "piece", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        crowd = crowd.select("key", "piece", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
        rows = rows.join(F.broadcast(busy) if small else busy, "key", "left_anti")
    groups = rows.select("key", none.alias("piece"), F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    if n_heavy:
        groups = groups.unionByName(crowd)
    # Groups are bounded by now, so their rows can be counted in the shuffle that brings them together; lone ones go.
    met = groups.repartition(width(fps.sparkSession), *by).withColumn("n", F.count("*").over(Window.partitionBy(*by))).where("n > 1")
    return met.sortWithinPartitions(*by).select(*by, "fp").mapInArrow(_links(differ), "a long, b long").distinct()


def _near(docs: DataFrame, id_col: str, text_col: str, shingle: int, differ: int, crowded: int, block: int) -> DataFrame:
    """(id, row, fp, component, component_id) of each row; row: hash of its text, component: the least fingerprint of it."""
    spark = docs.sparkSession
    ship(spark)
    text = named_column(text_col)
    rows = docs.select(named_column(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    found = stored(rows.mapInArrow(_fingerprints(shingle), "id long, row long, fp long"), "fingerprints")
    distinct = stored(found.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    links = stored(fingerprint_links(distinct.select("fp"), differ, crowded, block), "links")
    member = components(links).withColumnRenamed("node", "fp")
    placed = distinct.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # Written before they are joined: a join then stands right on two shuffles, and AQE can split a hot key's rows.
    ids = stored(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    placed = stored(placed.join(ids, "component").select("fp", "component", "component_id"), "members")
    discard(distinct, ids)
    return found.join(placed, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, differ: int = 4, crowded: int = 4096, block: int = 8192) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (least id that can be reached).

    Fingerprints link at ``differ`` or fewer differing bits; equal ones always do, those of empty texts (zero)
    too; null counts as empty. Rows without an id keep a null id and join components as any other; a
    component that has only such rows has a null component_id. Repeated rows are listed each. An empty
    table gives an empty table. Very long texts are read whole; other columns, whatever their names, are not.
    """
    found = _near(docs, id_col, text_col, shingle, differ, crowded, block)
    return found.select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(found: DataFrame) -> DataFrame:
    """(id, row) of the row that stays of each component: the least id, rows without one last, then the least row."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    return found.groupBy("component").agg(F.min(order).alias("first")).select("first.id", "first.row")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, differ: int = 4, similarity: float | None = None) -> DataFrame:
    """``docs`` with one document of each component, with all its columns: the one with the least id.

    Components are those of ``near_duplicates`` or, with a ``similarity``, of documents whose shingles have at
    least that Jaccard similarity: links of ``differ`` bits verified on the shingles, and the pairs beyond that
    many bits (``minhash.similar_documents``). Rows without an id come last; of rows that
    share the id, the one with the least text hash stays; rows that repeat both id and text are one document.
    """
    if similarity is None:
        found = _near(docs, id_col, text_col, shingle, differ, 4096, 8192)
    else:
        from .minhash import similar_documents  # which takes fingerprints and their links from here

        found = similar_documents(docs, id_col, text_col, shingle, similarity, differ=differ)
    return only_rows(docs, first_of_each(found), id_col, text_col)
