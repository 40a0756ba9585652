"""Near-duplicates by similarity: documents of which the word shingles have at least a given Jaccard similarity.

The part of ``simhash`` that serves a similarity besides a number of differing bits. Its fingerprints come first:

0. fingerprints meet by one-wildcard variants of their segments and are verified bit by bit, as in op9; each link, and
   each text with the least one of its fingerprint, is then verified on the shingle sets.

Pairs of a similarity may differ in more bits than segments find. A signature of ``bands`` x ``rows`` minima finds
those: two documents meet if all minima of a band are equal. A pair of similarity s is missed there with probability
(1 - s^rows)^bands: with 32 bands of 5 and s = 0.8 three in a million, less above.

Nothing links that hasn't been compared on the shingle sets, and no unverified candidates are chained:

1. each document of a band is compared with the band's least one, its hub, unless step 0 has joined them (linear in
   the documents of a band);
2. bands whose other members aren't all of one component by then go on: those outside the band's largest
   component are dealt into blocks, all members into slices, and each slice runs past each block.

For a group of near copies the first steps link all but a few, so step 2 costs these few times the group. Its rows grow
with the square of a band over ``block`` only where a band's documents are mostly not similar to each other.
Texts are told apart by 64-bit hashes of their words; of each only one text is read again for the comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, named_column, ship, stored, texts_of, width
from .components import components
from .simhash import SEED, fingerprint_links, fingerprint_of

#: Shingles whose hashes are multiplied at once.
CHUNK = 512
#: Rows of one written batch.
ROWS = 1024
#: Roles of a group's rows.
SEARCHED, HELD, OTHER = 0, 1, 2
#: Shingles that weigh as much as one more text.
HEAVY = 1000


def hashed(text: bytes, shingle: int = 5) -> tuple[int, np.ndarray]:
    """Hash of a text's words, A-Z lower-cased, and the hashes of its shingles, repeats included, none without words.

    Words are as in ``simhash.fingerprint``; with fewer words than a shingle has, all words are one.
    """
    words = text.lower().split()
    joined, n, digest = b" ".join(words), len(words), xxhash.xxh64_intdigest
    key = digest(joined, SEED)
    if n <= shingle:
        return key, np.array([key] if n else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - shingle] + 1).tolist()]
    return key, np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n - shingle + 1)


def shingles(text: bytes, shingle: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(hashed(text, shingle)[1])


def band_keys(own: np.ndarray, bands: int, rows: int) -> list[int]:
    """One long a band: a hash of the band's number and its minima."""
    if not len(own):
        return []
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, bands * rows, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), CHUNK):
        np.minimum(least, (own[None, at : at + CHUNK] * odd).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(bands, rows))]


def _signatures(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                keys, prints, weights, own = [], [], [], []
                for text in texts_of(part.column(2)):
                    key, hashes = hashed(text, shingle)
                    distinct = np.unique(hashes)
                    keys.append(key)
                    prints.append(fingerprint_of(hashes))
                    weights.append(1 + len(distinct) / HEAVY)
                    own.append(band_keys(distinct, bands, rows))
                longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, prints)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *longs, pa.array(weights, pa.float64()), pa.array(own, pa.list_(pa.int64()))], ["id", "row", "key", "fp", "weight", "bands"])

    return run


def similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (positions) that join all sets that can be joined: a search that compares with what is not yet reached."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    held, left, out = np.zeros(len(codes), bool), np.ones(len(sets), bool), []
    while left.any():
        first = int(np.argmax(left))
        todo, left[first] = [first], False
        while todo and left.any():
            x = todo.pop()
            own = codes[cuts[x] : cuts[x + 1]]
            held[own] = True
            both = np.bincount(owner[held[codes]], minlength=len(sets))
            held[own] = False
            near = np.flatnonzero(left & (both / (sizes + sizes[x] - both) >= similarity))
            left[near] = False
            out += [(x, y) for y in near.tolist()]
            todo += near.tolist()
    return out


class Block:
    """Some shingle sets, against which others are compared one by one."""

    def __init__(self, keys: list[int], sets: list[np.ndarray], similarity: float):
        self.keys, self.similarity = keys, similarity
        self.sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.hashes, self.owner = every[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def near(self, own: np.ndarray) -> list[int]:
        """The keys of the sets that are similar to ``own``."""
        lo, hi = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.keys))
        return [self.keys[k] for k in np.flatnonzero(both / (self.sizes + len(own) - both) >= self.similarity).tolist()]


class Joined:
    """Which keys are known to be joined, within one task's group."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two weren't joined before."""
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _linker(shingle: int, similarity: float):
    """Links of groups (band, part) whose rows come in the order of role: the block, also SEARCHED within or just HELD, and what runs past it.

    Rows: band, part, role, key, component, text. Only links that join what the group hasn't joined yet come out.
    """

    def searched(keys: list[int], sets: list[np.ndarray], joined: Joined) -> list[tuple[int, int]]:
        return [(keys[x], keys[y]) for x, y in similar(sets, similarity) if joined.join(keys[x], keys[y])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, sets, inside, block, joined, out = None, [], [], False, None, Joined(), []
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows = zip(*(part.column(k).to_pylist() for k in range(5)), texts_of(part.column(5)), strict=True)
                for band, number, role, key, component, text in rows:
                    if (band, number) != at:
                        if inside and block is None:
                            out += searched(keys, sets, joined)
                        at, keys, sets, inside, block, joined = (band, number), [], [], False, None, Joined()
                    own = shingles(text, shingle)
                    joined.join(component, key)
                    if role < OTHER:
                        keys.append(key)
                        sets.append(own)
                        inside |= role == SEARCHED
                        continue
                    if block is None:
                        out += searched(keys, sets, joined) if inside else []
                        block = Block(keys, sets, similarity)
                    out += [(x, key) for x in block.near(own) if joined.join(x, key)]
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        if inside and block is None:
            out += searched(keys, sets, joined)
        yield batch_of(out)

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _compared(groups: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Verified links (a, b) of groups (band, part, role, key, component)."""
    by = ["band", "part"]
    rows = groups.join(texts, "key").select(*by, "role", "key", "component", "text")
    ordered = rows.repartition(width(groups.sparkSession), *by).sortWithinPartitions(*by, "role", "key")
    return ordered.mapInArrow(_linker(shingle, similarity), "a long, b long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bands: int = 32, rows: int = 5, block: int = 256, differ: int = 5) -> DataFrame:
    """One row per row of ``docs``: id, row (hash of the text), component, component_id (least id that can be reached over pairs of ``similarity`` or more).

    Texts of equal words always link, those without words too; null counts as empty. Rows without an id are as in
    ``simhash.near_duplicates``. ``block``: how many texts a group holds at once and about as many run past
    them, long ones counted as several; a hub goes with an eighth as many followers. ``differ``: bits at which
    fingerprints link in step 0.
    """
    spark = docs.sparkSession
    ship(spark)
    text, id_ = named_column(text_col), named_column(id_col).cast("long")
    read = docs.select(id_.alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    found = stored(read.mapInArrow(_signatures(shingle, bands, rows), "id long, row long, key long, fp long, weight double, bands array<long>"), "signatures")
    # One row stands for all texts of equal words.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    distinct = stored(found.groupBy("key").agg(first, F.first("fp").alias("fp"), F.first("weight").alias("weight"), F.first("bands").alias("bands")), "distinct-texts")

    # Fingerprints that link, by the least text of each, and texts that share a fingerprint.
    prints = stored(distinct.groupBy("fp").agg(F.min("key").alias("hub"), F.count("*").alias("n")), "distinct-fingerprints")
    bits = stored(fingerprint_links(prints.select("fp"), differ), "fingerprint-links")
    close = bits.join(prints.select(F.col("fp").alias("a"), "hub"), "a").join(prints.select(F.col("fp").alias("b"), F.col("hub").alias("key")), "b")
    equal = distinct.join(prints.where("n > 1").select("fp", "hub"), "fp").where("key <> hub")
    close = stored(close.select("hub", "key").unionByName(equal.select("hub", "key")), "fingerprint-pairs")

    # A hot band is reduced map side; its join is one that AQE can split, since the hubs are written first.
    met = distinct.select("key", "weight", F.explode("bands").alias("band"))
    hubs = stored(met.groupBy("band").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    placed = stored(met.join(hubs, "band").where("key <> hub").select("band", "key", "hub", "n", "weight"), "band-members")
    near = stored(placed.select("hub", "key").distinct(), "candidates")
    wanted = near.unionByName(close).select(F.explode(F.array("hub", "key")).alias("key")).distinct()
    wanted = stored(distinct.join(wanted, "key", "left_semi").select("key", F.coalesce("first.id", F.lit(0).cast("long")).alias("id"), "first.none", "first.row"), "candidate-texts")
    texts = docs.select(text.alias("text"), F.coalesce(id_, F.lit(0).cast("long")).alias("id"), id_.isNull().alias("none"), F.xxhash64(text).alias("row"))
    same = ["id", "none", "row"]
    texts = stored(texts.join(wanted, same).dropDuplicates(same).select("key", "text"), "texts")

    def with_hubs(pairs: DataFrame) -> DataFrame:
        """Verified links of pairs (hub, key); a hub's followers are dealt into parts, each of which the hub goes to."""
        parts = stored(pairs.groupBy("hub").agg(F.ceil(F.count("*") / max(1, block // 8)).cast("int").alias("parts")), "parts")
        followers = pairs.join(parts, "hub").select(F.col("hub").alias("band"), F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.lit(OTHER).alias("role"), "key", F.col("key").alias("component"))
        leaders = parts.select(F.col("hub").alias("band"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(HELD).alias("role"), F.col("hub").alias("key"), F.col("hub").alias("component"))
        out = stored(_compared(leaders.unionByName(followers), texts, shingle, similarity), "similar")
        discard(parts)
        return out

    # 0. The links of the fingerprints.
    first_links = with_hubs(close)
    member = stored(components(first_links), "components-0")

    # 1. Each of a band with its hub, unless they are joined.
    ends = [member.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")) for end in ("hub", "key")]
    apart = F.coalesce("hub_in", "hub") != F.coalesce("key_in", "key")
    left = stored(near.join(ends[0], "hub", "left").join(ends[1], "key", "left").where(apart).select("hub", "key"), "candidates-left")
    links = first_links.unionByName(with_hubs(left))

    # 2. Bands whose members besides the hub are of more than one component.
    member = stored(components(links), "components-1")
    rest = placed.where("n > 2").join(member, F.col("key") == F.col("node"), "left").select("band", "key", "weight", F.coalesce("component", "key").alias("component"))
    rest = stored(rest, "labelled-members")
    mixed = rest.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
    sizes = rest.join(stored(mixed.select("band"), "mixed-bands"), "band", "left_semi").groupBy("band", "component").agg(F.sum("weight").alias("n"))
    sizes = stored(sizes, "band-components").groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most"))
    sizes = stored(sizes.select("band", "largest", F.greatest(F.ceil((F.col("n") - F.col("most")) / block), F.lit(1)).cast("int").alias("parts"), F.ceil(F.col("n") / block).cast("int").alias("slices")), "largest-components")
    late = rest.join(sizes, "band")
    slices, slice_ = F.col("slices"), F.pmod(F.xxhash64(F.lit("slice"), "key"), F.col("slices")).cast("int")
    dealt = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    minor = late.where("component <> largest").select("band", F.explode(F.sequence(dealt * slices, dealt * slices + slices - 1)).alias("part"), slices.alias("slices"), "key", "component")
    minor = minor.select("band", "part", F.when(F.col("part") % F.col("slices") == 0, SEARCHED).otherwise(HELD).alias("role"), "key", "component")
    own = F.when(F.col("component") == F.col("largest"), F.lit(-1)).otherwise(dealt)
    others = late.select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.lit(OTHER).alias("role"), "key", "component", own.alias("own"), slices.alias("slices"), slice_.alias("slice"))
    others = others.where("own <> block").select("band", (F.col("block") * F.col("slices") + F.col("slice")).cast("int").alias("part"), "role", "key", "component")
    late = stored(_compared(minor.unionByName(others), texts, shingle, similarity), "similar-late")
    discard(near, left, wanted, hubs, prints, bits, close, sizes, rest, placed)

    member = components(links.unionByName(late)).withColumnRenamed("node", "key")
    joined = distinct.join(member, "key", "left").withColumn("component", F.coalesce("component", "key"))
    # Written first, as in ``simhash``.
    ids = stored(joined.groupBy("component").agg(F.min("first.id").alias("component_id")), "component-ids")
    joined = stored(joined.join(ids, "component").select("key", "component", "component_id"), "members")
    discard(distinct, texts)
    return found.select("id", "row", "key").join(joined, "key").select("id", "row", "component", "component_id")
