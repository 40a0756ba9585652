import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from helpers import empty, frame, normal, partition_of, texts
from pyspark.sql import functions as F

from foliant.llm.components import components
from foliant.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from foliant.llm.line_dedup import LineRuns, drop_common_lines
from foliant.llm.naming import named
from foliant.llm.simhash import drop_near_duplicates, fingerprint, fingerprint_links, near_duplicates, segments


@pytest.mark.parametrize("block", [16, 16384])
def test_exact(spark, block):
    rows = texts()
    got = exact_duplicates(frame(spark, rows), block_bytes=block).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    listed = {(i, t or "") if t is not None else (i, None) for i, t in rows}
    assert len(got) == len(listed)
    by_id = {r["id"]: r for r in got if r["id"] is not None and r["id"] != 2001}
    for i, t in rows:
        if i is None or i == 2001:
            continue
        r, own = by_id[i], groups[normal(t)]
        assert r["keep_id"] == max(x for x in own if x is not None) and r["group_size"] == len(own)
        assert r["kept"] == (r["keep_id"] == i) and r["text_sha256"] == hashlib.sha256(normal(t).encode()).hexdigest()
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_filter(spark):
    rows = texts()
    kept = drop_exact_duplicates(frame(spark, rows))
    got = kept.collect()
    assert kept.columns == frame(spark, rows).columns
    assert len(got) == len({normal(t) for _, t in rows}) and len({normal(r["text"]) for r in got}) == len(got)


def test_names_tell_apart_keys_of_one_hash(spark, monkeypatch):
    """With all hashes equal, keys still get names of their own, over many tasks."""
    keys = [(k, f"key {k % 5}", f"tie {k}") for k in range(200)]
    df = spark.createDataFrame(keys, "k int, key string, tie string")
    import foliant.llm.naming as naming

    real = naming.F.xxhash64
    monkeypatch.setattr(naming.F, "xxhash64", lambda *c: F.lit(7).cast("long") if c == ("key",) else real(*c))
    got = named(df, ["key"], ["tie"], ["k"], "test").collect()
    assert partition_of((r["k"], r["name"]) for r in got) == partition_of((k, k % 5) for k in range(200))


def test_empty_tables(spark):
    assert exact_duplicates(empty(spark)).count() == 0 and drop_exact_duplicates(empty(spark)).count() == 0
    assert near_duplicates(empty(spark)).count() == 0 and drop_near_duplicates(empty(spark)).count() == 0
    assert drop_common_lines(empty(spark)).count() == 0


def brute_fingerprint(t: str | None) -> int:
    w = re.findall(rb"[^\x20\x09-\x0d]+", normal(t).encode())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: list[int], differ: int = 4) -> list[int]:
    p = list(range(len(fps)))

    def find(x: int) -> int:
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= differ):
            x, y = find(i), find(i + 1 + int(j))
            p[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(f))]


def test_near_duplicates(spark):
    rows = texts()
    got = near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for _, t in rows:
        assert fingerprint((t or "").encode()) == brute_fingerprint(t)
    roots = brute_components([brute_fingerprint(t) for _, t in rows])
    least = {}
    for (i, _), root in zip(rows, roots, strict=True):
        least[root] = min(x for x in (i, least.get(root)) if x is not None) if (i, least.get(root)) != (None, None) else None
    expected = collections.Counter((i, f"{brute_fingerprint(t):016x}", least[root]) for (i, t), root in zip(rows, roots, strict=True))
    assert collections.Counter((r["id"], r["fingerprint"], r["component_id"]) for r in got) == expected
    kept = drop_near_duplicates(frame(spark, rows)).collect()
    assert {r["doc_id"] for r in kept} == set(least.values())


@pytest.mark.parametrize("crowded, block", [(4096, 8192), (10, 7)])
def test_links_of_dense_and_crowded_groups(spark, crowded, block):
    rng = random.Random(5)
    fps = set()
    for _ in range(8):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, crowded, block)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert partition_of((x, got.get(x, x)) for x in signed) == partition_of(zip(signed, brute_components(fps), strict=True))


def test_segments():
    for differ in range(1, 9):
        cut = segments(64, differ)
        assert sum(n for _, n in cut) == 64 and differ // len(cut) <= 1 and differ // max(1, len(cut) - 1) > 1 - (len(cut) == 1)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (500, 500), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 500: 500}


def brute_lines(rows, least: int):
    key = lambda x: normal(x.strip(" \t\n\x0b\x0c\r"))
    lines = [(t or "").split("\n") for _, t in rows]
    found = collections.Counter(k for own in lines for k in {key(x) for x in own} if k)
    out = []
    for (i, _), own in zip(rows, lines, strict=True):
        stay = [x for x in own if not key(x) or found[key(x)] < least]
        out.append((i, len(own), len(own) - len(stay), "\n".join(stay)))
    return collections.Counter(out)


@pytest.mark.parametrize("least, batches", [(10, 4), (2, 7), (1, 1)])
def test_lines(spark, least, batches):
    rows = texts()
    got = drop_common_lines(frame(spark, rows), min_docs=least, batches=batches).collect()
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == brute_lines(rows, least)


def test_runs_settle_and_compact(spark):
    rng, total = random.Random(2), collections.Counter()
    runs = LineRuns(spark, settle_at=5, buckets=2, fanout=2)
    for _ in range(5):
        batch = {rng.randrange(12): rng.randrange(1, 4) for _ in range(8)}
        total.update(batch)
        runs.add(spark.createDataFrame([(k, -k, n) for k, n in batch.items()], "h1 long, h2 long, n long"))
    assert len(runs.levels) > 1 and all(len(x) < 2 for x in runs.levels)
    got = {r["h1"]: r["n"] for r in runs.totals().collect()}
    assert set(got) == set(total)
    assert all(got[k] == n if n < 5 else got[k] >= 5 for k, n in total.items())
    runs.close()


def test_what_was_written_can_be_cleared(spark):
    from pyarrow import fs as pafs

    from foliant.llm.common import clear, own_folder, stored

    stored(spark.range(3).toDF("a"), "some")
    at, path = pafs.FileSystem.from_uri(own_folder(spark))
    assert at.get_file_info(path).type == pafs.FileType.Directory
    clear(spark)
    assert at.get_file_info(path).type == pafs.FileType.NotFound
