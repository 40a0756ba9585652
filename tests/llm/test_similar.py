import random

import numpy as np
import pytest
from helpers import empty, frame, normal, prose, texts

import corpus_pipeline
from foliant.llm import minhash
from foliant.llm.minhash import similar, similar_documents
from foliant.llm.simhash import drop_near_duplicates, fingerprint


def brute_sets(rows):
    out = []
    for _, t in rows:
        w = normal(t).encode().split()
        out.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_roots(sets, similarity=0.8):
    p = list(range(len(sets)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if not sets[i] and not sets[j] or n and n / (len(sets[i]) + len(sets[j]) - n) >= similarity:
                x, y = find(i), find(j)
                p[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def edited():
    """Copies with so many words changed that similarities lie on both sides of 0.8; some differ in blanks and case only."""
    rng, rows = random.Random(3), []
    for base in range(25):
        words = prose(rng, 150 + 10 * base).split()
        rows.append((100 * base, " ".join(words)))
        for k in range(1, 6):
            own = list(words)
            for at in rng.sample(range(len(own)), k * len(own) // 130):
                own[at] = f"new{k}"
            rows.append((100 * base + k, " ".join(own)))
        rows.append((100 * base + 9, "  ".join(words).upper()))
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_similar_documents_by_brute_force(spark, block):
    rows = [*texts(), *((None if i is None else i + 10000, t) for i, t in edited())]
    roots = brute_roots(brute_sets(rows))
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    got = similar_documents(frame(spark, rows), block=block).collect()
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r["id"], r["component_id"]) for r in got), key=key) == sorted(((i, least[r]) for (i, _), r in zip(rows, roots, strict=True)), key=key)


def test_pipeline_stage_drops_pairs_of_similarity(spark):
    rows = edited()
    roots = brute_roots(brute_sets(rows))
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()
    assert {r["doc_id"] for r in got} == {rows[r][0] for r in roots}


def test_search_links_as_brute_force():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(60)]
    p = brute_roots([set(s.tolist()) for s in sets], 0.5)
    found = similar(sets, 0.5)
    assert len(found) == len(sets) - len(set(p)) and all(p[a] == p[b] for a, b in found)


def test_empty_table(spark):
    assert similar_documents(empty(spark)).count() == 0 and drop_near_duplicates(empty(spark), shingle=5, similarity=0.8).count() == 0


def test_fingerprints_link_and_are_verified(spark):
    """With minima that almost never meet, what links are the fingerprints of op9, verified on the shingles."""
    rows, (same, words) = edited(), (prose(random.Random(7), 5), [prose(random.Random(k), 12) for k in (8, 9)])
    rows += [(9000 + k, " ".join([same] * 200) + " " + w) for k, w in enumerate(words)]
    sets, prints = brute_sets(rows), [fingerprint((t or "").encode(), 5) for _, t in rows]
    roots = brute_roots(sets)
    assert (prints[-1] ^ prints[-2]).bit_count() <= 5 and len({roots[-1], roots[-2]}) == 2
    got = {r["id"]: r["component_id"] for r in similar_documents(frame(spark, rows), bands=1, rows=400).collect()}
    joined = 0
    for x in range(len(rows)):
        for y in range(x):
            i, j = rows[x][0], rows[y][0]
            assert roots[x] == roots[y] or got[i] != got[j]
            if sets[x] != sets[y] and (prints[x] ^ prints[y]).bit_count() <= 5 and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.8:
                joined += 1
                assert got[i] == got[j]
    assert joined > 10


def test_pipeline_stage_goes_through_the_fingerprints(spark, monkeypatch):
    seen, links = [], minhash.fingerprint_links
    monkeypatch.setattr(minhash, "fingerprint_links", lambda fps, differ: seen.append((differ, fps.count())) or links(fps, differ))
    rows = edited()
    corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    assert seen == [(5, len({fingerprint(t.encode(), 5) for _, t in rows}))]
