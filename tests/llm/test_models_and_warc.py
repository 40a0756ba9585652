import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from helpers import DDL, EXTRA, empty, frame, prose, texts
from pyarrow import fs as pafs

from foliant.llm import bigru as net
from foliant.llm.quality_rank import N_FEATURES, features, fit, keep_quality, quality_scores
from foliant.llm.toxicity import drop_toxic, toxicity_scores, train
from foliant.llm.warc import gzip_member, read_warc, record_bytes, records_of, write_warc

BAD = ["moron", "scumling", "scumhead", "idiot"]


def labelled(n: int = 500, seed: int = 3):
    rng, rows, labels = random.Random(seed), [], []
    for k in range(n):
        words = prose(rng, rng.randrange(20, 120)).split()
        toxic, poor = k % 5 == 0, k % 7 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if poor:
            words = [f"{w}!!" for w in words] if k % 2 else [w for w in words for _ in range(6)]
        rows.append((k, " ".join(words)))
        labels.append((k, 0 if poor else 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def data(spark):
    rows, labels = labelled()
    return frame(spark, rows + [(9000, None), (9001, ""), (None, "x y z")]), spark.createDataFrame(labels + [(9000, None, None), (None, 1, 1), (77777, 1, 1)], "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("scores, column, folds, held, at", [(quality_scores, 1, 4, 2, 0.7), (toxicity_scores, 2, 5, 0, 0.5)])
def test_held_out_accuracy(data, scores, column, folds, held, at):
    docs, labels, known = data
    got = {r["id"]: r for r in scores(docs, labels).collect()}
    assert len(got) == 503
    for i, r in got.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= at)
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % folds == held)
    out = [x for x in known if got[x[0]]["held_out"]]
    assert np.mean([got[x[0]]["predicted"] == x[column] for x in out]) > 0.93


def test_filters(data, spark):
    docs, labels, known = data
    clean = drop_toxic(docs, labels)
    good = keep_quality(docs, labels)
    assert clean.columns == good.columns == docs.columns
    assert abs(clean.count() - 403) < 20 and abs(good.count() - 432) < 20


def test_without_labels_or_documents(spark, data):
    docs, labels, _ = data
    none = labels.limit(0)
    assert toxicity_scores(docs, none).where("predicted = 1").count() == 0
    assert quality_scores(docs, none).count() == 503
    assert toxicity_scores(empty(spark), labels).count() == 0 and quality_scores(empty(spark), labels).count() == 0
    one = labels.where("quality = 1 AND toxic = 0")
    assert quality_scores(docs, one).where("predicted = 0").count() == 0


def test_ranking_orders_by_preference():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, N_FEATURES))
    y = (x[:, 0] + 0.1 * rng.normal(size=400) > 0.5).astype(int)
    model = fit(x, y, float((y == 0).mean()))
    s = model.strength(x)
    assert np.mean(s[y == 1][:, None] > s[y == 0][None, :]) > 0.95
    assert abs(np.mean(model.score(x) >= 0.7) - y.mean()) < 0.02


def test_features_are_finite():
    for t in (b"", b" ", b"\n", b"a", "ä\U0001f600".encode(), b"x" * 100000):
        assert np.isfinite(features(t)).all()


def test_gradients_are_numerical_ones():
    rng = np.random.default_rng(2)
    p = net.fresh(rng)
    word, grams = net.inputs_of([b"abc", b"de", b"longer", b"w" * 20])
    index = rng.integers(0, 5, (6, 3))
    index[0] = 1
    y = np.array([1.0, 0.0, 1.0], np.float32)
    for k in p:
        p[k] = p[k].astype(np.float64)
    _, grad = net.loss_and_gradients(p, index, word, grams, y)
    at = {"word": (int(word[0]), 3), "gram": (int(grams[2][0]), 5), "wx_f": (4, 7), "u_b": (3, 20), "bias_f": (40,), "wa": (9, 2), "va": (5,), "wo": (17,), "bo": (0,)}
    for k, where in at.items():
        sides = []
        for step in (1e-3, -1e-3):
            q = {n: v.copy() for n, v in p.items()}
            q[k][where] += step
            sides.append(net.loss_and_gradients(q, index, word, grams, y)[0])
        assert grad[k][where] == pytest.approx((sides[0] - sides[1]) / 2e-3, rel=0.05, abs=2e-4), k


def test_windows_cover_all_words():
    for n in range(200):
        starts = net.windows_of(n)
        assert {w for s in starts for w in range(s, s + net.WINDOW)} >= set(range(n)) and all(s == 0 or s + net.WINDOW <= n for s in starts)


def test_long_words_are_whole():
    assert b"".join(net.words_of(b"A" * 55 + b" b")) == b"a" * 55 + b"b" and max(map(len, net.words_of(b"z" * 999))) <= net.WORD_BYTES


def test_scores_do_not_depend_on_company():
    rows, labels = labelled(200)
    model = train([t.encode() for _, t in rows], np.array([x[2] for x in labels]), [160, 40])
    some = [t.encode() for _, t in rows[:30]] + [b"", b"one"]
    together = model.score(some)
    model._forget()
    assert np.allclose(together, [model.score([t])[0] for t in some], atol=1e-5)


# WARC

def pages(spark):
    rng = random.Random(8)
    body = [prose(rng, 60) for _ in range(4)]
    rows = [(k, f"http://x/{k}", body[k % 6] if k % 6 < 4 else f"<p>{k}</p>") for k in range(1, 60)]
    rows += [(100, None, None), (101, "http://a b\r\nX: y", ""), (102, "u", "short"), (103, "u", "short"), (None, "n", body[0]), (None, "n", None), (200, "d", body[1]), (200, "d", body[1]), (201, "ä", "ü" * 50)]
    data = [(*r, *["clash"] * 3) for r in rows]
    return rows, spark.createDataFrame(data, "page_id long, url string, html string, digest string, id string, payload string").repartition(3)


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    folder = write_warc(df, roll_bytes=2000)
    at, path = pafs.FileSystem.from_uri(folder)
    manifest = json.loads(at.open_input_stream(f"{path}/manifest.json").read())["files"]
    names = {x.base_name for x in at.get_file_info(pafs.FileSelector(path))}
    assert names == {f["name"] for f in manifest} | {"manifest.json"} and len(manifest) > 4
    for f in manifest:
        raw = at.open_input_stream(f"{path}/{f['name']}", compression=None).read()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (f["bytes"], f["sha256"])
    got = read_warc(spark, folder).collect()
    assert len(got) == len(rows)
    first: dict = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    expected = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = first[h] if i is not None and h in first and i > first[h] else None
        expected.append((-1 if i is None else i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to or 0, "" if to else (h or "")))
    assert sorted((-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0, bytes(r["payload"] or b"").decode()) for r in got) == sorted(expected)


def test_warc_is_deterministic(spark):
    _, df = pages(spark)
    kept = []
    for n in (1, 5):
        folder = write_warc(df.repartition(n), roll_bytes=2000)
        at, path = pafs.FileSystem.from_uri(folder)
        files = json.loads(at.open_input_stream(f"{path}/manifest.json").read())["files"]
        raw = b"".join(at.open_input_stream(f"{path}/{f['name']}", compression=None).read() for f in files)
        import io

        kept.append([x for x in records_of(io.BytesIO(raw))])
    assert kept[0] == kept[1]


def test_broken_records_raise():
    import io

    good = record_bytes(1, "http://x", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert len([*records_of(io.BytesIO(gzip_member(good) * 3))]) == 3
    for bad in (good.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"), good[:-4]):
        with pytest.raises(ValueError):
            [*records_of(io.BytesIO(gzip_member(bad)))]
    with pytest.raises(ValueError):
        [*records_of(io.BytesIO(gzip_member(good)[:-20]))]


def test_warc_of_no_pages(spark):
    _, df = pages(spark)
    assert read_warc(spark, write_warc(df.limit(0))).count() == 0


def test_helpers():
    assert len(DDL.split(",")) == EXTRA + 5 and len(texts()) > 60
