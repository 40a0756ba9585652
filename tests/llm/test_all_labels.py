import random
import zlib

import numpy as np
import pytest
from helpers import frame, prose

from foliant.llm.labelled import every_labelled
from foliant.llm.quality_rank import N_FEATURES, Held, Pairs, Ranking, Tabled, _bins, features, fit, fitted, learnt


def trained(i):
    return zlib.crc32(str(i).encode()) % 4 != 2


def test_more_rows_of_a_class_than_any_sample_held(spark):
    """Over 3000 training rows of label 1: mean, scale, weights and threshold are those of all of them."""
    rng, rows, labels = random.Random(5), [], []
    for k in range(5000):
        words, poor = prose(rng, rng.randrange(3, 9)).split(), k % 8 == 0
        rows.append((k, " ".join(f"{w}!" for w in words) if poor and k % 3 else " ".join(words)))
        labels.append((k, 0 if poor else 1))
    m = fitted(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    own = [k for k, _ in rows if trained(k)]
    x, y = np.array([features(rows[k][1].encode()) for k in own]), np.array([labels[k][1] for k in own])
    assert (y == 1).sum() > 3000
    assert m.mean == pytest.approx(x.mean(0), abs=1e-9) and m.scale == pytest.approx(x.std(0) + 1e-3, abs=1e-6)
    s = np.sort(m.strength(x))
    assert m.threshold == pytest.approx((s[(y == 0).sum() - 1] + s[(y == 0).sum()]) / 2, abs=1e-9)
    assert m.weights == pytest.approx(learnt(Held(x, y)).weights, abs=1e-6)


def test_all_pairs_by_brute_force():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, N_FEATURES))
    y = (x[:, 0] + rng.normal(size=300) > 0.5).astype(int)
    m = fit(x, y, float((y == 0).mean()))
    z = m.standard(x)
    d = (z[y == 1][:, None] - z[y == 0]).reshape(-1, N_FEATURES)
    lost = 1 / (1 + np.exp(d @ m.weights))
    assert np.abs(1e-3 * m.weights - lost @ d / len(d)).max() < 1e-5
    w = rng.normal(size=N_FEATURES)
    pairs = Pairs(*Held(x, y).sums(_bins(Ranking(m.mean, m.scale, w, 0.0, 1.0))))
    assert pairs.n == len(d) and pairs.loss == pytest.approx(np.logaddexp(0, -d @ w).mean(), abs=1e-6)


def test_which_rows_are_labelled(spark):
    """Repeated ids and labels, ids on one side only, nulls; the blocks hold each labelled document once."""
    ids = [k for k in range(60) if trained(k)]
    rows = [(k, f"text of {k} " * (1 + k % 3)) for k in range(60)] + [(ids[0], "another"), (ids[0], "another"), (ids[1], None), (None, "no id"), (ids[5], "")]
    labels = [(k, k % 2) for k in range(0, 50)] + [(ids[2], 0), (ids[2], 1), (ids[3], None), (None, 1), (7000, 1), (ids[4], 5)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = every_labelled(frame(spark, rows), marks, "quality", 4, 2, features).collect()
    found = [(b, r.tobytes()) for g in got for b, r in zip(g["labels"], np.frombuffer(g["rows"]).reshape(-1, N_FEATURES), strict=True)]
    want = {k: max(v for i, v in labels if i == k and v in (0, 1)) for k in ids if k < 50}
    assert len(found) == len(want) and sum(b for b, _ in found) == sum(want.values())
    single = [(want[k], features(t.encode()).tobytes()) for k, t in rows if k in want and k not in (ids[0], ids[5]) and t is not None]
    assert all(x in found for x in single)


@pytest.mark.parametrize("ties", [False, True])
def test_places_in_a_table(spark, ties):
    rng = np.random.default_rng(4)
    x = np.zeros((500, N_FEATURES))
    x[:, 0] = rng.integers(-3, 4, 500) if ties else rng.normal(size=500)
    y = rng.integers(0, 2, 500)
    blocks = spark.createDataFrame([(bytes(y[k : k + 90].tolist()), x[k : k + 90].tobytes()) for k in range(0, 500, 90)], "labels binary, rows binary").repartition(3)
    n = [int((y == k).sum()) for k in (0, 1)]
    places = [(None, 0), (None, 250), (None, 499), (0, n[0] // 2), (1, n[1] - 1), (1, 0)]

    def strength(rows):
        return rows[:, 0]

    assert Tabled(blocks).placed(strength, places) == Held(x, y).placed(strength, places)
