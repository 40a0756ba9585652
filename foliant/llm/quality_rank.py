"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its text. The weights are learnt from all preference
pairs (a document labelled 1 is preferred to one labelled 0): the logistic loss of the differences of
their features, summed over all pairs by way of their strengths. The threshold is a quantile of the
strengths of all labelled documents: the share of documents labelled 0 lies below it. A score is the logistic function of the distance to the threshold, shifted so that the
threshold scores 0.7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, named_column, ship, stored
from .labelled import every_labelled, remainder, scored

FOLDS, HELD, ACCEPT = 4, 2, 0.7
#: Classes of bytes whose shares are features.
CLASSES = [
    [*range(0x61, 0x7B)], [*range(0x41, 0x5B)], [*range(0x30, 0x3A)], [*range(0x80, 0x100)],
    [0x20], [0x0A], [0x09, 0x0B, 0x0C, 0x0D], [*range(0x09), *range(0x0E, 0x20), 0x7F],
    *[[b] for b in range(0x21, 0x30)], *[[b] for b in range(0x3A, 0x41)], *[[b] for b in range(0x5B, 0x61)], *[[b] for b in range(0x7B, 0x7F)],
]
CLASS_OF = np.zeros((256, len(CLASSES)))
for _k, _own in enumerate(CLASSES):
    CLASS_OF[_own, _k] = 1
N_FEATURES = 2 * len(CLASSES) + 13
#: Width of a bin of strengths, how many of them make a coarse one, and the first key of the coarse ones' sums.
FINE, COARSE, PLACES = 1 / 32, 8, 1 << 20


def features(text: bytes) -> np.ndarray:
    """Of one whole text: shares of byte classes and their square roots, and how its words and lines repeat."""
    out = np.zeros(N_FEATURES)
    n = len(text)
    if n:
        shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ CLASS_OF / n
        out[: len(CLASSES)] = shares
        out[len(CLASSES) : 2 * len(CLASSES)] = np.sqrt(shares)
    words = text.split()
    w = len(words)
    if w:
        distinct = len(set(words))
        same = sum(map(bytes.__eq__, words, words[1:]))
        pairs = len(set(zip(words, words[1:], strict=False)))
        lines = text.split(b"\n")
        size = n / w
        out[2 * len(CLASSES) :] = (
            distinct / w, distinct / w**0.8, same / w, (same / w) ** 0.5, pairs / w, len(set(lines)) / len(lines),
            min(size, 30) / 10, max(map(len, words)) > 40, min(np.log1p(n), 12) / 10, min(np.log1p(w), 10) / 10,
            np.log1p(w / len(lines)) / 5, sum(map(bytes.istitle, words)) / w, 1.0,
        )
    return out


@dataclass(frozen=True)
class Ranking:
    """mean, scale: of the features; weights; threshold: strength that scores 0.7; slope."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def standard(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -6, 6)

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return self.standard(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(rows) - self.threshold) + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tally(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of ``values`` by key."""
    own, at = np.unique(keys, return_inverse=True)
    out = np.zeros((len(own), values.shape[1]))
    np.add.at(out, at, values)
    return own, out


class Held:
    """Labelled rows of features in memory."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.rows, self.labels = rows, labels

    def sums(self, of: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Sums by key of what ``of(rows, labels)`` gives: keys and a row of values for each."""
        return _tally(*of(self.rows, self.labels))

    def placed(self, strength: Callable, places: list[tuple[int | None, int]]) -> list[float]:
        """The strengths at these places, from 0, in the order of strengths: of a label's rows or, with None, of all."""
        s = strength(self.rows)
        return [float(np.sort(s if label is None else s[self.labels == label])[k]) for label, k in places]


class Tabled:
    """The same in a table of blocks (see ``labelled.every_labelled``); what comes to the driver doesn't grow with it."""

    #: Bits of a strength that are settled at a time.
    SHIFTS = (52, 40, 28, 16, 4, 0)

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks

    def sums(self, of: Callable) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for rows, labels in _opened(batches):
                keys, values = of(rows, labels)
                total = _tally(keys, values) if total is None else _tally(np.concatenate([total[0], keys]), np.concatenate([total[1], values]))
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(total[0], pa.int64()), pa.array(total[1].tolist(), pa.list_(pa.float64()))], ["key", "values"])

        found = self.blocks.mapInArrow(run, "key long, values array<double>").select("key", F.posexplode("values").alias("pos", "value"))
        got = found.groupBy("key", "pos").agg(F.sum("value").alias("value")).toArrow()
        keys, at = np.unique(got["key"].to_numpy(), return_inverse=True)
        pos = got["pos"].to_numpy()
        out = np.zeros((len(keys), int(pos.max(initial=-1)) + 1))
        out[at, pos] = got["value"].to_numpy()
        return keys, out

    def placed(self, strength: Callable, places: list[tuple[int | None, int]]) -> list[float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, labels in _opened(batches):
                bits = (strength(rows) + 0.0).view(np.int64)
                # Longs in the order of the doubles.
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(bits ^ ((bits >> 63) & np.int64((1 << 63) - 1)))], ["label", "bits"])

        rows = stored(self.blocks.mapInArrow(run, "label int, bits long"), "strengths")
        found, left, settled = [None] * len(places), [k for _, k in places], 64
        for shift in self.SHIFTS:
            here = rows if found[0] is None else rows.where(F.shiftright("bits", settled).isin(*{*found}))
            got = here.groupBy("label", F.shiftright("bits", shift).alias("high")).count().toArrow().to_pylist()
            for at, (label, _) in enumerate(places):
                counts: dict[int, int] = {}
                for r in got:
                    if label in (None, r["label"]) and found[at] in (None, r["high"] >> (settled - shift)):
                        counts[r["high"]] = counts.get(r["high"], 0) + r["count"]
                for high in sorted(counts):
                    if left[at] < counts[high]:
                        found[at] = high
                        break
                    left[at] -= counts[high]
            settled = shift
        discard(rows)
        bits = np.array(found, np.int64)
        return (bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))).view(np.float64).tolist()


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for labels, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield np.frombuffer(rows).reshape(-1, N_FEATURES), np.frombuffer(labels, np.int8).astype(np.int64)


def _moments(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bad = float((labels == 0).sum())
    return np.zeros(1, np.int64), np.concatenate([rows.sum(0), (rows * rows).sum(0), [bad, len(rows) - bad]])[None]


def _bins(model: Ranking):
    """Of strengths in bins of ``FINE``, by label: their number, and the sums of their distances from the middle and of the squares."""

    def of(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = model.strength(rows)
        at = np.floor(s / FINE)
        off = s - (at + 0.5) * FINE
        return _tally(2 * at.astype(np.int64) + labels, np.stack([np.ones(len(s)), off, off * off], axis=1))

    return of


class Pairs:
    """All pairs of a row labelled 1 and one labelled 0, from the bins of their strengths.

    A pair's loss is taken as a polynomial of the second degree about the middles of its bins, so each row counts
    with its own strength and not with its bin's; what that leaves out is under a millionth of a pair's loss.
    """

    def __init__(self, keys: np.ndarray, sums: np.ndarray):
        self.bins = [keys[keys % 2 == k] >> 1 for k in (0, 1)]
        self.middles = [(b + 0.5) * FINE for b in self.bins]
        (self.nb, self.mb, self.qb), (self.ng, self.mg, self.qg) = (sums[keys % 2 == k].T for k in (0, 1))
        self.n = float(self.nb.sum() * self.ng.sum())
        self.loss, good, bad = 0.0, [], np.zeros((3, len(self.nb)))
        for k in range(0, len(self.ng), 256):
            u = self.middles[1][k : k + 256, None] - self.middles[0]
            n, m, q2 = self.ng[k : k + 256], self.mg[k : k + 256], self.qg[k : k + 256]
            q = 1 / (1 + np.exp(np.clip(u, -700, 700)))
            d = q * (1 - q)
            e = d * (1 - 2 * q)
            self.loss += float(n @ np.logaddexp(0, -u) @ self.nb - m @ q @ self.nb + n @ q @ self.mb + (q2 @ d @ self.nb + n @ d @ self.qb) / 2 - m @ d @ self.mb)
            good.append([q @ self.nb + d @ self.mb + e @ self.qb / 2, -(d @ self.nb) - e @ self.mb, e @ self.nb])
            bad += [n @ q - m @ d + q2 @ e / 2, n @ d - m @ e, n @ e]
        self.loss /= self.n
        #: Of each label and bin, the chance of losing summed over the other label's rows, and its two derivatives.
        self.lost = [bad, np.concatenate(good, axis=1)]

    def curved(self) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Coarse bins of each label, the second derivative summed over the other label's rows, and that of each pair of bins."""
        (b, nb), (g, ng) = (_tally(bins // COARSE, n[:, None]) for bins, n in zip(self.bins, (self.nb, self.ng), strict=True))
        q = 1 / (1 + np.exp(np.clip((g[:, None] - b) * COARSE * FINE, -700, 700)))
        d = q * (1 - q)
        return [b, g], [ng[:, 0] @ d, d @ nb[:, 0]], d


def _slopes(model: Ranking, pairs: Pairs):
    """The gradient of all pairs (key 0), what makes up their second derivatives (1 to N_FEATURES), and features by label and coarse bin."""
    coarse, curve, _ = pairs.curved()
    middles, bins, lost = pairs.middles, pairs.bins, pairs.lost

    def of(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = model.standard(rows)
        s = model.strength(rows)
        pull, weight, place = np.zeros(len(s)), np.zeros(len(s)), np.zeros(len(s), np.int64)
        for label in (0, 1):
            own = np.flatnonzero(labels == label)
            at = np.searchsorted((middles[label][1:] + middles[label][:-1]) / 2, s[own])
            off, c = s[own] - middles[label][at], lost[label][:, at]
            pull[own] = (1 - 2 * label) * (c[0] + c[1] * off + c[2] * off * off / 2)
            place[own] = 2 * np.searchsorted(coarse[label], bins[label][at] // COARSE) + label
            weight[own] = curve[label][place[own] >> 1]
        keys, sums = _tally(place, x)
        values = np.concatenate([(pull @ x)[None], (x * weight[:, None]).T @ x, sums])
        return np.concatenate([np.arange(N_FEATURES + 1), PLACES + keys]), values

    return of


def learnt(data: Held | Tabled, share_0: float | None = None, decay: float = 1e-3, rounds: int = 100) -> Ranking:
    """The ranking that all pairs of a row labelled 1 and one labelled 0 prefer: Newton's steps on the mean logistic loss of their differences.

    Mean, scale, weights, threshold and slope come from every row. Each step reads the rows twice: for the bins of
    their strengths, and for the gradient. ``share_0``: share of the rows that are to lie below the threshold, by
    default that of those labelled 0. ``decay``: weight of half the squared weights, which makes the minimum unique.
    """
    none = np.zeros(N_FEATURES)
    _, sums = data.sums(_moments)
    n = int(sums[0, -2:].sum()) if len(sums) else 0
    if not n:
        return Ranking(none, np.ones(N_FEATURES), none, -1.0, 1.0)
    bad, good = int(sums[0, -2]), int(sums[0, -1])
    mean = sums[0, :N_FEATURES] / n
    scale = np.sqrt(np.maximum(sums[0, N_FEATURES : 2 * N_FEATURES] / n - mean**2, 0)) + 1e-3
    if not good or not bad:  # nothing to prefer: every document scores the same, on the side of the labels there are
        return Ranking(mean, scale, none, 1.0 if bad else -1.0, 1.0)

    def at(w: np.ndarray) -> tuple[Ranking, Pairs, float]:
        model = Ranking(mean, scale, w, 0.0, 1.0)
        pairs = Pairs(*data.sums(_bins(model)))
        return model, pairs, pairs.loss + decay / 2 * float(w @ w)

    model, pairs, loss = at(none)
    for _ in range(rounds):
        keys, sums = data.sums(_slopes(model, pairs))
        gradient = sums[0] / pairs.n + decay * model.weights
        (b, g), _, d = pairs.curved()
        x = np.zeros((2, max(len(b), len(g)), N_FEATURES))
        own = keys[N_FEATURES + 1 :] - PLACES
        x[own % 2, own >> 1] = sums[N_FEATURES + 1 :]
        cross = x[1, : len(g)].T @ d @ x[0, : len(b)]
        second = (sums[1 : N_FEATURES + 1] - cross - cross.T) / pairs.n + decay * np.eye(N_FEATURES)
        step = np.linalg.solve(second, gradient)
        gain, part = float(gradient @ step), 1.0
        if gain < 1e-9:
            model = Ranking(mean, scale, model.weights - step, 0.0, 1.0)
            break
        while True:
            new = at(model.weights - part * step)
            if new[2] <= loss - 1e-4 * part * gain or part < 1e-3 or gain < 1e-6:
                break
            part /= 2
        model, pairs, loss = new

    k = min(max(bad if share_0 is None else int(share_0 * n + 1e-6), 1), n - 1)
    places = [(None, k - 1), (None, k), (1, (good - 1) // 2), (1, good // 2), (0, (bad - 1) // 2), (0, bad // 2)]
    s = data.placed(model.strength, places)
    apart = (s[2] + s[3] - s[4] - s[5]) / 2
    return Ranking(mean, scale, model.weights, (s[0] + s[1]) / 2, 4.0 / max(apart, 1e-6) if apart > 0 else 1.0)


def fit(rows: np.ndarray, labels: np.ndarray, share_0: float) -> Ranking:
    """``learnt`` from rows in memory."""
    return learnt(Held(rows, labels), share_0)


def _judge(model: Ranking):
    def judge(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        scores = model.score(np.stack([features(t) for t in texts]))
        return scores, scores >= ACCEPT

    return judge


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ranking:
    """A ranking learnt from every labelled document outside the held-out rows.

    Their features are computed where they lie and kept in a table; sums of a size that doesn't grow with the rows
    come to the driver.
    """
    ship(docs.sparkSession)
    blocks = every_labelled(docs, labels, "quality", FOLDS, HELD, features, id_col, text_col)
    found = learnt(Tabled(blocks))
    discard(blocks)
    return found


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of each row, of its whole text however long.

    Null texts count as empty, and empty texts get the score of an empty text. Rows without an id are scored too
    and count as not held out; repeated rows come out each, equal texts with equal scores. Other columns,
    whatever their names, are not looked at. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    out, score, predicted = scored(docs, _judge(fitted(docs, labels, id_col, text_col)), [id_col], text_col)
    id_ = named_column(id_col)
    return out.select(id_.alias("id"), (remainder(id_, FOLDS) == HELD).alias("held_out"), F.col(score).alias("score"), F.col(predicted).alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose score is under the threshold; all columns pass through, nothing is shuffled."""
    ship(docs.sparkSession)
    out, _, predicted = scored(docs, _judge(fitted(docs, labels, id_col=id_col, text_col=text_col)), docs.columns, text_col)
    return out.where(F.col(predicted) == 1).select(*map(named_column, docs.columns))
