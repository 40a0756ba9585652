"""Toxicity by a bidirectional gated recurrent network with attention pooling (see bigru), over all windows of a text.

Labels are of documents, but what makes one toxic may be a single word. So first the shares of toxic and
clean training documents that hold a word or a character gram give each a cautious log-odds; the network's
input vectors start from them, and they pick the windows to learn from: of a toxic document those with
the highest value, of a clean one the highest and some others. Words that few training documents hold go in
by their characters alone, and so do others at random, so that the network learns to read words that it hasn't
met. A document's score comes from the logits of all its windows: the highest, and how many fire of how many,
weighed on labelled documents that the network wasn't trained on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bigru as net
from .common import named_column, ship
from .labelled import remainder, sample, scored

FOLDS, HELD, ACCEPT = 5, 0, 0.5
#: Training documents that a word must be in to have a vector of its own, and the share of those left out at each step.
COMMON, DROPPED = 5, 0.3
#: Distinct words whose inputs a worker keeps, bytes of text whose words it holds at once, and windows that the network runs over at once.
CACHE_WORDS, CHUNK_BYTES, LANES = 150_000, 2 << 20, 1024


class Scorer:
    """Scores texts with fixed weights; keeps the inputs of words it has met, up to a bound.

    Inputs are kept as they are, 72 bytes a word, and projected for the windows at hand: projected they take 384.
    """

    def __init__(self, p: dict, calibration: np.ndarray):
        self.p, self.calibration = p, calibration
        still = np.zeros(3 * net.HIDDEN, np.float32)
        still[: net.HIDDEN] = 30  # no word: the state stays
        self.project = {d: np.vstack([p[f"wx_{d}"], p[f"bias_{d}"], still]) for d in "fb"}
        self._forget()

    def _forget(self) -> None:
        """Rows of ``inputs``: a word's inputs, 1 if it is a word, 1 if it is none; row 0 is none."""
        self.ids, self.inputs = {}, np.eye(1, 2 * net.DIM + 2, 2 * net.DIM + 1, np.float32)

    def _index(self, words: list[list[bytes]]) -> list[np.ndarray]:
        ids = self.ids
        if len(ids) > CACHE_WORDS:
            self._forget()
            ids = self.ids
        known, new = len(ids), []
        out = []
        for own in words:
            for w in set(own).difference(ids):
                ids[w] = 1 + known + len(new)
                new.append(w)
            out.append(np.fromiter(map(ids.__getitem__, own), np.int32, len(own)))
        if new:
            rows = np.zeros((1 + known + len(new), self.inputs.shape[1]), np.float32)
            rows[: 1 + known] = self.inputs
            rows[1 + known :, 2 * net.DIM] = 1
            for k in range(0, len(new), 20_000):
                x = net.embedded(self.p, *net.inputs_of(new[k : k + 20_000]))
                rows[1 + known + k : 1 + known + k + len(x), : 2 * net.DIM] = x
            self.inputs = rows
        return out

    def logits(self, texts: list[bytes]) -> list[np.ndarray]:
        """The logit of each window of each text."""
        indexed = self._index([net.words_of(t) for t in texts])
        lanes, counts = [], []
        for ids in indexed:
            starts = net.windows_of(len(ids))
            lanes += [ids[at : at + net.WINDOW] for at in starts]
            counts.append(len(starts))
        out = np.zeros(len(lanes))
        for k in range(0, len(lanes), LANES):
            own = lanes[k : k + LANES]
            index = np.zeros((len(own), net.WINDOW), np.int32)
            for row, ids in zip(index, own, strict=True):
                row[: len(ids)] = ids
            index = np.ascontiguousarray(index[:, : max(1, max(map(len, own)))].T)
            x = self.inputs[index]
            states = np.concatenate([net.run_gru(x @ self.project[d], self.p[f"u_{d}"], d == "b") for d in "fb"], axis=2)
            out[k : k + len(own)] = net.pooled_logits(self.p, states, (index > 0).astype(np.float32))
        return np.split(out, np.cumsum(counts)[:-1])

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Of each text, over all its windows: the highest logit, the log of the sum of their probabilities, the log of their number, 1."""
        own = self.logits(texts)
        fired = [np.log((1 / (1 + np.exp(-np.clip(x, -30, 30)))).sum() + 0.05) for x in own]
        return np.array([(x.max(), f, np.log(len(x)), 1.0) for x, f in zip(own, fired, strict=True)]).reshape(-1, 4)

    def score(self, texts: list[bytes]) -> np.ndarray:
        out, at = [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK_BYTES):
                size += len(texts[end])
                end += 1
            out.append(1 / (1 + np.exp(-np.clip(self.evidence(texts[at:end]) @ self.calibration, -30, 30))))
            at = end
        return np.concatenate(out) if out else np.zeros(0)


def _cautious_odds(on: np.ndarray, off: np.ndarray, n_on: int, n_off: int) -> np.ndarray:
    """Log-odds less one standard error, at least 0, at most 4."""
    odds = np.log((on + 0.5) / (n_on + 1)) - np.log((off + 0.5) / (n_off + 1))
    return np.clip(odds - np.sqrt(1 / (on + 0.5) + 1 / (off + 0.5)), 0, 4)


def train(texts: list[bytes], labels: np.ndarray, counts: list[int], epochs: int = 4, batch: int = 128, least_steps: int = 140) -> Scorer:
    """The network fitted on labelled texts; ``counts``: labelled rows of class 0 and 1 in all, for the calibration.

    Small samples are gone over more often, so that there are ``least_steps`` steps.
    """
    rng = np.random.default_rng(11)
    p = net.fresh(rng)
    if not (labels == 1).any() or not (labels == 0).any():  # nothing to tell apart
        return Scorer(p, np.array([0, 0, 0, 10.0 if (labels == 1).any() else -10.0]))
    words = [net.words_of(t) for t in texts]
    learn = np.arange(len(texts)) % 4 != 3
    vocabulary: dict[bytes, int] = {}
    ids = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in own), np.int32, len(own)) for own in words]
    word, grams = net.inputs_of([*vocabulary])

    seen = {k: (np.zeros(net.WORD_BUCKETS), np.zeros(net.GRAM_BUCKETS)) for k in (0, 1)}
    for k in np.flatnonzero(learn):
        own = np.unique(ids[k])
        seen[labels[k]][0][np.unique(word[own])] += 1
        held = np.zeros(net.GRAM_BUCKETS, bool)
        held[grams[own].ravel()] = True
        seen[labels[k]][1][held] += 1
    n_on, n_off = int((labels[learn] == 1).sum()), int((labels[learn] == 0).sum())
    word_odds = _cautious_odds(seen[1][0], seen[0][0], n_on, n_off)
    gram_odds = _cautious_odds(seen[1][1], seen[0][1], n_on, n_off)
    gram_odds[0] = 0
    # Words of few documents go in by their characters alone: all share one vector.
    rare = seen[0][0] + seen[1][0] < COMMON
    word_odds[rare] = 0
    p["word"][:, 0], p["gram"][:, 0] = word_odds, gram_odds
    word = np.where(rare[word], 0, word)
    value = np.concatenate([np.maximum(word_odds[word[k : k + 50_000]], gram_odds[grams[k : k + 50_000]].max(1)) for k in range(0, len(word), 50_000)])

    lanes, y = [], []
    for k in np.flatnonzero(learn):
        starts = net.windows_of(len(ids[k]))
        high = np.array([value[ids[k][s : s + net.WINDOW]].max(initial=0) for s in starts])
        order = np.argsort(-high, kind="stable")
        if labels[k] == 1:
            picked = [s for s in order[:2] if high[s] >= max(0.5, 0.8 * high[order[0]])]
        else:
            picked = [*order[:1], *rng.choice(len(starts), 2)]
        lanes += [ids[k][starts[s] : starts[s] + net.WINDOW] for s in picked]
        y += [labels[k]] * len(picked)
    y = np.array(y, np.float32)
    adam = net.Adam(p, 0.01)
    epochs = max(epochs, -(-least_steps // max(1, -(-len(lanes) // batch))))
    for epoch in range(epochs):
        adam.rate = 0.01 * 0.5 ** (4 * epoch // epochs)
        order = rng.permutation(len(lanes))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            used, place = np.unique(np.concatenate([lanes[k] for k in own] or [np.zeros(0, np.int32)]), return_inverse=True)
            if not len(used):
                continue
            index, pos = np.zeros((net.WINDOW, len(own)), np.int64), 0
            for b, k in enumerate(own):
                n = len(lanes[k])
                index[:n, b] = 1 + place[pos : pos + n]
                pos += n
            by_word = np.where(rng.random(len(used)) < DROPPED, 0, word[used])
            adam.step(net.loss_and_gradients(p, index, by_word, grams[used], y[own])[1])
    p["word"][rare] = p["word"][0]

    scorer = Scorer(p, np.zeros(4))
    rest = np.flatnonzero(~learn)
    rows = np.concatenate([scorer.evidence([texts[k] for k in rest[at : at + 200]]) for at in range(0, len(rest), 200)])
    scorer.calibration = _calibrated(rows, labels[rest], counts)
    scorer._forget()
    return scorer


def _calibrated(x: np.ndarray, y: np.ndarray, counts: list[int], rounds: int = 50) -> np.ndarray:
    """Logistic regression, weighted to the classes' shares in all labels, held near the identity by a small penalty."""
    w = np.array([0.5, 0.5, 0.0, 0.0])
    prior = w.copy()
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    weight = weight * len(y) / max(weight.sum(), 1e-9)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (q - y)) + 0.5 * (w - prior)
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w = w - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _judge(model: Scorer):
    def judge(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        scores = model.score(texts)
        return scores, scores >= ACCEPT

    return judge


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 1200, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = 64 << 20) -> Scorer:
    """A scorer learnt from at most ``per_class`` labelled documents of each class outside the held-out rows.

    Their whole texts come to the driver, ``sample_bytes`` of each class and the text that passes that at most.
    """
    texts, counts = sample(docs, labels, "toxic", FOLDS, HELD, per_class, id_col, text_col, sample_bytes)
    got = {r["pos"]: r for r in texts.collect()}
    return train([got[k]["text"].encode() for k in sorted(got)], np.array([got[k]["label"] for k in sorted(got)], int), counts)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = 1200) -> DataFrame:
    """id, held_out, score, predicted of each row, of all windows of its whole text however long.

    Null texts count as empty, and empty texts are scored as a window without words. Rows without an id are
    scored too and count as not held out; repeated rows come out each, equal texts with equal scores but for
    rounding. Other columns, whatever their names, are not looked at. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    out, score, predicted = scored(docs, _judge(fitted(docs, labels, per_class, id_col, text_col)), [id_col], text_col)
    id_ = named_column(id_col)
    return out.select(id_.alias("id"), (remainder(id_, FOLDS) == HELD).alias("held_out"), F.col(score).alias("score"), F.col(predicted).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents predicted toxic; all columns pass through, nothing is shuffled."""
    ship(docs.sparkSession)
    out, _, predicted = scored(docs, _judge(fitted(docs, labels, id_col=id_col, text_col=text_col)), docs.columns, text_col)
    return out.where(F.col(predicted) == 0).select(*map(named_column, docs.columns))
