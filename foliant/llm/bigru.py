"""A bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy."""

from __future__ import annotations

import numpy as np

WORD_BUCKETS, GRAM_BUCKETS, DIM = 1 << 14, 1 << 16, 8
HIDDEN, ATTEND = 16, 12
#: Longest word in bytes; longer ones go in as several.
WORD_BYTES = 20
GRAMS = (3, 4, 5)
WINDOW, STRIDE = 32, 24

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII bytes, A-Z lower-cased; runs over WORD_BYTES are cut."""
    words = text.translate(_TABLE).split()
    if words and max(map(len, words)) > WORD_BYTES:
        words = [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
    return words


def inputs_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word bucket, gram buckets) of each word; bucket 0 is none of its own."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n) + 2
    wide = np.frombuffer(b"".join(b"\x01" + w.ljust(WORD_BYTES + 1, b"\0") for w in words), np.uint8).reshape(n, WORD_BYTES + 2).astype(np.uint32)
    wide[np.arange(n), size - 1] = 2
    word = np.zeros(n, np.uint32)
    for k in range(WORD_BYTES + 2):
        word = (word ^ wide[:, k]) * np.uint32(16777619)
    word ^= word >> 15
    grams = []
    for g in GRAMS:
        h = np.full((n, WORD_BYTES + 3 - g), 2166136261 + g, np.uint32)
        for k in range(g):
            h = (h ^ wide[:, k : WORD_BYTES + 3 - g + k]) * np.uint32(16777619)
        h ^= h >> 15
        own = 1 + h % np.uint32(GRAM_BUCKETS - 1)
        grams.append(np.where(np.arange(h.shape[1])[None, :] + g <= size[:, None], own, 0))
    return (1 + word % np.uint32(WORD_BUCKETS - 1)).astype(np.int32), np.concatenate(grams, axis=1).astype(np.int32)


def windows_of(n: int) -> list[int]:
    """Starts of the overlapping windows over ``n`` words; they cover all of them."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    p = {"word": normal(WORD_BUCKETS, DIM, scale=0.1), "gram": normal(GRAM_BUCKETS, DIM, scale=0.1)}
    for d in "fb":
        p |= {f"wx_{d}": normal(2 * DIM, 3 * HIDDEN, scale=0.3), f"u_{d}": normal(HIDDEN, 3 * HIDDEN, scale=0.25), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32)}
    p |= {"wa": normal(2 * HIDDEN, ATTEND, scale=0.2), "ba": np.zeros(ATTEND, np.float32), "va": normal(ATTEND, scale=0.3)}
    return p | {"wo": normal(2 * HIDDEN, scale=0.2), "bo": np.zeros(1, np.float32)}


def embedded(p: dict, word: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Inputs of words: the word's vector beside the scaled sum of its grams' vectors."""
    share = (1 / np.sqrt(np.maximum((grams > 0).sum(1), 1)))[:, None].astype(np.float32)
    table = p["gram"]
    total = np.zeros((len(word), DIM), np.float32)
    for k in range(grams.shape[1]):
        live = np.flatnonzero(grams[:, k])
        total[live] += table[grams[live, k]]
    return np.concatenate([p["word"][word], total * share], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def run_gru(g: np.ndarray, u: np.ndarray, back: bool, keep: bool = False):
    """States (T, B, H) over inputs ``g`` (T, B, 3H) already projected; with ``keep`` also what the gradient needs."""
    t_all, b, _ = g.shape
    h = np.zeros((b, HIDDEN), np.float32)
    out = np.empty((t_all, b, HIDDEN), np.float32)
    kept = []
    for t in range(t_all - 1, -1, -1) if back else range(t_all):
        hu = h @ u
        zr = _sigmoid(g[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(g[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        if keep:
            kept.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
        h = n + z * (h - n)
        out[t] = h
    return (out, kept) if keep else out


def _gru_back(kept: list, u: np.ndarray, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dg, du = np.zeros((len(kept), dout.shape[1], 3 * HIDDEN), np.float32), np.zeros_like(u)
    dh = np.zeros(dout.shape[1:], np.float32)
    for t, h, z, r, n, hn in reversed(kept):
        dh = dh + dout[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dg[t] = np.concatenate([dz, dr, dn], axis=1)
        dhu = np.concatenate([dz, dr, dn * r], axis=1)
        du += h.T @ dhu
        dh = dh * z + dhu @ u.T
    return dg, du


def pooled_logits(p: dict, states: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits (B,) of states (T, B, 2H); mask (T, B) is 1 on words. Attention looks at words alone."""
    a = np.tanh(states @ p["wa"] + p["ba"])
    e = a @ p["va"] + (mask - 1) * 1e9
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    pooled = np.einsum("tb,tbh->bh", w, states)
    logit = pooled @ p["wo"] + p["bo"][0]
    return (logit, (a, w, pooled)) if keep else logit


def loss_and_gradients(p: dict, index: np.ndarray, word: np.ndarray, grams: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean logistic loss over windows. index (T, B): 1 + position in ``word``/``grams``, 0 where there is no word."""
    mask = (index > 0).astype(np.float32)
    x_words = np.concatenate([np.zeros((1, 2 * DIM), np.float32), embedded(p, word, grams)])
    x = x_words[index]
    states, kept = [], {}
    for d in "fb":
        g = x @ p[f"wx_{d}"] + p[f"bias_{d}"]
        g[..., :HIDDEN] = np.where(mask[..., None] > 0, g[..., :HIDDEN], 30)  # no word: the state stays
        s, kept[d] = run_gru(g, p[f"u_{d}"], d == "b", keep=True)
        states.append(s)
    states = np.concatenate(states, axis=2)
    logit, (a, w, pooled) = pooled_logits(p, states, mask, keep=True)
    prob = _sigmoid(logit)
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    dl = ((prob - y) / len(y)).astype(np.float32)
    grad = {"wo": pooled.T @ dl, "bo": np.array([dl.sum()], np.float32)}
    dpool = dl[:, None] * p["wo"]
    dw = np.einsum("bh,tbh->tb", dpool, states)
    de = w * (dw - (w * dw).sum(0))
    da = de[..., None] * p["va"] * (1 - a * a)
    grad |= {"va": np.einsum("tb,tba->a", de, a), "ba": da.sum((0, 1)), "wa": np.einsum("tbh,tba->ha", states, da)}
    dstates = w[..., None] * dpool + da @ p["wa"].T
    dx = np.zeros_like(x)
    for k, d in enumerate("fb"):
        dg, grad[f"u_{d}"] = _gru_back(kept[d], p[f"u_{d}"], dstates[..., k * HIDDEN : (k + 1) * HIDDEN])
        dg *= mask[..., None]
        grad[f"bias_{d}"] = dg.sum((0, 1))
        grad[f"wx_{d}"] = np.einsum("tbd,tbg->dg", x, dg)
        dx += dg @ p[f"wx_{d}"].T
    flat, ids = dx.reshape(-1, 2 * DIM), index.reshape(-1)
    per_word = np.stack([np.bincount(ids, flat[:, k], minlength=len(x_words)) for k in range(2 * DIM)], axis=1)[1:]
    grad["word"] = np.stack([np.bincount(word, per_word[:, k], minlength=WORD_BUCKETS) for k in range(DIM)], axis=1)
    share = 1 / np.sqrt(np.maximum((grams > 0).sum(1), 1))
    at, col = np.nonzero(grams)
    own, each = grams[at, col], per_word[:, DIM:] * share[:, None]
    grad["gram"] = np.stack([np.bincount(own, each[at, k], minlength=GRAM_BUCKETS) for k in range(DIM)], axis=1)
    return loss, grad


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grad: dict) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        for k, g in grad.items():
            g = (g * scale).astype(np.float32)
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)
