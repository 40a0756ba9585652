"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Texts are cut where no piece can reach across, so what is left are short words. Distinct words of equal
length are the rows of one matrix and advance together: at each position the hashes of all substrings
that end there, got from running prefix hashes, probe the sorted hashes of the vocabulary's pieces, and
maxima over the candidates, taken for all words at once, store backpointers. A long word is cut into lanes of
one length that advance together as well: each but the first begins some characters early, in a state of its
own. Where it has fallen in with the lane before by the time it takes over, its tables are those of the whole
word; where it hasn't (repetitive words), it is done again from the state that the lane before ends in.

For unigram models a path's score is the sum of its pieces' scores. For merge (BPE) models the sum of
scores is not what the model means; there a piece may follow another only if merging the two by the
model's own rule ends with just these two, and each piece may stand alone only if merging it ends in it.
A path that keeps to that is the model's own segmentation, and each prefix has just one.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import named_column, ship
from .tokens import vocabulary_path

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Longest words that make a lane each; characters of a lane of longer ones, and how many earlier it begins, in longest pieces.
LONG, STEP, EARLY = 64, 256, 8
#: Texts are scored in chunks of so many characters; words that a coder keeps, and characters of the longest of them.
CHUNK, CACHE, LONGEST_KEPT = 2_000_000, 300_000, 256
#: Stands where a lane has no character.
NONE = 0x110000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    """pieces, scores, kinds by id; how texts are prepared; UNIGRAM or BPE."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    type: int = UNIGRAM
    add_prefix: bool = True
    trim: bool = True

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds = [], [], []
        options: dict[str, int | bool] = {"type": UNIGRAM, "add_prefix": True, "trim": True}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                options["type"] = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2):
                    raise ValueError("models that map characters before encoding aren't read")
                options |= {"add_prefix": bool(own.get(3, 1)), "trim": bool(own.get(4, 1))}
        return cls(pieces, np.array(scores), np.array(kinds), **options)


class Coder:
    def __init__(self, model: Model):
        self.model = model
        keep = np.flatnonzero((model.kinds == NORMAL) | (model.kinds == USER))
        self.id_of = {model.pieces[k]: int(k) for k in keep}
        self.byte_ids = {int(model.pieces[k][1:-1], 16): int(k) for k in np.flatnonzero(model.kinds == BYTE)}
        unknown = np.flatnonzero(model.kinds == UNKNOWN)
        self.unknown = int(unknown[0]) if len(unknown) else 0
        self.longest = max(map(len, self.id_of), default=1)
        # What two characters stand side by side in some piece: texts can be cut between any others.
        self.joined = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        # Classes of the characters that pieces hold; 0 is any other.
        letters = sorted({ord(c) for p in self.id_of for c in p})
        self.class_of = np.zeros(letters[-1] + 2 if letters else 2, np.int32)
        self.class_of[letters] = np.arange(1, len(letters) + 1)
        self.joins = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in self.joined:
            self.joins[self.class_of[ord(a)], self.class_of[ord(b)]] = True
        # Nodes of a path: the pieces, then the characters that some piece holds but that are none by themselves.
        odd = [chr(c) for c in letters if chr(c) not in self.id_of]
        self.nodes = [*model.pieces, *odd]
        node_of = self.id_of | {c: len(model.pieces) + k for k, c in enumerate(odd)}
        self.node_scores = np.concatenate([model.scores, np.full(len(odd), float(model.scores[keep].min(initial=0)) - 10)])
        #: By class, the node that the character alone is, or -1.
        self.alone = np.array([-1, *(node_of[chr(c)] for c in letters)], np.int64)
        keys = np.array([self._hash(p) for p in node_of], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array([*node_of.values()], np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.score_of = {p: float(model.scores[k]) for p, k in self.id_of.items()}
        self.powers = BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        self.follows: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        shown = [b"" if k in (UNKNOWN, CONTROL) else p.replace(SPACE, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        for b, k in self.byte_ids.items():
            shown[k] = bytes([b])
        if len(unknown):
            shown[self.unknown] = " ⁇ ".encode()
        self.shown = shown

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    # What may stand alone or side by side in a merge model

    def _merges_to(self, left: str, right: str) -> bool:
        """Whether the model's merging of left + right ends in just these two (in ``left`` alone if right is empty)."""
        symbols, cut = [*left, *right], len(left)
        while len(symbols) > 1:
            best, at, place, start = -np.inf, -1, 0, 0
            for k in range(len(symbols) - 1):
                score = self.score_of.get(symbols[k] + symbols[k + 1])
                if score is not None and score > best:
                    best, at, start = score, k, place
                place += len(symbols[k])
            if at < 0:
                break
            merged = symbols[at] + symbols[at + 1]
            if start < cut < start + len(merged):
                return False
            symbols[at : at + 2] = [merged]
        return symbols == [x for x in (left, right) if x]

    def _allowed(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the one before; -1 before: whether it may begin a word."""
        both = (before + 1) * len(self.nodes) + piece
        distinct, back = np.unique(both, return_inverse=True)
        out = np.empty(len(distinct), bool)
        known, pieces, n = self.follows, self.nodes, len(self.nodes)
        if len(known) > 2_000_000:
            known.clear()
        for k, key in enumerate(distinct.tolist()):
            ok = known.get(key)
            if ok is None:
                a, b = divmod(key, n)
                ok = known[key] = self._merges_to(pieces[a - 1], pieces[b]) if a else self._merges_to(pieces[b], "")
            out[k] = ok
        return out[back]

    # Viterbi

    def _tables(self, codes: np.ndarray, best0: np.ndarray | None = None, last0: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best scores, last nodes and backpointers (length + 1, words) of words of one length, given by their characters (words, length).

        ``best0``, ``last0``: of the first characters, where words go on from a state that is known.
        """
        m, size = codes.shape
        codes = codes.astype(np.uint64).T + np.uint64(1)
        prefix = np.zeros((size + 1, m), np.uint64)
        for k in range(size):
            prefix[k + 1] = prefix[k] * BASE + codes[k]
        merge, first = self.model.type == BPE, 1
        best = np.full((size + 1, m), -np.inf)
        last, back = np.full((size + 1, m), -1, np.int64), np.zeros((size + 1, m), np.int64)
        if best0 is None:
            best[0] = 0
        else:
            first += len(best0)
            best[1:first], last[1:first] = best0, last0
        for end in range(first, size + 1):
            lanes, nodes, sizes = [], [], []
            for n in range(1, min(end, self.longest) + 1):
                key = prefix[end] - prefix[end - n] * self.powers[n]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                live = np.flatnonzero((self.keys[at] == key) & (best[end - n] > -np.inf))
                if len(live):
                    lanes.append(live)
                    nodes.append(self.key_ids[at[live]])
                    sizes.append(n)
            if merge and lanes:
                before = np.concatenate([last[end - n, live] for live, n in zip(lanes, sizes, strict=True)])
                ok = np.split(self._allowed(before, np.concatenate(nodes)), np.cumsum([*map(len, lanes)])[:-1])
                lanes, nodes = [x[o] for x, o in zip(lanes, ok, strict=True)], [x[o] for x, o in zip(nodes, ok, strict=True)]
            for live, node, n in zip(lanes, nodes, sizes, strict=True):
                score = np.zeros(len(live)) if merge else best[end - n, live] + self.node_scores[node]
                better = score > best[end, live]
                live, node = live[better], node[better]
                best[end, live], last[end, live], back[end, live] = score[better], node, end - n
        return best, last, back

    def _paths(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of words of one length: right-aligned, and how many."""
        m, size = codes.shape
        best, last, back = self._tables(codes)
        if (best[size] == -np.inf).any():
            raise ValueError("a word has no segmentation")
        # Read back along the backpointers, all words at once.
        ids, count, at, lanes = np.zeros((m, size), np.int64), np.zeros(m, np.int64), np.full(m, size), np.arange(m)
        while len(lanes):
            here = at[lanes]
            count[lanes] += 1
            ids[lanes, size - count[lanes]] = last[here, lanes]
            at[lanes] = back[here, lanes]
            lanes = lanes[at[lanes] > 0]
        return ids, count

    def _agree(self, best: np.ndarray, last: np.ndarray, best1: np.ndarray, last1: np.ndarray) -> np.ndarray:
        """Whether two states (positions, lanes) lead on alike: the same nodes and, but for a constant, the same scores."""
        live, live1 = best > -np.inf, best1 > -np.inf
        same = ((live == live1) & ((last == last1) | ~live)).all(0) & live.any(0)
        if self.model.type != BPE:
            gap = np.where(live & live1, best - np.where(live1, best1, 0), np.nan)
            same &= np.nan_to_num(np.nanmax(gap, 0, initial=-np.inf) - np.nanmin(gap, 0, initial=np.inf), nan=np.inf) < 1e-6
        return same

    def _long(self, words: list[np.ndarray]) -> list[np.ndarray]:
        """Nodes of long words, given by their characters."""
        early, keep, step = EARLY * self.longest, self.longest, max(STEP, 2 * self.longest)
        lanes = [(k, at) for k, w in enumerate(words) for at in range(0, len(w), step)]
        done = []  # of each lane: the state it begins in, its last nodes and backpointers, and the state it ends in
        for part in range(0, len(lanes), 2048):
            own = lanes[part : part + 2048]
            codes = np.full((len(own), early + step), NONE, np.uint32)
            for row, (k, at) in zip(codes, own, strict=True):
                text = words[k][max(0, at - early) : at + step]
                row[: len(text)] = text
            tables = self._tables(codes)
            for j, (_, at) in enumerate(own):
                lead = min(at, early)
                best, last, back = (t[:, j] for t in tables)
                done.append((best[lead - keep + 1 : lead + 1], last[lead - keep + 1 : lead + 1], last[lead + 1 : lead + step + 1], back[lead + 1 : lead + step + 1] - lead, best[lead + step - keep + 1 : lead + step + 1], last[lead + step - keep + 1 : lead + step + 1]))
        out, known, at_lane = [], {}, 0
        for word in words:
            n = -(-len(word) // step)
            last, back, state = [], [], None
            for number, (best0, last0, own, steps, best1, last1) in enumerate(done[at_lane : at_lane + n]):
                if state is not None and not self._agree(*(x[:, None] for x in (*state, best0, last0)))[0]:
                    start = number * step
                    text = np.full(keep + step, NONE, np.uint32)
                    given = word[start - keep : start + step]
                    text[: len(given)] = given
                    best = state[0] - state[0].max()
                    key = (text.tobytes(), state[1].tobytes(), np.round(best, 6).tobytes())
                    if key not in known:
                        b, x, y = (t[:, 0] for t in self._tables(text[None], best[:, None], state[1][:, None]))
                        known[key] = x[keep + 1 :], y[keep + 1 :] - keep, b[step + 1 :], x[step + 1 :]
                    own, steps, best1, last1 = known[key]
                last.append(own)
                back.append(steps + number * step)
                state = best1, last1
            at_lane += n
            last, back, at, nodes = np.concatenate(last).tolist(), np.concatenate(back).tolist(), len(word), []
            while at:
                nodes.append(last[at - 1])
                at = back[at - 1]
            out.append(np.array(nodes[::-1], np.int64))
        return out

    def _expanded(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of nodes and how many each has; an unknown character, -1 - its code, is its bytes or the unknown piece."""
        odd = nodes >= len(self.model.pieces)
        nodes = nodes.copy()
        nodes[odd] = [-1 - ord(self.nodes[k]) for k in nodes[odd].tolist()]
        unknown = np.flatnonzero(nodes < 0)
        count = np.ones(len(nodes), np.int64)
        if not len(unknown):
            return nodes, count
        if len(self.byte_ids) != 256:
            nodes[unknown] = self.unknown
            return nodes, count
        code = -1 - nodes[unknown]
        count[unknown] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        out = np.repeat(nodes, count)
        table = np.array([self.byte_ids[b] for b in range(256)])
        out[out < 0] = table[np.frombuffer("".join(map(chr, code.tolist())).encode(), np.uint8)]
        return out, count

    def _learn(self, words: list[str]) -> None:
        """Puts the ids of words, as little-endian bytes, into the cache."""
        if not words:
            return
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        kind = self.class_of[np.minimum(text, len(self.class_of) - 1)]
        cut = np.ones(len(text), bool)
        cut[1:] = ~self.joins[kind[:-1], kind[1:]]
        cut[(np.cumsum(sizes) - sizes)] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(text)))
        owner = np.repeat(np.arange(len(words)), sizes)[starts]
        one = self.alone[kind]
        one = np.where(one < 0, -1 - text.astype(np.int64), one)
        counts, rows = np.ones(len(starts), np.int64), []
        for size in np.unique(lengths[lengths <= LONG]).tolist():
            if size == 1:
                continue
            own = np.flatnonzero(lengths == size)
            for k in range(0, len(own), 20_000):
                part = own[k : k + 20_000]
                ids, counts[part] = self._paths(text[starts[part][:, None] + np.arange(size)])
                rows.append((size, part, ids))
        long = np.flatnonzero(lengths > LONG)
        walked = self._long([text[i : i + n] for i, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True)])
        counts[long] = [*map(len, walked)]
        offset = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int64)
        single = lengths == 1
        flat[offset[single]] = one[starts[single]]
        for size, part, ids in rows:
            n = counts[part]
            row, column = np.nonzero(np.arange(size)[None, :] >= size - n[:, None])
            flat[(offset[part] + n - size)[row] + column] = ids[row, column]
        for i, nodes in zip(offset[long].tolist(), walked, strict=True):
            flat[i : i + len(nodes)] = nodes
        flat, each = self._expanded(flat)
        per_word = np.bincount(np.repeat(owner, counts), each, minlength=len(words)).astype(np.int64)
        ends = 4 * np.cumsum(per_word)
        raw, at = flat.astype("<u4").tobytes(), 0
        for w, end in zip(words, ends.tolist(), strict=True):
            self.cache[w] = raw[at:end]
            at = end

    # Texts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split, out, at = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall, [], 0
        while at < len(texts):
            words, new, size = [], set(), 0
            if len(self.cache) > CACHE:
                self.cache.clear()
            while at < len(texts) and (not words or size + len(texts[at]) <= CHUNK):
                own = split(self.prepared(texts[at]))
                new.update(own)
                words.append(own)
                size += len(texts[at])
                at += 1
            new.difference_update(self.cache)
            self._learn([*new])
            out += [b"".join(map(self.cache.__getitem__, own)) for own in words]
            for w in new:
                if len(w) > LONGEST_KEPT:
                    del self.cache[w]
        return out

    def prepared(self, text: str) -> str:
        if self.model.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if self.model.add_prefix else "") + text.replace(" ", SPACE)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        raw = b"".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.model.add_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")


@functools.lru_cache(maxsize=2)
def coder(name: str) -> Coder:
    """A worker's coder of a public vocabulary file, read in place."""
    return Coder(Model.read(vocabulary_path(name)))


def _encoder(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(name)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for k in range(0, len(texts), 500):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in own.encode(texts[k : k + 500])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 500), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return run


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(id, ids array<int>) of each row's whole text, however long; null counts as empty, an empty text has no ids.

    Rows without an id and repeated rows come out as they are; other columns, whatever their names, are not
    looked at. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    return docs.select(named_column(id_col).cast("long"), named_column(text_col)).mapInArrow(_encoder(vocabulary), "id long, ids array<int>")


def _decoder(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(name)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                ids = batch.column(1).slice(k, 500)
                raw = [b"" if x is None else np.asarray(x, "<u4").tobytes() for x in ids.to_numpy(zero_copy_only=False)]
                rows = [(i, own.decode(x), len(x) // 4, zlib.crc32(x)) for i, x in zip(batch.column(0).slice(k, 500).to_pylist(), raw, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["id", "text", "n_ids", "ids_crc32"])

    return run


def decode_pieces(ids: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(id, text, n_ids, ids_crc32) of (id, ids) rows; null ids are an empty text."""
    ship(ids.sparkSession)
    return ids.select("id", "ids").mapInArrow(_decoder(vocabulary), "id long, text string, n_ids long, ids_crc32 long")


