import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import empty, frame, texts
from pyspark.sql import functions as F

from foliant.llm import jpeg
from foliant.llm.edit_counts import Counter, TokenTree, _splitter, counts_after_edits
from foliant.llm.media import encode_media, encode_payload, media_features
from foliant.llm.packing import best_fit, pack, pieces
from foliant.llm.pieces import BPE, NORMAL, UNIGRAM, Coder, Model, decode_pieces, encode_pieces
from foliant.llm.tokens import VOCABULARY, encode, vocabulary_path

ODD = ["", " ", "  ", "a", " a", "a ", "a  b\n\t c", "it's 12 o'clock!!", "日本語のテスト、中文", "\U0001f600 ok\r\n", "▁x", "<|endoftext|> and more", "aaaa" * 100, "%%%%####====----", "\x00\x01", "x" * 3000]


@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


def test_ids_are_those_of_tokenizers(reference_tokenizer):
    for t in ODD + [t or "" for _, t in texts()]:
        assert encode(t).tolist() == reference_tokenizer.encode(t, add_special_tokens=False).ids


def test_packing(spark, reference_tokenizer):
    rows = texts()
    got = pack(frame(spark, rows), capacity=64, bound=50).collect()
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        if i in (None, 2000, 2001):
            continue
        ids = [*reference_tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        own, at = sorted(by_doc[i], key=lambda r: r["piece"]), 0
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 64) and r["length"] <= 64
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and (len(ids) > 64 or len(own) == 1)
    assert len(by_doc[2000]) == 2 and len(by_doc[2001]) == 2 and sum(r["doc_id"] is None for r in got) == sum(len(pieces(t or "", 64)) for i, t in rows if i is None)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    whole = best_fit(sorted((r["length"] for r in got), reverse=True), 64)
    assert len(sequences) <= len(whole) * 1.05 + 2
    assert pack(empty(spark)).count() == 0


def test_best_fit_takes_the_fullest_bin():
    assert best_fit([5, 4, 3, 3, 2], 8) == [[0, 2], [1, 3], [4]]


def brute_edit(t: str, edits: list) -> str:
    for a, b, new in edits:
        a = min(max(a, 0), len(t))
        b = min(max(b, a), len(t))
        t = t[:a] + new + t[b:]
    return t


def test_edits_by_brute_force():
    rng, count = random.Random(4), Counter(VOCABULARY)
    parts = ["the", " ", "  ", "\n", "'s", "'", "a", "1", "23", "é", "\t", " b", "!!", "...", "　", "word", " longerword", "\r\n"]
    for _ in range(250):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(400)))
        tree = TokenTree(t, count)
        for _ in range(6):
            a = rng.randrange(len(t) + 3)
            e = (a, a + rng.choice([0, 0, 1, 2, 5, 60]), "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 3, 30, 200]))))
            t = brute_edit(t, [e])
            tree.edit(*e)
            assert tree.text() == t and [*tree._words(0)] == _splitter().findall(t) and tree.tokens == len(count.encode(t))


def test_edits_re_encode_little():
    tree = TokenTree("some words and more of them " * 2000, Counter(VOCABULARY))
    tree.edit(20000, 20005, "xyz")
    assert tree.encoded < 20


def test_edit_counts(spark):
    rows = texts()
    edits = F.array(F.struct(F.lit(2).alias("start"), F.lit(6).alias("end"), F.lit(" new ").alias("new")), F.struct(F.lit(9999999).alias("start"), F.lit(1).alias("end"), F.lit(None).cast("string").alias("new")), F.struct(F.lit(None).cast("int").alias("start"), F.lit(1).alias("end"), F.lit("x").alias("new")))
    got = sorted(tuple(r)[1:] for r in counts_after_edits(frame(spark, rows), edits).collect())
    enc = Counter(VOCABULARY).encode
    expected = []
    for _, t in rows:
        e = brute_edit(t or "", [(2, 6, " new ")])
        expected.append((len(enc(t or "")), len(enc(e)), len(_splitter().findall(e)), len(e), zlib.crc32(e.encode())))
    assert sorted((a, b, c, d, e) for a, b, c, _, d, e in got) == sorted(expected)
    assert counts_after_edits(frame(spark, rows), F.lit(None).cast("array<struct<start:int,end:int,new:string>>")).where("n_tokens <> n_tokens_edited").count() == 0
    assert counts_after_edits(empty(spark), edits).count() == 0


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def test_pieces_are_the_librarys(library):
    rng = random.Random(3)
    some = ODD + [t or "" for _, t in texts()]
    some += ["".join(rng.choice("abcdefghi .,-=#1234567890 \n") for _ in range(rng.randrange(90))) for _ in range(400)]
    some += ["".join(rng.choice(["the", "ing", "tion", "er", "-", "_", "==", "__", "a", "in", " ", "  ", ".", "...", "://", "10", "00"]) for _ in range(rng.randrange(25))) for _ in range(400)]
    coder = Coder(Model.read(vocabulary_path("piece_bpe_32k.model")))
    assert coder.model.type == BPE
    for t, ids in zip(some, coder.encode(some), strict=True):
        listed = np.frombuffer(ids, "<u4").tolist()
        assert listed == library.encode(t)
        assert coder.decode(ids) == library.decode(listed)
        assert coder.decode(ids) == t or "▁" in t


def test_unigram_viterbi_by_brute_force():
    rng = random.Random(9)
    pieces_ = ["<unk>", "▁", *"abcd", "ab", "bc", "cd", "abc", "▁a", "▁ab", "da", "dab", "▁b"]
    scores = np.array([0.0, -3.0] + [rng.uniform(-9, -1) for _ in pieces_[2:]])
    coder = Coder(Model(pieces_, scores, np.array([2] + [NORMAL] * (len(pieces_) - 1)), UNIGRAM, True, False))
    index = {p: k for k, p in enumerate(pieces_)}

    def best(w: str) -> float:
        table = [0.0] + [-np.inf] * len(w)
        for e in range(1, len(w) + 1):
            table[e] = max((table[s] + scores[index[w[s:e]]] for s in range(e) if w[s:e] in index), default=-np.inf)
        return table[-1]

    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(200)] + ["a" * 100]
    for w, ids in zip(words, coder.encode(words), strict=True):
        listed = np.frombuffer(ids, "<u4").tolist()
        assert "".join(pieces_[k] for k in listed) == f"▁{w}"
        assert sum(scores[k] for k in listed) == pytest.approx(best(f"▁{w}"))


def test_piece_columns(spark, library):
    rows = texts()
    got = decode_pieces(encode_pieces(frame(spark, rows))).collect()
    assert sorted((r["id"] or -1, r["text"], r["n_ids"]) for r in got) == sorted((i or -1, t or "", len(library.encode(t or ""))) for i, t in rows)
    assert encode_pieces(empty(spark)).count() == 0


def test_media(spark):
    rows = texts()
    found = media_features(encode_media(frame(spark, rows)))
    for r in found.collect():
        own = [t or "" for i, t in rows if i == r["id"]]
        assert r["n_bytes"] in [len(t.encode()) for t in own]
    got = {r["id"]: r for r in found.collect()}
    for i, t in rows:
        if i in (None, 2001):
            continue
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = encode_payload(raw)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (sum(map(len, media)), hashlib.sha256(b"".join(media)).hexdigest())
        assert (r["width"], r["height"]) == (512, len(payload) // 8)
    assert media_features(encode_media(empty(spark))).count() == 0


@pytest.mark.parametrize("n", [64, 128, 64 * 70, 64 * 8300])
def test_jpeg_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    shown = jpeg.thumbnails([jpeg.parse(jpeg.write(payload, b"note"))])[0]
    assert shown.tobytes()[:n] == payload and shown.shape[1] % 64 == 0


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, code: int, n: int) -> None:
        self.text += format(code, f"0{n}b") if n else ""

    def bytes(self) -> bytes:
        padded = self.text + "1" * (-len(self.text) % 8)
        raw = bytes(int(padded[k : k + 8], 2) for k in range(0, len(padded), 8))
        return raw.replace(b"\xff", b"\xff\x00")


@pytest.mark.parametrize("interval", [0, 2])
def test_colour_scan_with_subsampling_and_coefficients(interval):
    """A 4:2:0 image with AC coefficients, zero runs and odd sizes, encoded bit by bit here."""
    rng = random.Random(interval)
    dc_counts, dc_symbols = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [*range(12)]
    ac_symbols = [0x00, 0x01, 0x02, 0x11, 0xF0, 0x23, 0x31]
    ac_counts = [0, 1, 2, 3, 1] + [0] * 11
    dc, ac = jpeg._canonical(dc_counts, dc_symbols), jpeg._canonical(ac_counts, ac_symbols)
    width, height = 37, 21
    across, down = 3, 2
    scan, bits, last, truth = b"", Bits(), {1: 0, 2: 0, 3: 0}, {}

    def amplitude(v: int) -> tuple[int, int]:
        n = abs(v).bit_length()
        return (v if v >= 0 else v + (1 << n) - 1), n

    def block(c: int) -> int:
        value = rng.randrange(-60, 60)
        raw, n = amplitude(value - last[c])
        last[c] = value
        bits.put(*dc[n])
        bits.put(raw, n)
        left = 63
        for _ in range(rng.randrange(4)):
            s = rng.choice([0x01, 0x02, 0x11, 0xF0, 0x23, 0x31])
            used = 16 if s == 0xF0 else (s >> 4) + 1
            if used >= left:
                break
            left -= used
            bits.put(*ac[s])
            bits.put(rng.getrandbits(s & 15) if s & 15 else 0, s & 15)
        bits.put(*ac[0])
        return value

    for unit in range(across * down):
        if interval and unit and unit % interval == 0:
            scan += bits.bytes() + bytes([0xFF, 0xD0 + (unit // interval - 1) % 8])
            bits, last = Bits(), {1: 0, 2: 0, 3: 0}
        my, mx = divmod(unit, across)
        for v in range(2):
            for h in range(2):
                truth[2 * my + v, 2 * mx + h] = block(1)
        block(2)
        block(3)
    scan += bits.bytes()
    frame_ = bytes([8, 0, height, 0, width, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    data = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0, 16, *[1] * 63])) + jpeg._segment(0xC0, frame_)
    data += jpeg._segment(0xC4, bytes([0x00, *dc_counts, *dc_symbols])) + jpeg._segment(0xC4, bytes([0x10, *ac_counts, *ac_symbols]))
    data += (jpeg._segment(0xDD, bytes([0, interval])) if interval else b"") + jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    shown = jpeg.thumbnails([jpeg.parse(data), jpeg.parse(data)])
    expected = np.array([[np.clip((truth[y, x] * 16 + 4 >> 3) + 128, 0, 255) for x in range(5)] for y in range(3)])
    assert all((x == expected).all() and x.shape == (3, 5) for x in shown)


def test_broken_jpegs_raise():
    good = jpeg.write(bytes(64))
    for bad in (b"", good[2:], good[:40], good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises((ValueError, KeyError, IndexError)):
            jpeg.thumbnails([jpeg.parse(bad)])
