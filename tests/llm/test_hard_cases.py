"""Texts, files and names that once broke an operator."""

import hashlib
import io
import json
import random
import struct
import time
import zlib

import numpy as np
import pytest
from helpers import frame, normal, partition_of, prose, texts
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from foliant.llm import jpeg, media, naming
from foliant.llm.common import free, shared_root
from foliant.llm.edit_counts import Counter, TokenTree, _splitter, counts_after_edits, edited_trees, token_trees
from foliant.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from foliant.llm.line_dedup import drop_common_lines
from foliant.llm.naming import named
from foliant.llm.packing import pack
from foliant.llm.pieces import BPE, BYTE, NORMAL, UNIGRAM, Coder, Model, decode_pieces, encode_pieces
from foliant.llm.quality_rank import keep_quality, quality_scores
from foliant.llm.simhash import drop_near_duplicates, near_duplicates
from foliant.llm.tokens import LONG_BLANKS, VOCABULARY, encode, encode_ordinary, vocabulary_path
from foliant.llm.toxicity import drop_toxic, toxicity_scores
from foliant.llm.warc import gzip_member, id_ranges, read_warc, record_bytes, records_of, write_warc

M = 1_000_000
RUNS = [" " * M, "\n" * M, "\t" * M, " \t\n" * (M // 3), "a" * M, "x" + " " * M + "y", "　" * 200_000 + "z", "ab" + "\n" * M + " c", " " * LONG_BLANKS, " " * (LONG_BLANKS - 1) + "q", "<|endoftext|>" + " " * M]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


def test_long_runs_have_the_ids_of_tokenizers(tokenizer):
    for t in RUNS:
        assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, (t[:3], len(t))


def test_long_runs_among_other_rows(spark, tokenizer):
    rows = [(k, t) for k, t in enumerate([*RUNS[:6], "some words", None])]
    docs = frame(spark, rows)
    got: dict = {}
    for r in pack(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        ids, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(got[i], key=lambda r: r["piece"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    edit = F.array(F.struct(F.lit(500_000).alias("start"), F.lit(500_001).alias("end"), F.lit("q").alias("new")))
    for r in counts_after_edits(docs, edit).collect():
        t = rows[r["id"]][1] or ""
        changed = t[:500_000] + "q" + t[500_001:]
        assert (r["n_tokens"], r["n_tokens_edited"], r["edited_crc32"]) == (len(encode_ordinary(t)), len(encode_ordinary(changed)), zlib.crc32(changed.encode()))


# Token trees that are kept


def test_trees_are_kept_and_restored(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, prose(rng, 3000)) for k in range(5)] + [(9, ""), (10, None)]
    trees = token_trees(frame(spark, rows))
    trees.write.parquet(str(tmp_path / "trees"))
    kept, truth = spark.read.parquet(str(tmp_path / "trees")), {i: t or "" for i, t in rows}
    for step in range(3):
        edits = F.array(F.struct(F.lit(4000 + 7 * step).alias("start"), F.lit(4009 + step).alias("end"), F.lit(f" step {step}!").alias("new")))
        after = edited_trees(kept, edits)
        after.write.parquet(str(tmp_path / f"step{step}"))
        kept = spark.read.parquet(str(tmp_path / f"step{step}"))
        for r in kept.collect():
            t = truth[r["id"]]
            a, b = min(4000 + 7 * step, len(t)), min(4009 + step, len(t))
            truth[r["id"]] = t = t[:a] + f" step {step}!" + t[max(a, b) :]
            words = _splitter().findall(t)
            assert (r["text"], r["n_chars"], r["n_tokens"], r["n_pretokens"]) == (t, len(t), len(encode_ordinary(t)), len(words))
            assert np.frombuffer(r["lengths"], "<u4").tolist() == [*map(len, words)]
            assert r["n_reencoded"] < 25


def test_restoring_encodes_nothing():
    count = Counter(VOCABULARY)
    tree = TokenTree("some words and more of them " * 3000, count)
    kept = tree.stored()

    class Refuses(Counter):
        def __missing__(self, word):
            raise AssertionError("encoded")

    again = TokenTree.restored(Refuses(VOCABULARY), *kept)
    assert (again.tokens, again.chars, again.root.size, again.stored()) == (tree.tokens, tree.chars, tree.root.size, kept)


# SentencePiece


def test_long_words_take_linear_time_and_have_the_librarys_ids():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    coder = Coder(Model.read(vocabulary_path("piece_bpe_32k.model")))
    rng = random.Random(2)
    random_ = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    some = ["a" * M, random_, "abc" * 70_000, "=" * 100_003, *(random_[:n] for n in (64, 65, 255, 256, 257, 384, 511, 512, 513)), "日本" * 50_000, "\x01\x02é" * 5_000, "ab\U0001f600" * 2_000]
    began = time.time()
    for t, ids in zip(some, coder.encode(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t), (t[:5], len(t))
    assert time.time() - began < 60


def merged(word: str, score: dict) -> list[str]:
    symbols = [*word]
    while True:
        pairs = [(score[a + b], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in score]
        if not pairs:
            return symbols
        k = -max(pairs)[1]
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]


@pytest.mark.parametrize("with_bytes", [True, False])
def test_characters_that_are_no_piece_by_brute_force(with_bytes):
    """ä and q stand in pieces but are none themselves; é and x stand in none."""
    rng = random.Random(4)
    own = ["▁", "a", "b", "c", "ab", "äb", "bä", "cä", "qa", "abä", "bc", "▁a", "abc", "qab", "caqa"]
    pieces = ["<unk>", *own, *([f"<0x{b:02X}>" for b in range(256)] if with_bytes else [])]
    kinds = np.array([2] + [NORMAL] * len(own) + [BYTE] * (len(pieces) - 1 - len(own)))
    scores = np.array([0.0, *(-float(k) for k in range(len(pieces) - 1))])
    coder = Coder(Model(pieces, scores, kinds, BPE, True, False))
    index, score = {p: k for k, p in enumerate(pieces)}, {p: -float(k) for k, p in enumerate(own)}

    def ids(word: str) -> list[int]:
        out = []
        for s in merged(word, score):
            out += [index[s]] if s in score else [index[f"<0x{b:02X}>"] for b in s.encode()] if with_bytes else [0]
        return out

    words = ["".join(rng.choice("abcäqéx") for _ in range(rng.choice([1, 3, 8, 30, 100, 700]))) for _ in range(150)]
    for w, got in zip(words, coder.encode(words), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids(f"▁{w}"), w


def test_long_words_of_a_unigram_model_by_brute_force():
    rng = random.Random(9)
    pieces = ["<unk>", "▁", *"abcd", "ab", "bc", "cd", "abc", "▁a", "da", "dab", "aaaa"]
    scores = np.array([0.0, -3.0] + [rng.uniform(-9, -1) for _ in pieces[2:]])
    coder = Coder(Model(pieces, scores, np.array([2] + [NORMAL] * (len(pieces) - 1)), UNIGRAM, True, False))
    index = {p: k for k, p in enumerate(pieces)}
    for w in ["a" * 3000, "abcd" * 500, *("".join(rng.choice("abcd") for _ in range(n)) for n in (300, 1500))]:
        table = [0.0]
        for e in range(1, len(w) + 2):
            word = f"▁{w}"
            table.append(max(table[s] + scores[index[word[s:e]]] for s in range(max(0, e - 4), e) if word[s:e] in index))
        got = np.frombuffer(coder.encode([w])[0], "<u4").tolist()
        assert "".join(pieces[k] for k in got) == f"▁{w}" and scores[got].sum() == pytest.approx(table[-1])


# Media


def colour_by_components() -> bytes:
    """Two components of 16x8 pixels in scans of their own, the chroma first; luminance DC differences 5 and -2."""
    dc = bytes([0x00, 0, 3, *[0] * 14, 0, 2, 3])  # codes 00: none, 01: two bits, 10: three bits
    ac = bytes([0x10, 1, *[0] * 15, 0])
    frame_ = struct.pack(">BHHB", 8, 8, 16, 2) + bytes([1, 0x11, 0, 2, 0x11, 0])
    scan = lambda number, bits: jpeg._segment(0xDA, bytes([1, number, 0, 0, 63, 0])) + int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big").replace(b"\xff", b"\xff\x00")
    luminance = "10" + "101" + "0" + "01" + "01" + "0"  # 5 in three bits, end of block; -2 in two bits, end of block
    return (
        b"\xff\xd8" + jpeg._segment(0xDB, bytes([0, 16, *[1] * 63])) + jpeg._segment(0xC0, frame_) + jpeg._segment(0xC4, dc) + jpeg._segment(0xC4, ac)
        + scan(2, "00" + "0" + "00" + "0") + scan(1, luminance) + b"\xff\xd9"
    )


def test_media_of_others(spark):
    own = media.encode_payload(b"our own text")
    foreign = jpeg.write(bytes(range(64)))
    huge = bytearray(foreign)
    at = huge.index(b"\xff\xc0")
    huge[at + 5 : at + 9] = b"\xff\xff\xff\xff"
    rows = [(1, own), (2, None), (3, [foreign]), (4, [b"no image"]), (5, []), (6, [None]), (7, [own[0][:60]]), (8, [colour_by_components()]), (9, [bytes(huge)]), (10, [jpeg.write(bytes(64), b"payload x")]), (None, own)]
    got = {r["id"]: r for r in media.media_features(spark.createDataFrame(rows, "id long, media array<binary>").coalesce(1)).collect()}
    assert len(got) == len(rows)
    assert got[1]["n_bytes"] == 12 and got[1]["error"] is None and got[None]["payload_sha256"] == got[1]["payload_sha256"] == hashlib.sha256(b"our own text" + bytes(52)).hexdigest()
    assert [x for x in got[2].asDict().values() if x is not None] == [2]
    for k in (3, 10):
        assert got[k]["payload_sha256"] is None and got[k]["thumbnail_hash"] and got[k]["error"] is None and got[k]["width"] == 512
    for k in (4, 5, 6, 7, 9):
        assert got[k]["error"] and got[k]["thumbnail_hash"] is None and got[k]["media_bytes"] is not None
    assert (got[8]["width"], got[8]["height"], got[8]["error"]) == (16, 8, None)
    assert jpeg.thumbnails([jpeg.parse(colour_by_components())])[0].tolist() == [[128 + 10, 128 + 6]]


# WARC


def shards(folder: str) -> list[tuple]:
    at, path = pafs.FileSystem.from_uri(folder)
    return [(f["name"], f["records"], f["sha256"]) for f in json.loads(at.open_input_stream(f"{path}/manifest.json").read())["files"]]


def test_warc_files_depend_on_the_rows_alone(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    found = []
    for parts, shuffles in ((1, "4"), (7, "13")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        found.append(shards(write_warc(pages.repartition(parts, F.rand(parts)), range_bytes=1 << 20, roll_bytes=100_000)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and len(found[0]) > 8 and sum(n for _, n, _ in found[0]) == pages.count()


@pytest.mark.parametrize("cells", [1 << 16, 1 << 10])
def test_ranges_are_even_and_in_order(spark, monkeypatch, cells):
    """With few cells, heavy ones are cut finer; heavy ids and rows without one are cut by digest."""
    from foliant.llm import warc

    monkeypatch.setattr(warc, "CELLS", cells)
    ids = [*range(-50, 50), *range(10**9, 10**9 + 500), *([77] * 400), *([None] * 400), 2**62, -(2**62)]
    rows = [(i, hashlib.sha256(f"{k}".encode()).hexdigest(), 700) for k, i in enumerate(ids)]
    heads = spark.createDataFrame(rows, "id long, digest string, bytes long")
    ranged, n = id_ranges(heads, 20_000)
    got = ranged(heads).select("id", "digest", "range").collect()
    assert len(got) == len(ids) and {r["range"] for r in got} <= set(range(n))
    sizes = np.bincount([r["range"] for r in got], minlength=n)
    assert n >= len(ids) * 1000 // 40_000 and sizes.max() <= 60
    known = sorted((r["id"], r["range"]) for r in got if r["id"] is not None)
    assert [x for _, x in known] == sorted(x for _, x in known)
    assert max(r["range"] for r in got if r["id"] is None) < min(x for _, x in known)


def test_warc_leaves_the_files_of_others_alone(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 200, "c", "c")], "page_id long, url string, html string, range string, _cell0 string")
    (tmp_path / "taken").mkdir()
    (tmp_path / "taken" / "other.txt").write_text("mine")
    with pytest.raises(ValueError):
        write_warc(pages, (tmp_path / "taken").as_uri())
    assert (tmp_path / "taken" / "other.txt").read_text() == "mine"
    folder = write_warc(pages, (tmp_path / "new").as_uri())
    assert read_warc(spark, folder).count() == 1


def test_cut_warc_files_raise(spark, tmp_path):
    member = gzip_member(record_bytes(1, "http://x", b"payload", hashlib.sha256(b"payload").hexdigest(), None))
    for n in (1, 5, 12, len(member) - 1):  # the first are within the next member's header
        with pytest.raises(ValueError):
            [*records_of(io.BytesIO(member + member[:n]))]
    folder = write_warc(spark.createDataFrame([(k, "u", f"page {k}") for k in range(9)], "page_id long, url string, html string"), (tmp_path / "w").as_uri())
    name = shards(folder)[0][0]
    raw = (tmp_path / "w" / name).read_bytes()
    whole, end = [*records_of(io.BytesIO(raw))], zlib.decompressobj(31)
    end.decompress(raw)
    (tmp_path / "w" / name).write_bytes(raw[: len(raw) - len(end.unused_data)])  # one whole record is left
    assert len(whole) == 9
    with pytest.raises(Exception, match="holds 1 records instead of 9"):
        read_warc(spark, folder).collect()


# Dedup


def test_names_where_digests_meet_too(spark, monkeypatch):
    """With one hash and one digest for all keys, only the keys themselves tell them apart."""
    keys = [(k, f"key {k % 5}", f"tie {k}") for k in range(200)]
    df = spark.createDataFrame(keys, "k int, key string, tie string")
    real = naming.F.xxhash64
    monkeypatch.setattr(naming.F, "xxhash64", lambda *c: F.lit(7).cast("long") if c == ("key",) else real(*c))
    monkeypatch.setattr(naming, "digest", lambda key: b"same")
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(naming)  # the workers then have the patched digest
    try:
        got = named(df, ["key"], ["tie"], ["k"], "test").collect()
    finally:
        cloudpickle.unregister_pickle_by_value(naming)
    assert partition_of((r["k"], r["name"]) for r in got) == partition_of((k, k % 5) for k in range(200))


X = "a long enough text of some ten words or a few more"
Y = "quite another document that shares nothing with the first of them here"


@pytest.mark.parametrize("drop", [drop_near_duplicates, lambda d: drop_near_duplicates(d, shingle=5, similarity=0.8), drop_exact_duplicates])
@pytest.mark.parametrize(
    "rows, texts_",
    [
        ([(1, X), (2, X), (2, Y)], [X, Y]),
        ([(None, X), (None, X), (None, Y)], [X, Y]),
        ([(5, X), (5, X), (5, X)], [X]),
        ([(None, X), (3, X), (3, X), (4, X.upper())], [X]),
        ([(None, None), (1, ""), (2, None)], [""]),
    ],
)
def test_one_row_of_each_group_stays(spark, drop, rows, texts_):
    docs = spark.createDataFrame([(i, t, "c", "c", "c") for i, t in rows], "doc_id long, text string, _id string, _row string, component string")
    kept = drop(docs)
    got = kept.collect()
    assert kept.columns == docs.columns and sorted(normal(r["text"]) for r in got) == sorted(texts_)
    if drop is not drop_exact_duplicates:
        for r in got:
            known = [i for i, t in rows if normal(t) == normal(r["text"]) and i is not None]
            assert r["doc_id"] == min(known, default=None)


CLASH = ["_id", "_none", "_row", "_row0", "_k1", "_k2", "_text", "_score", "_predicted", "_places", "_lines", "_pos", "id", "row", "head", "label", "bytes", "pos", "features", "_Text_to_score", "dotted.name", "`quoted`"]


def test_any_column_names_pass(spark):
    some = [(i, t) for i, t in texts(n=30) if i != 2001]
    quoted = ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASH)
    docs = spark.createDataFrame([(i, t, *CLASH) for i, t in some], f"doc_id long, text string, {quoted}")
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2, "c", "c") for i, _ in some if i is not None], "doc_id long, quality int, toxic int, _id string, label string")
    for kept in (drop_exact_duplicates(docs), drop_near_duplicates(docs), drop_near_duplicates(docs, similarity=0.8), keep_quality(docs, labels), drop_toxic(docs, labels)):
        assert kept.columns == docs.columns
        assert all(list(r)[2:] == CLASH for r in kept.collect())
    lines = drop_common_lines(docs)
    assert lines.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"] and lines.count() == len(some)
    n = len(some)
    assert quality_scores(docs, labels).count() == n and toxicity_scores(docs, labels).count() == n and near_duplicates(docs).count() == n
    assert decode_pieces(encode_pieces(docs)).count() == n and media.media_features(media.encode_media(docs)).count() == n
    assert exact_duplicates(docs).count() == len({(i, t) for i, t in some})
    assert pack(docs).select("doc_id").distinct().count() == len({i for i, _ in some})


def test_free_names():
    assert free(["_ID", "__id", "x"], "_id", "y", "X") == ["___id", "y", "_X"]


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Nothing:
        def __getattr__(self, name):
            return self

        def __call__(self, *a, **b):
            return self

        def isDefined(self):  # noqa: N802
            return False

    class Context(Nothing):
        master = "spark://host:7077"

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared_root(Session())


def test_packing_ends_where_rounds_join_nothing(spark):
    """One tiny document could enter any bin, and no two of the others fit together."""
    rows = [(k, " one" * 36) for k in range(300)] + [(999, "")]
    got = pack(frame(spark, rows), capacity=60, bound=20).collect()
    assert len(got) == 301 and 300 <= len({r["sequence_id"] for r in got}) <= 301
