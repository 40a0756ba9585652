"""Media columns: texts stored as baseline JPEGs, and what their DC-only thumbnails tell.

``encode_media`` makes the column, ``media_features`` reads it back: markers, Huffman-decoded scans,
DC-only luminance thumbnails, dimensions and hashes. The reader knows nothing of the texts.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .common import named_column, ship, texts_of

#: Bytes of payload in one image; longer payloads are several images.
IMAGE_BYTES = 32 << 20
#: Bytes handled at once.
CHUNK_BYTES = 2 << 20


def encode_payload(text: bytes) -> list[bytes]:
    """The images of a text, padded with zero bytes to a positive multiple of 64."""
    payload = text + bytes(-len(text) % 64 if text else 64)
    cuts = range(0, len(payload), IMAGE_BYTES)
    return [jpeg.write(payload[k : k + IMAGE_BYTES], f"payload {len(payload[k : k + IMAGE_BYTES])} text {len(text)}".encode()) for k in cuts]


def _encoder():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, media, size = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids.append(i)
                media.append(encode_payload(text))
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield out(ids, media)
                    ids, media, size = [], [], 0
            if ids:
                yield out(ids, media)

    def out(ids: list, media: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.list_(pa.binary()))], ["id", "media"])

    return run


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text as an array of baseline JPEGs, one but for very long texts; null counts as empty.

    Rows without an id and repeated rows come out as they are; other columns, whatever their names, are not
    looked at. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    return docs.select(named_column(id_col).cast("long"), named_column(text_col)).mapInArrow(_encoder(), "id long, media array<binary>")


def difference_hash(thumbnail: np.ndarray) -> str:
    """64-bit difference hash as hex: whether each of 8x9 area means is brighter than its right neighbour."""
    rows, columns = (np.linspace(0, n, k + 1) for n, k in zip(thumbnail.shape, (8, 9), strict=True))
    total = np.zeros((thumbnail.shape[0] + 1, thumbnail.shape[1] + 1))
    total[1:, 1:] = thumbnail.cumsum(0, dtype=np.float64).cumsum(1)

    def at(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo = np.floor(edges).astype(int)
        return lo, edges - lo

    (r, fr), (c, fc) = at(rows), at(columns)
    r1, c1 = np.minimum(r + 1, thumbnail.shape[0]), np.minimum(c + 1, thumbnail.shape[1])
    down = total[r] * (1 - fr)[:, None] + total[r1] * fr[:, None]
    area = down[:, c] * (1 - fc) + down[:, c1] * fc
    means = np.diff(np.diff(area, axis=0), axis=1)
    bits = np.round(means[:, :-1], 6) > np.round(means[:, 1:], 6)
    return np.packbits(bits).tobytes().hex()


FEATURES = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, images int, width int, height int, thumbnail_hash string, error string"
_SCHEMA = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("images", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("thumbnail_hash", pa.string()), ("error", pa.string())])
#: "payload <bytes in this image> text <bytes of the text>": the comment of images that hold a text.
NOTE = re.compile(rb"payload (\d+) text (\d+)")
#: What reading a file that is no baseline JPEG, or a broken one, may raise.
BROKEN = (ValueError, KeyError, IndexError, struct.error)


def _shown(media: list[list[bytes]]) -> list[list[tuple[jpeg.Image, np.ndarray]] | str]:
    """The images of each media with their thumbnails, or what is wrong with them."""
    parsed: list = []
    for own in media:
        try:
            if not own or any(x is None for x in own):
                raise ValueError("no image")
            parsed.append([jpeg.parse(x) for x in own])
        except BROKEN as e:
            parsed.append(str(e))
    good = [x for x in parsed if not isinstance(x, str)]
    try:
        thumbnails = iter(jpeg.thumbnails([x for own in good for x in own]))
    except BROKEN as e:
        return [str(e)] if len(media) == 1 else [_shown([own])[0] for own in media]  # one by one: which is it?
    return [own if isinstance(own, str) else [(x, next(thumbnails)) for x in own] for own in parsed]


def _features(ids: list, media: list[list[bytes] | None]) -> pa.RecordBatch:
    rows = []
    for i, own, images in zip(ids, media, _shown([own or [] for own in media]), strict=True):
        stored = [None, None] if own is None else [sum(len(x or b"") for x in own), hashlib.sha256(b"".join(x or b"" for x in own)).hexdigest()]
        if isinstance(images, str):
            rows.append((i, None, None, None, None, *stored, None if own is None else len(own), None, None, None, None if own is None else images))
            continue
        notes = [NOTE.fullmatch(x.comment) for x, _ in images]
        payload = [None] * 4
        if all(notes):
            whole = b"".join(t.tobytes()[: int(note[1])] for (_, t), note in zip(images, notes, strict=True))
            payload = [int(notes[0][2]), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:])]
        width, height = max(x.width for x, _ in images), sum(x.height for x, _ in images)
        rows.append((i, *payload, *stored, len(own), width, height, "-".join(difference_hash(t) for _, t in images), None))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _feature_reader():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, media, size = [], [], 0
            column = batch.column(1)
            for k, i in enumerate(batch.column(0).to_pylist()):
                own = column[k].as_py()
                ids.append(i)
                media.append(own)
                size += sum(len(x or b"") for x in own or [])
                if size >= 2 * CHUNK_BYTES:
                    yield _features(ids, media)
                    ids, media, size = [], [], 0
            if ids:
                yield _features(ids, media)

    return run


def media_features(media: DataFrame) -> DataFrame:
    """Of each (id, media array<binary>) row what its stored bytes decode to: dimensions, payload, thumbnail hash.

    Of several images the width is the widest's, the height their sum, and the thumbnail hash one hash an image,
    joined by hyphens in their order. The payload's columns are null where an image isn't one of
    ``encode_media``'s. Media that aren't baseline JPEGs have only the columns of their bytes, and in ``error``
    what is wrong; null media have only an id. Rows without an id and repeated rows come out as they are; equal
    media give equal values. An empty table gives an empty table.
    """
    ship(media.sparkSession)
    return media.select("id", "media").mapInArrow(_feature_reader(), FEATURES)
