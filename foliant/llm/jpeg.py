"""Baseline JPEG in numpy: a writer that stores bytes as the DC values of 8x8 blocks, and a reader that parses
markers, Huffman-decodes scans and gives the thumbnail whose pixels are the blocks' DC values.

The writer makes one grey 8x8 block of each byte: with a quantiser of 8 the DC coefficient is the byte
less 128, so a decoder shows a flat block of exactly that grey and the DC-only thumbnail is the payload.
The reader decodes any baseline scan (grey or colour, with subsampling, with or without restarts). It
advances many restart intervals, of many images with the same tables, side by side.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

BLOCKS_WIDE, INTERVAL = 64, 64
ZIGZAG_SIZE = 64
#: DC codes of categories 0 to 8, each so long that code, bits and the one-bit end-of-block take 16 bits.
DC_LENGTHS = {category: 15 - category for category in range(9)}


def _canonical(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a DHT's counts by length and symbols."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _own_tables() -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    by_length = sorted((n, c) for c, n in DC_LENGTHS.items())
    counts = [sum(n == length for n, _ in by_length) for length in range(1, 17)]
    symbols = [c for _, c in by_length]
    dc = bytes([0x00, *counts, *symbols])
    ac = bytes([0x10, 1, *[0] * 15, 0x00])
    return dc, ac, _canonical(counts, symbols)


DC_TABLE, AC_TABLE, DC_CODES = _own_tables()


def _word_of() -> np.ndarray:
    """The 16 bits of a block by its DC difference + 255."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, _ = DC_CODES[category]
        bits = d if d >= 0 else d + (1 << category) - 1
        out[d + 255] = ((code << category) | bits) << 1  # the end-of-block code is 0
    return out


WORD_OF = _word_of()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def write(payload: bytes, note: bytes = b"") -> bytes:
    """A baseline JPEG whose DC-only thumbnail is ``payload`` in rows of 64 or more bytes; ``note`` becomes its comment.

    The payload's length must be a positive multiple of 64; rows get longer where the height would pass
    8191 blocks, and the last row is then filled with zeros.
    """
    n = len(payload)
    if not n or n % BLOCKS_WIDE:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    wide = BLOCKS_WIDE * -(-n // (BLOCKS_WIDE * 8191))
    if wide > 8128:
        raise ValueError("a payload of over 66 MB needs more than one image; see images()")
    high = -(-n // wide)
    samples = np.zeros(wide * high, np.int16)
    samples[:n] = np.frombuffer(payload, np.uint8)
    rows = samples.reshape(-1, INTERVAL)
    before = np.full_like(rows, 128)  # prediction restarts at 0, that is at sample 128, in each interval
    before[:, 1:] = rows[:, :-1]
    words = WORD_OF[(rows - before) + 255].astype(">u2")
    raw = words.view(np.uint8).reshape(len(rows), 2 * INTERVAL)
    marks = np.zeros((len(rows), 2), np.uint8)
    marks[:, 0], marks[:, 1] = 0xFF, 0xD0 + np.arange(len(rows)) % 8
    # A zero follows each 0xFF of the scan; restart markers stand between intervals.
    flat = np.concatenate([raw, marks], axis=1).ravel()[:-2]
    is_mark = np.zeros((len(rows), 2 * INTERVAL + 2), bool)
    is_mark[:, -2:] = True
    times = 1 + ((flat == 0xFF) & ~is_mark.ravel()[:-2])
    scan = np.repeat(flat, times)
    second = np.zeros(len(scan), bool)
    second[1:] = np.repeat(np.arange(len(flat)), times)[1:] == np.repeat(np.arange(len(flat)), times)[:-1]
    scan[second] = 0
    return b"".join([
        b"\xff\xd8", _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"), _segment(0xFE, note) if note else b"",
        _segment(0xDB, bytes([0, 8, *[1] * 63])), _segment(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + b"\x01\x11\x00"),
        _segment(0xC4, DC_TABLE), _segment(0xC4, AC_TABLE), _segment(0xDD, struct.pack(">H", INTERVAL)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"), scan.tobytes(), b"\xff\xd9",
    ])


@dataclass
class Component:
    number: int
    h: int
    v: int
    quantiser: int
    dc: int = 0
    ac: int = 0


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[tuple[int, int], bytes] = field(default_factory=dict)
    interval: int = 0
    comment: bytes = b""
    scan: bytes = b""
    #: Of the scan that holds the first component: itself alone, or with others in turn.
    scanned: list[Component] = field(default_factory=list)

    @property
    def blocks(self) -> tuple[int, int]:
        """Blocks across and down of the first component."""
        first, hm, vm = self.components[0], *self.steps
        return -(-self.width * first.h // (8 * hm)), -(-self.height * first.v // (8 * vm))

    @property
    def steps(self) -> tuple[int, int]:
        return max(c.h for c in self.components), max(c.v for c in self.components)

    @property
    def units(self) -> tuple[int, int]:
        """MCUs across and down."""
        if len(self.scanned) == 1:
            return self.blocks
        hm, vm = self.steps
        return -(-self.width // (8 * hm)), -(-self.height // (8 * vm))


def parse(data: bytes) -> Image:
    """The markers of a baseline JPEG up to the scan that holds its first component, the luminance."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG: no start marker")
    out, at = Image(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a JPEG ends or breaks off inside its headers")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                n = 64 * (1 + wide)
                out.quantisers[k] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                out.tables[body[0] >> 4, body[0] & 15] = body[1:n]
                body = body[n:]
        elif marker == 0xC0:
            bits, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not out.height or not out.width:
                raise ValueError("only 8-bit images with a stated size are baseline")
            out.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            out.interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xDA:
            by_number = {c.number: c for c in out.components}
            scanned = [by_number[body[1 + 2 * k]] for k in range(body[0])]
            if out.components and out.components[0] in scanned:
                for k, c in enumerate(scanned):
                    c.dc, c.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
                out.scanned, out.scan = scanned, data[at:]
                return out
            at = _after_scan(data, at)


def _after_scan(data: bytes, at: int) -> int:
    """Where the markers go on after a scan's bytes."""
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7 and data[at + 1] != 0xFF:
            return at
        at += 1 + (data[at + 1] != 0xFF)
    return len(data)


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(length, symbol) by the next 16 bits; length 0 is no code."""
    lengths, symbols = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for s, (code, n) in _canonical([*table[:16]], [*table[16:]]).items():
        lo = code << (16 - n)
        lengths[lo : lo + (1 << (16 - n))], symbols[lo : lo + (1 << (16 - n))] = n, s
    return lengths, symbols


def _intervals(scan: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The scan's bytes without stuffing and markers, and where each restart interval starts in them."""
    raw = np.frombuffer(scan, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    end = ff[(after != 0) & ~((after >= 0xD0) & (after <= 0xD7)) & (after != 0xFF)]
    n = int(end[0]) if len(end) else len(raw)
    ff, after = ff[ff < n], after[: (ff < n).sum()]
    keep = np.ones(n, bool)
    stuffed, marks = ff[after == 0], ff[after >= 0xD0]
    keep[stuffed[stuffed + 1 < n] + 1] = False
    keep[marks] = False
    keep[marks[marks + 1 < n] + 1] = False
    starts = np.concatenate([[0], np.cumsum(keep)[marks]]) if len(marks) else np.zeros(1, np.int64)
    return raw[:n][keep], starts.astype(np.int64)


def _layout(image: Image) -> list[Component]:
    """The components of the blocks of one MCU, in order."""
    if len(image.scanned) == 1:
        return image.scanned
    return [c for c in image.scanned for _ in range(c.h * c.v)]


def _signature(image: Image) -> tuple:
    return tuple((c.h, c.v, image.tables[0, c.dc], image.tables[1, c.ac]) for c in image.scanned)


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """The DC-only luminance thumbnail of each image, a pixel a block: rows x columns of uint8."""
    out: list = [None] * len(images)
    groups: dict[tuple, list[int]] = {}
    for k, image in enumerate(images):
        groups.setdefault(_signature(image), []).append(k)
    for own in groups.values():
        for k, dc in zip(own, _decoded([images[k] for k in own]), strict=True):
            image = images[k]
            grey = dc * int(image.quantisers[image.components[0].quantiser][0])
            out[k] = np.clip((grey + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return out


def _decoded(images: list[Image]) -> list[np.ndarray]:
    """Quantised DC values of the first component's blocks, for images that share tables and layout."""
    layout = _layout(images[0])
    tables = {(kind, k): _lookup(images[0].tables[kind, k]) for c in layout for kind, k in ((0, c.dc), (1, c.ac))}
    parts, starts, units, base = [], [], [], 0
    for image in images:
        across, down = image.units
        if across * down * len(_layout(image)) > 4 * len(image.scan):  # a block takes two bits at least
            raise ValueError("a JPEG's scan is too short for its size")
        data, at = _intervals(image.scan)
        n = image.interval or across * down
        want = -(-across * down // n)
        if len(at) < want:
            raise ValueError("a JPEG's scan lacks restart intervals")
        parts += [data, np.zeros(4, np.uint8)]
        starts.append(base + at[:want])
        units.append(np.minimum(n, across * down - n * np.arange(want)))
        base += len(data) + 4
    raw = np.concatenate([*parts, np.zeros(8, np.uint8)]).astype(np.uint32)
    wide = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    pos, units = np.concatenate(starts) * 8, np.concatenate(units)
    order = np.argsort(-units, kind="stable")  # lanes that end early are at the end
    pos, units = pos[order], units[order]
    limit = (len(wide) - 1) * 8
    first = images[0].components[0]
    firsts = sum(c is first or c.number == first.number for c in layout)
    values = np.zeros((int(units.max()) * firsts, len(pos)), np.int32)
    dc = {c.number: np.zeros(len(pos), np.int32) for c in layout}
    for unit in range(int(units.max())):
        live = int(np.searchsorted(-units, -unit, "left"))
        p, k = pos[:live], 0
        for c in layout:
            p, bits, size = _symbol(wide, p, *tables[0, c.dc], limit)
            diff = _amplitude(bits, size)
            dc[c.number][:live] += diff
            p = _skip_ac(wide, p, *tables[1, c.ac], limit)
            if c.number == first.number:
                values[unit * firsts + k, :live] = dc[c.number][:live]
                k += 1
        pos[:live] = p
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    out, at = [], 0
    for k, image in enumerate(images):
        n = len(starts[k])
        own = values[:, back[at : at + n]].T.reshape(n, -1, firsts)
        counts = units[back[at : at + n]]
        flat = own[np.arange(own.shape[1])[None, :] < counts[:, None]] if n > 1 else own[0, : int(counts[0])]
        across, down = image.units
        grid = flat.reshape(down, across, firsts)
        if len(image.scanned) > 1:
            c = image.components[0]
            grid = grid.reshape(down, across, c.v, c.h).transpose(0, 2, 1, 3).reshape(down * c.v, across * c.h)
        else:
            grid = grid[..., 0]
        w, h = image.blocks
        out.append(grid[:h, :w].astype(np.int64))
        at += n
    return out


def _symbol(wide: np.ndarray, pos: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, limit: int):
    """Reads a DC symbol and the bits that follow it: (new position, bits, their number)."""
    np.minimum(pos, limit, out=pos)
    window = wide[pos >> 3] << (pos & 7).astype(np.uint32)
    code = window >> 16
    n, size = lengths[code], symbols[code].astype(np.int32)
    if not n.all() or (size > 11).any():
        raise ValueError("a JPEG's scan holds no code of its table")
    pos = pos + n
    window = wide[np.minimum(pos >> 3, len(wide) - 1)] << (pos & 7).astype(np.uint32)
    bits = ((window >> 16) >> (16 - size).astype(np.uint32)).astype(np.int32)
    return pos + size, bits, size


def _amplitude(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits) * (size > 0)


def _skip_ac(wide: np.ndarray, pos: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, limit: int) -> np.ndarray:
    """Walks over the 63 AC coefficients of a block; only the lanes that have some go on after the first symbol."""
    np.minimum(pos, limit, out=pos)
    code = (wide[pos >> 3] << (pos & 7).astype(np.uint32)) >> 16
    n, s = lengths[code], symbols[code]
    if not n.all():
        raise ValueError("a JPEG's scan holds no code of its table")
    pos = pos + n
    lanes = np.flatnonzero(s)
    if not len(lanes):
        return pos
    s, done = s[lanes].astype(np.int64), np.zeros(len(lanes), np.int64)
    while len(lanes):
        done += np.where(s == 0xF0, 16, (s >> 4) + 1)
        pos[lanes] += s & 15
        go = done < 63
        lanes, done = lanes[go], done[go]
        if not len(lanes):
            break
        p = np.minimum(pos[lanes], limit)
        code = (wide[p >> 3] << (p & 7).astype(np.uint32)) >> 16
        n, s = lengths[code], symbols[code].astype(np.int64)
        if not n.all():
            raise ValueError("a JPEG's scan holds no code of its table")
        pos[lanes] = p + n
        go = s != 0
        lanes, done, s = lanes[go], done[go], s[go]
    return pos
