"""Page operations on PDFs whose objects stand in the file one by one: split, merge, crop, scale, rotate.

In Python, inside the tasks. Files whose objects are packed in object streams, or encrypted, give None.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship

_HEADER = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
_REFERENCE = re.compile(rb"(?<![0-9.])(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"/?[^\s()<>\[\]/%]*")
_CATALOG = re.compile(rb"/Type\s*/Catalog\b")
_LENGTH = re.compile(rb"/Length\s+(\d+)(?!\s+\d+\s+R)")
_HAS_STREAM = re.compile(rb">>\s*stream\r?\n")
_BOX_NUMBER = re.compile(rb"-?[\d.]+")
_BLANK = b" \t\r\n\f\0"
_INHERITED = (b"MediaBox", b"CropBox", b"Resources", b"Rotate")


def _skip(data: bytes, at: int) -> int:
    while at < len(data) and (data[at] in _BLANK or data[at] == 0x25):
        if data[at] == 0x25:  # a comment runs to the line's end
            while at < len(data) and data[at] not in b"\r\n":
                at += 1
        else:
            at += 1
    return at


def _value_end(data: bytes, at: int) -> int:
    """Where the value that begins at ``at`` ends."""
    c = data[at : at + 1]
    if data[at : at + 2] == b"<<" or c == b"[":
        close, at = (b">>", at + 2) if c == b"<" else (b"]", at + 1)
        while True:
            at = _skip(data, at)
            if at >= len(data):
                raise ValueError("a PDF value isn't closed")
            if data.startswith(close, at):
                return at + len(close)
            at = _value_end(data, at)
    if c == b"(":
        depth = 0
        while at < len(data):
            if data[at] == 0x5C:
                at += 1
            elif data[at] == 0x28:
                depth += 1
            elif data[at] == 0x29:
                depth -= 1
                if not depth:
                    return at + 1
            at += 1
        raise ValueError("a PDF string isn't closed")
    if c == b"<":
        return data.index(b">", at) + 1
    if m := _REFERENCE.match(data, at):
        return m.end()
    return max(_TOKEN.match(data, at).end(), at + 1)


def _entry() -> re.Pattern:
    """A key and its value in one match: no comments, no brackets in strings, arrays and dictionaries a few levels deep."""
    flat, inner = rb"[^<>()\[\]%]++", rb"\((?:[^()\\]++|\\.)*+\)|<(?!<)[^>]*+>"
    for _ in range(3):
        inner += rb"|\[(?:%s|%s)*+\]|<<(?:%s|%s)*+>>" % (flat, inner, flat, inner)
    blank, name = rb"[ \t\r\n\f\0]*+", rb"[^\s()<>\[\]/%]"
    return re.compile(rb"%s/(%s*+)%s(\d++\s++\d++\s++R\b|%s++|/%s*+|%s)" % (blank, name, blank, name, name, inner), re.S)


_ENTRY = _entry()


def entries(data: bytes) -> dict[bytes, bytes]:
    """The keys of a dictionary with their values as they stand."""
    at, out = data.index(b"<<") + 2, {}
    while True:
        while m := _ENTRY.match(data, at):  # what this doesn't take is read step by step
            out[m[1]], at = m[2], m.end()
        at = _skip(data, at)
        if data.startswith(b">>", at):
            return out
        if data[at : at + 1] != b"/":
            raise ValueError("a PDF dictionary is broken")
        end = _value_end(data, at)
        start = _skip(data, end)
        key, at = data[at + 1 : end], _value_end(data, start)
        out[key] = data[start:at]


def _written(values: dict[bytes, bytes]) -> bytes:
    return b"<< " + b" ".join(b"/%s %s" % x for x in values.items()) + b" >>"


@dataclass
class Page:
    objects: dict[int, bytes]
    values: dict[bytes, bytes]

    @property
    def box(self) -> tuple[float, float, float, float]:
        numbers = [float(x) for x in _BOX_NUMBER.findall(self.values.get(b"MediaBox", b"[0 0 612 792]"))]
        return tuple(numbers[:4])

    @property
    def size(self) -> tuple[float, float]:
        x0, y0, x1, y1 = self.box
        return x1 - x0, y1 - y0

    @property
    def rotation(self) -> int:
        return int(self.values.get(b"Rotate", b"0")) % 360


def _objects(content: bytes) -> dict[int, bytes]:
    out, at = {}, 0
    while content.find(b"obj", at) >= 0 and (m := _HEADER.search(content, at)):  # the table at the end holds none
        start = m.end()
        end = content.find(b"endobj", start)
        stream = content.find(b"stream", start, end if end >= 0 else len(content))
        if stream >= 0 and (n := _LENGTH.search(content[start:stream])):
            end = content.find(b"endobj", stream + int(n[1]))
        if end < 0:
            break
        out[int(m[1])] = content[start:end].strip()
        at = end + 6
    return out


def pages_of(content: bytes) -> list[Page] | None:
    """The pages in order, each with what it inherits; None if the file can't be taken apart."""
    try:
        objects = _objects(content)
        if b"/Encrypt" in content or b"/ObjStm" in content:
            return None
        root = next(x for x in objects.values() if b"/Catalog" in x and _CATALOG.search(x))
        found: list[Page] = []
        stack = [(int(_REFERENCE.match(entries(root)[b"Pages"])[1]), {})]
        seen = set()
        while stack:
            number, above = stack.pop()
            if number in seen:
                raise ValueError("a PDF's page tree runs in a circle")
            seen.add(number)
            values = above | entries(objects[number])
            if b"Kids" in values:
                kids = [int(x) for x in _REFERENCE.findall(values[b"Kids"])]
                stack += [(k, {x: values[x] for x in _INHERITED if x in values}) for k in reversed(kids)]
            else:
                found.append(Page(objects, values))
        return found
    except (ValueError, KeyError, StopIteration, TypeError, IndexError):
        return None


def assembled(pages: list[Page], before: list[bytes | None] | None = None) -> bytes:
    """A PDF of the pages in order, with the objects that they refer to. ``before``: content put before each page's own, closed after it."""
    out: list[bytes] = [b"", b""]
    kids: list[int] = []
    numbers: dict[tuple[int, int], int] = {}

    def copied(body: bytes, objects: dict[int, bytes]) -> bytes:
        head, mark, rest = body.partition(b"stream") if b"stream" in body and _HAS_STREAM.search(body) else (body, b"", b"")

        def renamed(m: re.Match) -> bytes:
            key = (id(objects), int(m[1]))
            if key not in numbers and key[1] in objects:
                out.append(b"")
                numbers[key] = len(out)
                todo.append((key, objects))
            return b"%d 0 R" % numbers[key] if key in numbers else b"null"

        return _REFERENCE.sub(renamed, head) + mark + rest

    todo: list[tuple[tuple[int, int], dict[int, bytes]]] = []
    for page, extra in zip(pages, before or [None] * len(pages), strict=True):
        values = {k: v for k, v in page.values.items() if k not in (b"Parent", b"StructParents", b"Annots")}
        own = copied(_written(values), page.objects)
        if extra is not None:
            held = entries(own)
            contents = held.get(b"Contents", b"[]").strip(b"[]")
            out += [b"<< /Length %d >>\nstream\n%s\nendstream" % (len(x), x) for x in (b"q " + extra, b"Q")]
            own = _written(held | {b"Contents": b"[%d 0 R %s %d 0 R]" % (len(out) - 1, contents, len(out))})
        out.append(own[:-2] + b"/Parent 2 0 R >>")
        kids.append(len(out))
        while todo:
            key, objects = todo.pop()
            out[numbers[key] - 1] = copied(objects[key[1]], objects)
    out[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    out[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    made, at = bytearray(b"%PDF-1.7\n"), []
    for k, body in enumerate(out, 1):
        at.append(len(made))
        made += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    start = len(made)
    made += b"xref\n0 %d\n0000000000 65535 f \n" % (len(out) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at)
    return bytes(made + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(out) + 1, start))


def page_count(content: bytes) -> int:
    return len(pages_of(content) or [])


def page_sizes(content: bytes) -> list[tuple[float, float, int]]:
    """(width, height, rotation) of each page in points and degrees."""
    return [(*p.size, p.rotation) for p in pages_of(content) or []]


def extract(content: bytes, first: int, last: int) -> bytes | None:
    """Pages first to last, counted from 1; None if that is no range of the file."""
    pages = pages_of(content)
    return assembled(pages[first - 1 : last]) if pages and 1 <= first <= last <= len(pages) else None


def split(content: bytes, size: int = 1) -> list[tuple[str, bytes]]:
    """(file name, PDF) of blocks of ``size`` pages (at least 1), the last one clipped; single pages are named so."""
    pages, size = pages_of(content) or [], max(1, size)
    name = "page_%03d.pdf" if size == 1 else "part_%03d.pdf"
    return [(name % (k // size + 1), assembled(pages[k : k + size])) for k in range(0, len(pages), size)]


def merge(contents: list[bytes]) -> bytes | None:
    """All pages of two or more files in order; None if a file can't be read."""
    every = [pages_of(c) for c in contents]
    return assembled([p for own in every for p in own]) if len(every) >= 2 and all(every) else None


def _number(x: float) -> bytes:
    return f"{x:.4f}".rstrip("0").rstrip(".").encode()


def _box(x: float, y: float, w: float, h: float) -> bytes:
    return b"[%s]" % b" ".join(map(_number, (x, y, x + w, y + h)))


def crop(content: bytes, x: float, y: float, width: float, height: float, page: int = 1) -> bytes | None:
    """The page cropped to a box whose origin is the lower left corner, alone; 0 crops all pages."""
    pages = pages_of(content)
    if not pages or width <= 0 or height <= 0 or not 0 <= page <= len(pages):
        return None
    box = _box(x, y, width, height)
    return assembled([Page(p.objects, p.values | {b"MediaBox": box, b"CropBox": box}) for p in (pages if page == 0 else pages[page - 1 : page])])


def scale(content: bytes, width: float, height: float) -> bytes | None:
    """All pages scaled to fit a size, and centred in it."""
    pages = pages_of(content)
    if not pages or width <= 0 or height <= 0:
        return None
    before, out = [], []
    for p in pages:
        (x0, y0, _, _), (w, h) = p.box, p.size
        s = min(width / w, height / h)
        before.append(b"%s 0 0 %s %s %s cm" % tuple(map(_number, (s, s, (width - w * s) / 2 - x0 * s, (height - h * s) / 2 - y0 * s))))
        box = _box(0, 0, width, height)
        out.append(Page(p.objects, p.values | {b"MediaBox": box, b"CropBox": box}))
    return assembled(out, before)


def rotate(content: bytes, angle: int) -> bytes | None:
    """All pages turned by 90, 180 or 270 degrees; None for another angle."""
    pages = pages_of(content)
    if not pages or angle not in (90, 180, 270):
        return None
    return assembled([Page(p.objects, p.values | {b"Rotate": b"%d" % ((p.rotation + angle) % 360)}) for p in pages])


def mapped(files: DataFrame, make: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """Rows (``schema``) that ``make`` gives for each row of ``files``, inside the tasks."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([x for r in rows.to_dict("records") for x in make(r)], columns=names)

    ship(files.sparkSession)
    return files.mapInPandas(run, schema)
