"""Dictionaries of PDFs are read a key and its value at a time, and come out as step by step."""

import random
import re

import pytest

from foliant.sources import pdf_pages as p
from foliant.sources.writers import text_pdf

BITS = [b"/", b"A", b"Kids", b" ", b"\n", b"%c\n", b"<<", b">>", b"[", b"]", b"(a)", b"(a(b)c)", b"(\\)", b"<4a>", b"1 0 R", b"12", b"-1.5", b"\0", b"\v", b"/N 3 0 R", b"/B [1 0 R << /C (x) >>]", b"/D << /E << /F [ [1] ] >> >>", b">", b"<", b")"]


def read(data: bytes):
    try:
        return list(p.entries(data).items())
    except ValueError as e:
        return type(e)


def test_written_files_need_no_steps(monkeypatch):
    def fail(*_):
        raise AssertionError("read step by step")

    monkeypatch.setattr(p, "_value_end", fail)
    made = p.rotate(p.scale(text_pdf("one\ftwo"), 200, 300), 90)
    assert [(*x.size, x.rotation) for x in p.pages_of(made)] == [(200, 300, 90)] * 2


def test_as_step_by_step(monkeypatch):
    rnd = random.Random(7)
    made = [b"<< " + b"".join(rnd.choices(BITS, k=rnd.randint(1, 12))) + rnd.choice([b" >>", b">>", b""]) for _ in range(20000)]
    quick = [read(x) for x in made]
    monkeypatch.setattr(p, "_ENTRY", re.compile(rb"(?!)"), raising=False)
    assert quick == [read(x) for x in made] and sum(isinstance(x, list) for x in quick) > 1000


@pytest.mark.parametrize("size", [1, 2, 7])
def test_split_keeps_texts(size):
    parts = p.split(text_pdf("\f".join(f"page {k}" for k in range(7))), size)
    assert sum(p.page_count(x) for _, x in parts) == 7
