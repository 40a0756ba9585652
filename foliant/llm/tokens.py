"""Token ids of the public byte-level vocabulary, as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import array
import base64
import functools
import re
import sys
from collections.abc import Iterator

VOCABULARY = "byte_bpe_50k"
END_TEXT = "<|endoftext|>"


def vocabulary_path(name: str) -> str:
    """Where a file of the public vocabularies is; they are read in place, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _ranks(name: str):
    """The vocabulary as ranks of byte strings: the same ids as the tokenizers file, at some three times its speed."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _tokenizer(name: str, special: bool):
    """``special``: whether a special token's string in a text is that token."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(vocabulary_path(f"{name}.json"))
    out.encode_special_tokens = not special
    return out


#: Blanks as the splitting pattern has them, in runs so long that its look-ahead would overflow the ranks' regex engine.
LONG_BLANKS = 50_000
_BLANK_RUN = re.compile(f"[\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{{{LONG_BLANKS},}}")


def _parts(text: str) -> Iterator[tuple[bool, str]]:
    """(whether it is a long run of blanks, part): cut where the pattern cuts whatever stands around.

    A run of blanks is one pre-token but for its last character, which goes with what follows.
    """
    at = 0
    if len(text) >= LONG_BLANKS:
        for m in _BLANK_RUN.finditer(text):
            end = m.end() - (m.end() < len(text))
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, text[m.start() : end]
            at = end
    if at < len(text):
        yield False, text[at:]


def encode_ordinary(text: str, name: str = VOCABULARY) -> array.array:
    """Ids of ``text`` as tokenizers gives them where special tokens' strings are ordinary text."""
    out = array.array("I")
    for blank, part in _parts(text):
        out.extend(_tokenizer(name, False).encode(part, add_special_tokens=False).ids if blank else _ranks(name).encode_ordinary(part))
    return out


def encode(text: str, name: str = VOCABULARY) -> array.array:
    """Ids of ``text`` as tokenizers gives them with add_special_tokens=False.

    A text that holds a special token's string goes through tokenizers itself, which maps that string to one id.
    """
    if END_TEXT in text:
        return array.array("I", _tokenizer(name, True).encode(text, add_special_tokens=False).ids)
    return encode_ordinary(text, name)


def as_bytes(ids: array.array) -> bytes:
    if sys.byteorder != "little":
        ids = array.array("I", ids)
        ids.byteswap()
    return ids.tobytes()
