"""Edit-aware token counts: a tree of pre-token counts for each document, kept up under edits.

The byte-level vocabulary splits a text into pre-tokens and merges only inside them, so a document's count
is the sum of its pre-tokens' counts. The tree's leaves hold runs of pre-tokens, its nodes the sums of
characters and tokens below them. An edit re-encodes from the last pre-token that it can't reach (a match
depends on two characters beyond its end at most) up to the first old boundary past the edit at which
the new split has a boundary too: from there on both are the same, since the pattern never looks back.

A tree is kept in a row of a table: the text, the lengths of its pre-tokens, and the sums of its leaves. The
inner nodes are sums of those. A leaf that no edit reaches is neither split nor encoded again.
"""

from __future__ import annotations

import array
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named_column, ship
from .tokens import VOCABULARY, _ranks, encode_ordinary

LEAF, FANOUT = 64, 8
#: Distinct pre-tokens whose counts a worker keeps, and characters of the longest of them.
CACHE, LONGEST_KEPT = 300_000, 200


@functools.cache
def _splitter():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


class Counter(dict):
    """Tokens of a pre-token; bounded."""

    def __init__(self, vocabulary: str):
        super().__init__()
        self.vocabulary, self.encode_word = vocabulary, _ranks(vocabulary).encode_ordinary

    def encode(self, text: str) -> array.array:
        return encode_ordinary(text, self.vocabulary)

    def __missing__(self, word: str) -> int:
        if len(word) > LONGEST_KEPT:
            return len(self.encode(word))
        if len(self) >= CACHE:
            self.clear()
        n = self[word] = len(self.encode_word(word))
        return n


class Node:
    """A leaf has no children and words, cut from the stored text when they are first needed.

    chars, tokens and size (pre-tokens) are sums over what is below.
    """

    __slots__ = ("_lengths", "_text", "_words", "chars", "children", "size", "tokens")

    def __init__(self, children: list[Node] | None, chars: int, size: int, tokens: int):
        self.children, self.chars, self.size, self.tokens = children, chars, size, tokens
        self._words = self._text = self._lengths = None

    @classmethod
    def over(cls, children: list[Node]) -> Node:
        return cls(children, sum(c.chars for c in children), sum(c.size for c in children), sum(c.tokens for c in children))

    @classmethod
    def of_words(cls, words: list[str], tokens: int) -> Node:
        out = cls(None, sum(map(len, words)), len(words), tokens)
        out._words = words
        return out

    @classmethod
    def of_text(cls, text: str, lengths: np.ndarray, tokens: int) -> Node:
        out = cls(None, len(text), len(lengths), tokens)
        out._text, out._lengths = text, lengths
        return out

    @property
    def words(self) -> list[str]:
        if self._words is None:
            at = np.cumsum(self._lengths).tolist()
            self._words = [self._text[i:j] for i, j in zip([0, *at], at, strict=False)]
        return self._words

    @property
    def text(self) -> str:
        return "".join(self._words) if self._text is None else self._text

    @property
    def lengths(self) -> np.ndarray:
        return np.fromiter(map(len, self._words), "<u4", self.size) if self._lengths is None else self._lengths


def _joined(leaves: list[Node]) -> Node:
    while len(leaves) > 1:
        leaves = [Node.over(leaves[k : k + FANOUT]) for k in range(0, len(leaves), FANOUT)]
    return leaves[0]


def build(words: list[str], count: Counter) -> Node:
    leaves = []
    for k in range(0, max(1, len(words)), LEAF):
        own = words[k : k + LEAF]
        leaves.append(Node.of_words(own, sum([count[w] for w in own])))
    return _joined(leaves)


class TokenTree:
    """The token count of a text under edits."""

    def __init__(self, text: str, count: Counter, root: Node | None = None):
        self.count, self.encoded = count, 0
        self.root = build(_splitter().findall(text), count) if root is None else root

    @classmethod
    def restored(cls, count: Counter, text: str, lengths: bytes, sizes: bytes, tokens: bytes) -> TokenTree:
        """The tree that ``stored`` gave; nothing of the text is split or encoded again."""
        lengths, sizes, tokens = (np.frombuffer(x, "<u4") for x in (lengths, sizes, tokens))
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        chars = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        leaves = [
            Node.of_text(text[i:j], lengths[s : s + n], t)
            for i, j, s, n, t in zip(chars[starts].tolist(), chars[starts + sizes].tolist(), starts.tolist(), sizes.tolist(), tokens.tolist(), strict=True)
        ]
        return cls(text, count, _joined(leaves))

    def stored(self) -> tuple[str, bytes, bytes, bytes]:
        """The text, the lengths of its pre-tokens, and how many pre-tokens and tokens each leaf holds."""
        leaves = [*self._leaves()]
        return (
            "".join(x.text for x in leaves), np.concatenate([x.lengths for x in leaves]).astype("<u4").tobytes(),
            np.array([x.size for x in leaves], "<u4").tobytes(), np.array([x.tokens for x in leaves], "<u4").tobytes(),
        )

    def _leaves(self) -> Iterator[Node]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.children is None:
                yield node
            else:
                stack += reversed(node.children)

    @property
    def tokens(self) -> int:
        return self.root.tokens

    @property
    def chars(self) -> int:
        return self.root.chars

    def _at(self, char: int) -> tuple[int, int]:
        """(number, first character) of the pre-token that holds a character; past the end, of the end."""
        node, number, start = self.root, 0, 0
        while node.children is not None:
            for child in node.children:
                if char < start + child.chars or child is node.children[-1]:
                    node = child
                    break
                number, start = number + child.size, start + child.chars
        for w in node.words:
            if char < start + len(w):
                break
            number, start = number + 1, start + len(w)
        return number, start

    def _words(self, number: int) -> Iterator[str]:
        """Pre-tokens from a number on."""
        stack = [(self.root, number)]
        while stack:
            node, skip = stack.pop()
            if node.children is None:
                yield from node.words[skip:]
                continue
            below = []
            for child in node.children:
                if skip < child.size:
                    below.append((child, skip))
                skip = max(0, skip - child.size)
            stack += reversed(below)

    def _splice(self, node: Node, i: int, j: int, words: list[str]) -> Node | None:
        """``node`` with its pre-tokens i to j replaced; None if nothing is left of it."""
        if node.children is None:
            own = node.words[:i] + words + node.words[j:]
            if not own:
                return None
            if len(own) > 2 * LEAF:
                return build(own, self.count)
            tokens = node.tokens - sum([self.count[w] for w in node.words[i:j]]) + sum([self.count[w] for w in words])
            return Node.of_words(own, tokens)
        children, at, placed = [], 0, False
        for k, child in enumerate(node.children):
            lo, hi = max(i - at, 0), min(j - at, child.size)
            here = not placed and i - at <= child.size and (i - at < child.size or k == len(node.children) - 1)
            if here or lo < hi:
                child = self._splice(child, min(lo, child.size), max(hi, min(lo, child.size)), words if here else [])
                placed |= here
                at += node.children[k].size
                if child is not None:
                    children.append(child)
            else:
                at += child.size
                children.append(child)
        return Node.over(children) if children else None

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters start to end; positions past the end mean the end."""
        start = min(max(start, 0), self.chars)
        end = min(max(end, start), self.chars)
        first, at = self._at(max(start - 2, 0))  # ends after start - 2, so the edit may reach it
        head = start - at
        old, need, take = self._words(first), end - at, 0
        # Old pre-tokens until the new split falls in with the old one.
        words: list[str] = []
        length, wanted, whole = 0, need + 64, False
        while True:
            for w in old:
                words.append(w)
                length += len(w)
                if length >= wanted:
                    break
            else:
                whole = True
            text = "".join(words)
            fresh = text[:head] + new + text[need:]
            shift = len(fresh) - len(text)
            bounds, pos = {0: 0}, 0
            for k, w in enumerate(words, 1):
                pos += len(w)
                bounds[pos] = k
            found, pos, done = [], 0, None
            for m in _splitter().finditer(fresh):
                if not whole and m.end() + 2 > len(fresh):
                    break  # more text might change this match
                found.append(m.group())
                pos = m.end()
                if pos - shift >= need and pos >= head + len(new) and pos - shift in bounds:
                    done = bounds[pos - shift]
                    break
            if done is None and whole:
                done = len(words)
            if done is not None:
                take = done
                break
            wanted *= 4
        self.encoded += len(found)
        root = self._splice(self.root, first, first + take, found)
        self.root = root if root is not None else build([], self.count)
        if self._depth() > 24:
            self.root = build([*self._words(0)], self.count)

    def _depth(self) -> int:
        node, n = self.root, 0
        while node.children is not None:
            node, n = max(node.children, key=lambda c: c.size), n + 1
        return n

    def text(self) -> str:
        return "".join(x.text for x in self._leaves())


_COUNTERS: dict[str, Counter] = {}
_KEPT = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_chars", pa.int64()), ("n_pretokens", pa.int64()), ("text", pa.string()), ("lengths", pa.binary()), ("leaf_sizes", pa.binary()), ("leaf_tokens", pa.binary())])
_EDITED = pa.schema([*_KEPT, ("n_tokens_before", pa.int64()), ("n_reencoded", pa.int64())])
#: Characters of text after which a batch is handed on.
BATCH_CHARS = 4 << 20


def _row(i: int | None, tree: TokenTree) -> tuple:
    return (i, tree.tokens, tree.chars, tree.root.size, *tree.stored())


def _mapped(row_of, vocabulary: str, schema: pa.Schema, carried: int | None = None):
    """Applies ``row_of(count, values)`` to each row's first columns; the column ``carried`` goes along as ``edits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _COUNTERS.setdefault(vocabulary, Counter(vocabulary))
        for batch in batches:
            at, rows, size = 0, [], 0
            for k in range(batch.num_rows):
                rows.append(row_of(count, [batch.column(c)[k].as_py() for c in range(batch.num_columns) if c != carried]))
                size += len(rows[-1][4])
                if size >= BATCH_CHARS or k + 1 == batch.num_rows:
                    own = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                    along = [] if carried is None else [batch.column(carried).slice(at, len(rows))]
                    yield pa.RecordBatch.from_arrays([*own, *along], [*schema.names, *(["edits"] * len(along))])
                    at, rows, size = k + 1, [], 0

    return run


def _built(count: Counter, row: list) -> tuple:
    return _row(row[0], TokenTree(row[1] or "", count))


def _changed(count: Counter, row: list) -> tuple:
    i, edits, *kept = row
    tree = TokenTree.restored(count, *kept)
    before = tree.tokens
    for e in edits or []:
        if e is not None and e["start"] is not None and e["end"] is not None:
            tree.edit(e["start"], e["end"], e["new"] or "")
    return (*_row(i, tree), before, tree.encoded)


TREES = "id long, n_tokens long, n_chars long, n_pretokens long, text string, lengths binary, leaf_sizes binary, leaf_tokens binary"
EDITS = "array<struct<start:int,end:int,new:string>>"


def token_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, edits: Column | None = None) -> DataFrame:
    """A row per row of ``docs`` that keeps its tree: id, n_tokens, n_chars, n_pretokens, text, and the tree's lengths and sums.

    Write it to keep the trees; ``edited_trees`` takes them from there. ``edits``: a column of ``docs`` that goes
    along as ``edits``. Null texts count as empty; rows without an id and repeated rows come out as they are.
    """
    ship(docs.sparkSession)
    rows = docs.select(named_column(id_col).cast("long"), named_column(text_col), *([] if edits is None else [edits.cast(EDITS)]))
    if edits is None:
        return rows.mapInArrow(_mapped(_built, vocabulary, _KEPT), TREES)
    return rows.mapInArrow(_mapped(_built, vocabulary, _KEPT, 2), f"{TREES}, edits {EDITS}")


def edited_trees(trees: DataFrame, edits: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """The trees after their edits, in the columns of ``token_trees``, with n_tokens_before and n_reencoded (pre-tokens).

    Only what an edit reaches is split and encoded again; the other leaves are taken over as they were stored.
    ``edits``: array<struct<start:int,end:int,new:string>> in order, each of the text as the one before left
    it; positions are characters, those past the end mean the end; edits with a null position are skipped, a
    null ``new`` deletes. Null edits are none. Special tokens' strings are ordinary text here.
    """
    ship(trees.sparkSession)
    rows = trees.select("id", edits.cast(EDITS), "text", "lengths", "leaf_sizes", "leaf_tokens")
    return rows.mapInArrow(_mapped(_changed, vocabulary, _EDITED), f"{TREES}, n_tokens_before long, n_reencoded long")


def counts_after_edits(docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Of each row: id, n_tokens before and after its edits, n_pretokens, n_reencoded pre-tokens, n_chars_edited, edited_crc32.

    The trees of ``token_trees`` are handed to ``edited_trees``, whose edits these are. Very long texts are
    handled whole; other columns, whatever their names, are not looked at. An empty table gives an empty table.
    """
    done = edited_trees(token_trees(docs, id_col, text_col, vocabulary, edits), F.col("edits"), vocabulary)
    return done.select(
        "id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_pretokens", "n_reencoded",
        F.col("n_chars").alias("n_chars_edited"), F.crc32(F.col("text").cast("binary")).alias("edited_crc32"),
    )
