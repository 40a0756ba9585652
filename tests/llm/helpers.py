"""Small documents with what operators must bear: nulls, empties, ties, repeats, long texts, clashing extra columns."""

from __future__ import annotations

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, score string, name string, kept string, n_lines string, fp string, component string, key string, sha string, start string"
EXTRA = len(DDL.split(",")) - 5


def prose(rng: random.Random, n: int) -> str:
    parts = ["the", "er", "ing", "tion", "an", "ed", "on", "re", "st", "ly", "ou", "ä", "ß"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def texts(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(3, 200)) for _ in range(n // 3)]
    rows: list[tuple[int | None, str | None]] = []
    for k in range(n):
        t = base[k % len(base)] if k % 4 else prose(rng, 40)
        if k % 7 == 0:
            t = t.upper()
        if k % 9 == 0:
            words = t.split()
            words[len(words) // 2] = "changed"
            t = " ".join(words)
        if k % 5 == 0:
            t = f"{t}\nAll rights reserved.\n  all RIGHTS reserved.\t\n{k}"
        rows.append((k + 1, t))
    rows += [(1001, None), (1002, ""), (1003, "   "), (1004, "\n\n"), (None, "no id at all here"), (None, None), (1005, "x"), (1006, "Ä ä"), (1007, "ä ä")]
    rows += [(2000, "repeated row with some words"), (2000, "repeated row with some words"), (2001, "same id first text"), (2001, "same id second text")]
    rows.append((3000, prose(rng, 6000)))
    rows.append((3001, "a" * 40000))
    rows.append((3002, "A" * 40000))
    return rows


def frame(spark, rows, parts: int = 3):
    data = [(i, t, "en", "src0", len(t or ""), *[f"clash{k}" for k in range(EXTRA)]) for i, t in rows]
    return spark.createDataFrame(data, DDL).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], DDL)


def normal(t: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def partition_of(pairs):
    """Sets of keys with equal values."""
    out: dict = {}
    for k, v in pairs:
        out.setdefault(v, set()).add(k)
    return sorted(map(sorted, out.values()))
