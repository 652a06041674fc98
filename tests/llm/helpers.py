"""Fixtures and brute-force versions for the corpus operators."""

from __future__ import annotations

import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, label string, kept string, n_bytes long, toxic_score double, kept_text string, quality string"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeimnorstu") for _ in range(r.randint(2, 8))) for _ in range(n))


def cases() -> list[tuple[int | None, str | None]]:
    """Nulls, blanks, very long and very short texts, copies, near copies, repeats."""
    base = words(120, 1).split()
    near = [w if k % 60 else "changed" for k, w in enumerate(base)]
    return [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "One TWO"),
        (9, words(6000, 2)), (10, "x" * 3000), (11, "ab " * 400), (None, " ".join(base)), (12, "Zeile eins\nZeile eins\nZeile zwei über das und die"), (12, "Zeile eins\nZeile eins\nZeile zwei über das und die"),
        (13, words(40, 3) + " " + " ".join(base[20:90])), (14, "é" * 90 + " 你好 \U0001f600"), (15, " ".join(base[:119]) + " tail"), (16, words(80, 4)),
    ]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", 1, 0.5, "k", "q") for i, t in rows], SCHEMA)


def shingles(text: str | None) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_groups(rows) -> dict:
    """doc_id -> smallest id reachable, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def spans(rows) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, sha256 of what is left), string by string."""
    first: dict[bytes, int] = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)
