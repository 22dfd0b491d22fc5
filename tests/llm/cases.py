"""A small corpus with copies, near copies, shared passages and all sorts of odd rows, and plain brute force."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, score string, _h int"


def corpus(n: int = 60, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = text(40)
    docs = [text(r.randint(20, 120)) for _ in range(n)]
    for i in range(0, n, 6):
        docs[i] = docs[i] + "\n" + passage + "\n" + text(10)
    for i in range(1, n, 7):
        docs[i] = docs[i - 1]
    for i in range(3, n, 9):
        w = docs[i - 1].split(" ")
        w[len(w) // 2] = "changed"
        docs[i] = " ".join(w)
    docs[5] = "x" * 400
    docs[6] = "ab" * 350
    docs[7], docs[8], docs[9], docs[10] = "", " \n\t ", "one", "Two words"
    docs[11] = "two WORDS"
    docs[12] = docs[13] = (text(4000) + "\n" + passage) * 2
    rows = [(i, t, r.choice(["en", "fr", None, ""]), r.choice(["a", "b", "b", "b", None]), len(t), "s", "x", "y", i) for i, t in enumerate(docs)]
    return [*rows, (n, None, "en", "a", None, None, None, None, None), (n + 1, docs[20].replace(" ", "  "), None, None, 3, None, None, None, None)]


def words(t: str | None) -> list[str]:
    return WORD.findall(t or "")


def lower(t: str | None) -> str:
    return (t or "").translate({k: k + 32 for k in range(65, 91)})


def shingles(t: str | None, width: int) -> frozenset:
    w = words(lower(t))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def groups(texts: dict[int, str | None], width: int, percent: int) -> dict[int, int]:
    sets = {i: shingles(t, width) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}
