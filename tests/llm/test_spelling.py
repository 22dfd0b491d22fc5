"""Spelling variants beside brute force over all pairs of words."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from turnflow.llm import spelling
from turnflow.llm.spelling import Automaton, differ_by_one, padded


def brute_words(rows) -> dict[str, int]:
    count: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def brute(rows):
    words = brute_words(rows)
    gaps = defaultdict(set)  # words by all that deleting one letter leaves, and by themselves
    for w in words:
        gaps[w].add(w)
        for k in range(len(w) if len(w) < 1000 else 0):  # the one longer word has no near one
            gaps[w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for group in gaps.values():
        for a in group:
            for b in group:
                if a != b and (len(a) != len(b) or sum(x != y for x, y in zip(a, b, strict=True)) == 1):
                    if len(a) == len(b) or one_inserted(min(a, b, key=len), max(a, b, key=len)):
                        near[a].add(b)
    form = {}
    for w, n in words.items():
        top = min(near[w], key=lambda d: (-words[d], d), default=None)
        form[w] = top if top and words[top] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def one_inserted(a: str, b: str) -> bool:
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def corpus(seed: int, letters: str, n: int, kinds: int):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(3, 9))) for _ in range(kinds)]
    words += [w[:k] + r.choice(letters) + w[k + r.randint(0, 1) :] for w in words[: kinds // 2] for k in [r.randrange(len(w))]]
    weights = [1 / (1 + k % 37) for k in range(len(words))]
    return [(i, r.choice([" ", "-", "1"]).join(r.choices(words, weights, k=r.randint(0, 60)))) for i in range(n)]


def key(rows):
    return sorted(tuple(r) for r in rows)


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)


@pytest.mark.parametrize("letters, kinds, most", [("abÉ", 300, 50_000), ("abcdefgé", 900, 50_000), ("ab", 200, 3), ("abcÿ÷", 400, 1)])
def test_equals_brute_force(spark, letters, kinds, most):
    rows = corpus(len(letters), letters, 250, kinds)
    want = brute(rows)
    assert sum(w[4] for w in want) > 100 and any(w[1] for w in want)
    assert key(spelling.variants(docs_of(spark, rows), most=most, together=40 if most < 9 else spelling.TOGETHER).collect()) == want


def test_by_places(spark):
    """Halves with too many words, dealt by one place, give the same."""
    rows = corpus(8, "abcd", 200, 500)
    want = brute(rows)
    for most in (1, 5, 40):
        assert key(spelling.variants(docs_of(spark, rows), most=most, together=60).collect()) == want


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert key(spelling.op12_spelling_variants(spark, sf_dir).collect()) == brute(rows)


def test_odd_rows(spark):
    long = "xyz" * 100
    rows = [(None, "Apple apple"), (None, "APPLE applé"), (1, None), (2, ""), (3, "applé applé"), (3, "applé applé")] + [(9, "é" * 2_000_000)] * 3
    rows += [(k, f"{w} {w} {w}") for k, w in enumerate((long, long + "y", long[:-1], long[:150] + "q" + long[151:], "m" * 256, "m" * 257, "m" * 258, "m" * 255))]
    assert key(spelling.variants(docs_of(spark, rows)).collect()) == brute(rows)
    assert spelling.variants(docs_of(spark, rows).limit(0)).collect() == []
    assert spelling.variants(docs_of(spark, [(1, None)])).collect() == []


def test_chain_of_forms(spark):
    """A chain of forms of many steps ends at its last word."""
    words = ["".join("b" if k < i else "a" for k in range(12)) for i in range(13)]
    forms = spark.createDataFrame(list(zip(words[:-1], words[1:], strict=True)), "word string, form string")
    assert {(r.word, r.root) for r in spelling.roots(forms).collect()} == {(w, words[-1]) for w in words[:-1]}


def test_automaton():
    """Numbers are the places of the words, states are shared, and completion finds what pairwise comparison finds."""
    r = random.Random(2)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(900)})
    letters = np.zeros(256, np.uint8)
    letters[[97, 98, 99]] = [1, 2, 3]
    codes, sizes = padded(words, letters)
    automaton = Automaton(codes, sizes)
    for i, w in enumerate(words):
        state, number = automaton.root, 0
        for c in w:
            number += automaton.skip[state, letters[ord(c)]]
            state = automaton.next[state, letters[ord(c)]]
        assert automaton.final[state] and number == i
    assert len(automaton.final) < 0.5 * len({w[:k] for w in words for k in range(len(w) + 1)})
    for share in (0, 1, 2):
        exact = np.minimum(sizes, sizes * share // 2)
        row, number = automaton.near(codes, sizes, exact)
        got = set(zip(row.tolist(), number.tolist(), strict=True))
        assert got == {(i, j) for i, w in enumerate(words) for j, d in enumerate(words) if differ_by_one(w, d) and w[: exact[i]] == d[: exact[i]]}
