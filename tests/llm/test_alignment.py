"""Alignment of two tokenizers beside a plain two-pointer walk over the tokens of the libraries themselves."""

from __future__ import annotations

import hashlib
import json
import os
import random
from collections import Counter

import pytest

from turnflow.llm import alignment
from turnflow.llm.alignment import BYTE_LEVEL, FOLDER, PIECES

SPECIAL = "<|endoftext|> and </s> <0x41> <s>"


@pytest.fixture(scope="module")
def tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(os.path.join(FOLDER, BYTE_LEVEL))
    first.encode_special_tokens = True
    with open(os.path.join(FOLDER, BYTE_LEVEL), encoding="utf-8") as f:
        names = {v: k for k, v in json.load(f)["model"]["vocab"].items()}
    letters = alignment.byte_letters()
    second = sentencepiece.SentencePieceProcessor(model_file=os.path.join(FOLDER, PIECES))

    def both(text):
        a = [(k, bytes(letters[c] for c in names[k])) for k in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(k, bytes([int(p[3:5], 16)]) if second.is_byte(k) else p.replace("▁", " ").encode()) for k in second.encode(text) for p in [second.id_to_piece(k)]]
        return a, b

    return both


def walked(a, b):
    """Groups and links of two rows of (id, bytes), with two pointers."""
    groups, links, i, j, end_a, end_b = [], [], 0, 0, len(a[0][1]), len(b[0][1])
    left, right = [a[0][0]], [b[0][0]]
    while True:
        links.append((a[i][0], b[j][0]))
        if end_a == end_b:
            groups.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
            i, j = i + 1, j + 1
            if i == len(a):
                return groups, links
            left, right = [a[i][0]], [b[j][0]]
            end_a, end_b = end_a + len(a[i][1]), end_b + len(b[j][1])
        elif end_a < end_b:
            i += 1
            left.append(a[i][0])
            end_a += len(a[i][1])
        else:
            j += 1
            right.append(b[j][0])
            end_b += len(b[j][1])


def brute(rows, tokens):
    walks = []
    for doc_id, text in rows:
        a, b = tokens(text) if text else ((), ())
        fits = bool(text) and b"".join(x for _, x in a) == b" " + text.encode() == b"".join(x for _, x in b)
        walks.append((doc_id, a, b, *(walked(a, b) if fits else ([], []))))
    count = Counter(p for *_, links in walks for p in set(links))
    tops = [Counter(), Counter()]
    for p, n in count.items():
        for k in (0, 1):
            tops[k][p[k]] = max(tops[k][p[k]], n)
    best = lambda links, k: sum(count[p] == tops[k][p[k]] for p in links)
    return [
        (d, len(a), len(b), len(g), len(li), best(li, 0), best(li, 1), sum(count[p] for p in li), hashlib.sha256(";".join(g).encode()).hexdigest()) if g else (d, 0, 0, 0, 0, 0, 0, 0, "")
        for d, a, b, g, li in walks
    ]


def key(rows):
    return sorted(tuple((x is None, x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def odd():
    r = random.Random(4)
    letters = "abc eé\n\t  ñ日本😀'’sd1290_-.,  \x00ﬁ①ß"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 90))) for _ in range(60)]
    texts += [None, "", " ", "   ", "\n", "a", "a  b", "x" * 3000, "a▁b", "▁", SPECIAL, "it's we'll  don't", "  lead", "trail  ", "é", "﷽" * 9]
    return [*enumerate(texts), (None, "no id"), (3, "again"), (3, "again"), (2**62 + 1, "large id")]


def test_equals_brute_force(spark, odd, tokens):
    docs = spark.createDataFrame([(*x, "old", 1) for x in odd], "doc_id long, text string, chunk string, pair int").repartition(3)
    assert key(alignment.align(docs).collect()) == key(brute(odd, tokens))
    assert key(alignment.align(docs, chunk_bytes=200).collect()) == key(brute(odd, tokens))
    assert alignment.align(docs.limit(0)).collect() == []


def test_equals_brute_force_on_documents(spark, sf_dir, tokens):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = alignment.op11_cross_tokenizer(spark, sf_dir).collect()
    assert key(out) == key(brute(rows, tokens))
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in out)


def test_long_text_in_parts(spark, tokens, monkeypatch):
    """A text of several parts gives what it gives whole, and its parts join to it."""
    r = random.Random(5)
    text = " ".join("".join(r.choice("abceé\n '") for _ in range(r.randint(0, 9))) for _ in range(3000))
    assert " ".join(alignment.slices(text, 500)) == text and len(alignment.slices(text, 500)) > 5
    rows = [(1, text), (2, text[:2000]), (3, "x" * 4000)]
    aligner = alignment.Aligner(FOLDER, BYTE_LEVEL, PIECES)
    monkeypatch.setattr(aligner, "parts", lambda t: alignment.slices(t, 500))
    chunk = alignment.Chunk(aligner)
    for doc_id, t in rows:
        chunk.open(doc_id)
        for part in aligner.parts(t):
            chunk.add([len(chunk.ids) - 1], [part])
    made = [d for batch in chunk.batches(0) for d in batch.to_pylist() if d["links"] is not None]
    whole = brute(rows, tokens)
    assert [(d["doc_id"], d["n_a"], d["n_b"], d["n_groups"], d["groups_sha256"]) for d in made] == [(*w[:4], w[-1]) for w in whole]


def test_very_long_runs(tokens):
    """Megabytes without a place to cut, white space above all, are encoded as the libraries do."""
    aligner = alignment.Aligner(FOLDER, BYTE_LEVEL, PIECES)
    for text in (" " * 1_500_000 + "x", "y" + "\n \t" * 300_000, "x" * 1_000_000, "-1" * 200_000):
        a, b, spelt = aligner.ids([text])
        want_a, want_b = tokens(text)
        assert spelt[0] and list(a[0]) == [k for k, _ in want_a] and list(b[0]) == [k for k, _ in want_b]
