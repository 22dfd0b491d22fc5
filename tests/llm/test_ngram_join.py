from __future__ import annotations

import random

import pytest

from tests.llm.cases import SCHEMA, corpus, groups, shingles
from turnflow.llm import ngram_join as N
from turnflow.llm.components import components


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(("width", "percent", "few", "in_batch"), [(4, 85, 24, 16), (5, 80, 2, 3)])
def test_equals_brute_force(spark, width, percent, few, in_batch):
    rows = corpus(60)
    texts = {r[0]: r[1] for r in rows}
    want = groups(texts, width, percent)
    got = result(N.groups(spark.createDataFrame(rows, SCHEMA).repartition(4), width, percent, few=few, in_batch=in_batch))
    assert got == {i: (len(shingles(t, width)), want[i]) for i, t in texts.items()}


def test_group_of_near_copies(spark):
    """Copies that are like their model but not like each other, and some that only reach it through others."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 70):
        w = list(base if i % 5 else rows[r.randrange(len(rows))][1].split(" "))
        for _ in range(r.randint(1, 6)):
            w[r.randrange(120)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    texts = dict(rows)
    want = groups(texts, 4, 85)
    assert 2 < len(set(want.values())) < 60
    got = result(N.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), few=4, in_batch=4))
    assert {i: c for i, (_, c) in got.items()} == want


def test_odd_tables(spark):
    schema = "doc_id long, text string, n int, prefix string"
    assert N.groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e", 1, "x"), (3, "A B  C D\tE", 1, "x"), (4, "", 1, "x"), (5, None, 1, "x"), (6, "a b", 1, "x"), (7, "a\nb", 1, "x"), (7, "a\nb", 1, "x")]
    got = N.groups(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 2, 3), (3, 2, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (7, 1, 6)]
    kept = N.one_of_each(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "n", "prefix"]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [3, 4, 5, 6]
    # rows without id: copies of one another go, other texts stay, and so does the one row of a repeated document
    rows = [(None, "p q r s t", 1, "x"), (None, "p q  r s t", 2, "x"), (None, "other words stand in here", 3, "x"), (None, None, 4, "x"), (8, "u v w x y", 5, "x"), (8, "u v w x y", 6, "x"), (8, "quite another text of that id", 7, "x")]
    kept = N.one_of_each(spark.createDataFrame(rows, schema)).collect()
    assert len(kept) == 5 and sum(r.doc_id == 8 for r in kept) == 2 and sum(r.n in (1, 2) for r in kept) == 1 and {3, 4, 7} <= {r.n for r in kept}
    alone = {r.n_shingles: r.component_id for r in N.groups(spark.createDataFrame(rows[:4], schema)).collect()}
    assert alone == {2: None, 0: None}


def test_repeated_ids(spark):
    """Repeated rows count once; an id on two texts has a set for each and ties their groups together."""
    a = [f"w{i}" for i in range(103)]
    b = [*a[:70], *[f"v{i}" for i in range(33)]]  # 67 of 100 n-grams each in common
    long = [f"x{i}" for i in range(300)]
    short = [f"y{i}" for i in range(60)]
    rows = [(1, a), (1, a), (2, b), (2, b), (3, short), (3, long), (4, [*short[:-1], "other"]), (5, [*long[:-1], "other"]), (6, [*short[:-2], "z", "z"])]
    rows = [(i, " ".join(t)) for i, t in rows]
    for few in (24, 2):
        got = N.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), few=few, in_batch=2).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 2), (2, 2), (3, 3), (3, 3), (4, 3), (5, 3), (6, 3)]


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(30)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    up = {x: x for p in links for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {n: c for n, c in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_many_under_one_gram(spark):
    """A passage that unrelated documents share, with near copies among them; blocks of few members meet as large ones do."""
    r = random.Random(11)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(90):
        if i % 3:
            rows.append((i, [*passage, *[f"t{r.randrange(8)}" for _ in range(r.randint(1, 9))]]))
        else:
            words = list(rows[r.randrange(len(rows))][1] if rows else passage)
            words[r.randrange(len(words))] = f"z{i}"
            rows.append((i, words))
    texts = {i: " ".join(w) for i, w in rows}
    want = groups(texts, 4, 85)
    assert 5 < len(set(want.values())) < 60
    for block in (3, 1024):
        got = result(N.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), few=4, in_batch=4, block=block))
        assert {i: c for i, (_, c) in got.items()} == want
