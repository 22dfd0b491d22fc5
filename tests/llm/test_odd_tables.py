"""Each operator and stage over one odd table: clashing column names, repeated and null ids, texts of several MB, no rows."""

from __future__ import annotations

import random

import pytest

from turnflow.llm import alignment, cotraining, decontam, html_text, mixing, ngram_join, personal_data, quality_rules, sharding, spelling, suffix_dedup, toxicity, urls

EXTRA = "label _d _rest _source _start _h _k _t _i _row _n _s _of _words row whole k t a b c n l id mark bin nth rest start also features score kept chance margin suffix fold hit host path stops chunk pair held links times word form root half group spans".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(800)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    first = text(80)
    rows = [(i, text(70 + i), "en", "s" if i % 3 else "u", 1) for i in range(30)]
    rows += [(1, first, "en", "s", 1), (1, first, "en", "s", 1), (2, text(90), None, None, None), (40, first + " more", "en", "u", 2)]
    rows += [(None, first, "en", "s", 1), (None, text(60), "en", "s", 1), (None, None, None, None, None), (50, "", "", "", 0), (51, None, "en", "s", None)]
    rows += [(60, text(600_000), "en", "s", 3), (61, "x" * 2_000_000, "en", "s", 3)]
    return spark.createDataFrame([(*x, *["old"] * len(EXTRA)) for x in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None)], "doc_id long, label int")


def test_rows_by_row(spark, docs, labels):
    n = docs.count()
    for make in (
        lambda d: suffix_dedup.remove_repeats(d), lambda d: quality_rules.word_quality(d), lambda d: mixing.mix(d), lambda d: sharding.shard(d, sharding.tree(24)),
        lambda d: toxicity.toxicity(d, labels), lambda d: cotraining.quality_scores(d, labels), lambda d: ngram_join.groups(d), lambda d: html_text.extract_pages(d, "text"),
        lambda d: urls.judge(d.withColumn("url", d.text)), lambda d: alignment.align(d), lambda d: personal_data.personal_data(d),
    ):
        assert make(docs).count() == n
        assert make(docs.limit(0)).count() == 0


def test_words_of_odd_rows(docs):
    """A word of megabytes counts as any other; the vocabulary's words are 3 letters at most and so none counts."""
    assert spelling.variants(docs).collect() == [] == spelling.variants(docs.limit(0)).collect()
    again = docs.unionByName(docs).unionByName(docs)
    (only,) = spelling.variants(again).collect()
    assert (len(only.word), only.form, only.root, only.n, only.n_near) == (2_000_000, None, only.word, 3, 0)


def test_stages_keep_all_columns(spark, docs, labels):
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6", "x"), (2, "w7", "x"), (3, None, "x")], "item_id long, text string, _d string")
    for stage in (lambda d: cotraining.good_documents(d, labels), lambda d: ngram_join.one_of_each(d, 5, 80), lambda d: decontam.without_leaks(d, items), lambda d: mixing.mixed_documents(d)):
        out = stage(docs)
        assert out.columns == docs.columns
        assert all(getattr(r, c) == "old" for r in out.select(*EXTRA[:6]).collect() for c in EXTRA[:6])
        assert stage(docs.limit(0)).count() == 0
    out = sharding.shard(docs, sharding.tree(24))
    assert out.columns == [*docs.columns, "shard", "slot"]
    again = sharding.shard(docs.repartition(7), sharding.tree(24))
    key = lambda df: sorted((r.shard, r.slot, r.doc_id or -1, len(r.text or "")) for r in df.collect())
    assert key(out) == key(again)


def test_what_stays(docs):
    one = ngram_join.one_of_each(docs, 5, 80).collect()
    near = [r for r in one if (r.text or "").startswith(" ".join(next(x.text for x in one if x.doc_id == 1 and len(x.text.split()) == 80).split()[:80]))]
    assert len(near) == 1  # the repeated row, the longer copy and the one without id are gone
    assert sum(r.doc_id is None for r in one) == 2 and {50, 51, 60, 61} <= {r.doc_id for r in one}


def test_one_more_shard():
    """The tree of one more shard is the grown tree, at every count from the base on."""
    for n in range(sharding.SHARDS, sharding.SHARDS + 4):
        assert sharding.tree(n + 1) == sharding.grown(sharding.tree(n))
