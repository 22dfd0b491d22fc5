from __future__ import annotations

import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnflow.llm import quality_rules as Q
from turnflow.llm import word_model as W

SCHEMA = "doc_id long, text string, lang string"


def brute_kn(pairs):
    """Interpolated modified Kneser-Ney over (context, word) pairs, from the definition; one more word than were seen has a weight."""
    count = Counter(pairs)
    after = Counter(w for _, w in count)

    def discounts(c):
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        return [max(0.1, min(k - 0.1, k - (k + 1) * y * b / a)) if a and b else 0.5 + 0.25 * (k - 1) for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]

    d2, d1 = discounts(count), discounts(after)

    def p(context, word):
        flat = 1 / (len(after) + 1)
        low = flat
        if after:
            low = (after[word] - d1[min(after[word], 3) - 1] if after[word] else 0) / sum(after.values()) + sum(d1[min(v, 3) - 1] for v in after.values()) / sum(after.values()) * flat
        same = {w: v for (c, w), v in count.items() if c == context}
        if not same:
            return low
        total = sum(same.values())
        return (same[word] - d2[min(same[word], 3) - 1] if word in same else 0) / total + sum(d2[min(v, 3) - 1] for v in same.values()) / total * low

    return p


@pytest.mark.parametrize(("buckets", "hot", "together"), [(3, 256, 3_000_000), (5, 6, 40), (60, 2, 3_000_000)])
def test_other_fold_scores(spark, monkeypatch, buckets, hot, together):
    """Every score from the definition: with few and many buckets, with common words spread, with several chunks to a batch."""
    monkeypatch.setattr(W, "HOT", hot)
    monkeypatch.setattr(W, "TOGETHER", together)
    r = random.Random(3)
    texts = [" ".join(r.choice("a b c d e f g aa bb".split()) for _ in range(r.randint(2, 30))) for _ in range(24)] + ["one", None]
    texts.append(texts[0])
    langs = ["en" if i % 4 else "fr" for i in range(26)] + ["fr"]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    rows += [(0, texts[0], "fr"), (1, texts[2], "en")]  # a repeated row, an id on two texts
    df = spark.createDataFrame(rows, SCHEMA)
    numbers = {"en": 7, "fr": 8}
    batch = pa.record_batch([pa.array([numbers[x[2]] for x in rows]), pa.array([x[1] or "" for x in rows])], ["l", "text"])
    pairs, fold = [[] for _ in rows], {}
    for places, folds, doc, context, word in W.coded(batch):
        fold |= dict(zip(places.tolist(), folds.tolist(), strict=True))
        for d, c, w in zip(doc.tolist(), context.tolist(), word.tolist(), strict=True):
            pairs[d].append((c, w))
    assert [len(x) for x in pairs] == [max(0, len((x[1] or "").split()) - 1) for x in rows] and set(fold.values()) == {0, 1} and fold[26] == fold[0]
    models = {(lang, f): brute_kn([q for i, x in enumerate(rows) if x[2] == lang and fold[i] == f for q in pairs[i]]) for lang in numbers for f in (0, 1)}
    want = sorted((x[0], len((x[1] or "").split()), -sum(math.log(models[x[2], 1 - fold[i]](*q)) for q in pairs[i]) / len(pairs[i]) if pairs[i] else -1) for i, x in enumerate(rows))
    numbered = df.withColumn("l", F.when(F.col("lang") == "en", 7).otherwise(8).cast("long")).selectExpr("xxhash64(text, lang) AS row", "xxhash64(doc_id, text) AS also", "l", "coalesce(text, '') AS text", "doc_id")
    means = W.log_means(numbered.drop("doc_id").repartition(3), buckets)
    got = sorted((x.doc_id, len(x.text.split()), -x.log_mean if x.log_mean is not None else -1) for x in numbered.join(means, ["row", "also"], "left").collect())
    assert len(got) == len(want)
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 for a, b in zip(got, want, strict=True))


def test_contexts_are_whole_words(spark, monkeypatch):
    """Scores from the words themselves: no two of 600 contexts share counts, be their words common, frequent or rare."""
    monkeypatch.setattr(W, "HOT", 20)
    monkeypatch.setattr(W, "FREQUENT", 200)
    r = random.Random(11)
    rows = [(i, " ".join(f"w{int(600 * r.random() ** 3)}" for _ in range(40)), "en" if i % 5 else "de") for i in range(70)]
    words = [x[1].split() for x in rows]
    seen = Counter(w for x in words for w in x)
    assert len(seen) > 400 and seen["w0"] * 20 > 70 * 40 > seen["w5"] * 40 and seen["w5"] * 200 > 70 * 40 > 1000 * min(seen.values())
    batch = pa.record_batch([pa.array([len(x[2]) + (x[2] == "en") for x in rows]), pa.array([x[1] for x in rows])], ["l", "text"])
    fold = {i: f for places, folds, *_ in W.coded(batch) for i, f in zip(places.tolist(), folds.tolist(), strict=True)}
    pairs = [list(zip(x, x[1:], strict=False)) for x in words]
    models = {(lang, f): brute_kn([q for i, x in enumerate(rows) if x[2] == lang and fold[i] == f for q in pairs[i]]) for lang in ("en", "de") for f in (0, 1)}
    want = {x[0]: sum(math.log(models[x[2], 1 - fold[i]](*q)) for q in pairs[i]) / len(pairs[i]) for i, x in enumerate(rows)}
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id AS row", "0L AS also", "CASE lang WHEN 'en' THEN 3L ELSE 2L END AS l", "text").repartition(3)
    got = {x.row: x.log_mean for x in W.log_means(df, 7).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_pairs_sorted_in_parts(monkeypatch):
    """A pair and its document may be too wide for one number."""
    monkeypatch.setattr(W, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 2)))
    r = random.Random(5)
    texts = [" ".join(r.choice("a b c d e f g aa bb".split()) for _ in range(r.randint(0, 30))) for _ in range(24)]
    numbers = pa.array(range(24))
    batch = pa.record_batch([numbers, numbers, pa.array([7 + i % 2 for i in range(24)]), pa.array(texts)], ["row", "also", "l", "text"])
    seen = np.unique(np.concatenate([word for *_, word in W.coded(batch)]))
    known = SimpleNamespace(value=W.Frequent(seen[::2], 3))
    for with_docs in (False, True):
        monkeypatch.setattr(W, "NUMBER", 63)
        want = [x.to_pylist() for x in W.pairs_of(known, 5, with_docs)([batch])]
        monkeypatch.setattr(W, "NUMBER", 0)
        assert [x.to_pylist() for x in W.pairs_of(known, 5, with_docs)([batch])] == want and want


def test_numbers_as_bytes():
    r = random.Random(2)
    x = np.array([r.getrandbits(r.randint(0, 50)) for _ in range(500)] + [0, 127, 128], np.int64)
    assert W.from_varints(W.varints(x)).tolist() == x.tolist() and W.from_varints(b"").tolist() == []
    assert [y.tolist() for y in W.unpacked(W.packed(x, x[:0], x[:3]))] == [x.tolist(), [], x[:3].tolist()]
    assert W.from_bits(W.bits_of(x % 13, 4), len(x), 4).tolist() == (x % 13).tolist()


def test_bands_and_verdicts(spark, sf_dir):
    """Quartiles, bands and verdicts of the query from its own counts and perplexities."""
    got = Q.op2_quality_rules(spark, sf_dir).collect()
    for lang in {x.lang for x in got}:
        mine = [x for x in got if x.lang == lang]
        known = np.array([x.log_perplexity for x in mine if x.log_perplexity is not None])
        q1, q3 = np.percentile(known, [25, 75])
        span = max(q3 - q1, 0.01)
        low, high = q1 - Q.FENCES[0] * span, q3 + Q.FENCES[1] * span
        for x in mine:
            assert math.isclose(x.band_low, low, abs_tol=1e-9) and math.isclose(x.band_high, high, abs_tol=1e-9)
            assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
            assert x.kept == (not x.base_failed and (x.log_perplexity is None or low - 1e-9 <= x.log_perplexity <= high + 1e-9))
    assert any(not x.kept and not x.base_failed for x in got)
    assert Q.word_quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bands_reject_on_both_sides(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    usual = [int(400 * r.random() ** 2) for _ in range(20000)]
    rows = [(i, " ".join(vocab[r.choice(usual)] for _ in range(80)), "en") for i in range(120)]
    strange = [(500 + i, " ".join(f"{r.choice(vocab)}{r.choice('#*%')}{r.randrange(10**6)}" for _ in range(60)), "en") for i in range(3)]
    dull = [(600 + i, " ".join(r.choice(vocab[:14]) for _ in range(60)), "en") for i in range(3)]
    got = {x.doc_id: x for x in Q.word_quality(spark.createDataFrame([*rows, *strange, *dull], SCHEMA)).collect()}
    assert all(got[i].log_perplexity > got[i].band_high and not got[i].base_failed and not got[i].kept for i, *_ in strange)
    low = [got[i] for i, *_ in dull]
    assert all(x.log_perplexity < x.band_low and not x.kept for x in low) and not any(x.base_failed for x in low)
    assert sum(got[i].kept for i, *_ in rows) > 110
