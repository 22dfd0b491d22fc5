from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.cases import groups, words
from turnflow.llm.common import stored


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for _, stage in P.STAGES:
        kept.append(stored(stage(spark, kept[-1], sf_dir), "test-stage"))
    first, good, single, clean, mixed, shards = kept
    for x in (good, single, clean, mixed):
        assert x.columns == first.columns
    assert set(shards.columns) == {*first.columns, "shard", "slot"}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    # quality: labelled bad documents go, labelled good ones stay
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(d in ids(good) for d, q in labels.items() if q == 1 and d in ids(first))
    # near duplicates: one of each group of what came in
    texts = {r.doc_id: r.text for r in good.collect()}
    assert ids(single) == set(groups(texts, 5, 80).values())
    # benchmark: no item is held
    grams = lambda t: {tuple(w[i : i + 5]) for w in [words((t or "").lower())] for i in range(len(w) - 4)}
    items = [grams(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaky = lambda t: any(g and len(g & grams(t)) >= 0.8 * len(g) for g in items)
    assert ids(clean) == {r.doc_id for r in single.collect() if not leaky(r.text)}
    # mix and shards
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    total = lambda df: sum(len(words(r.text)) for r in df.collect())
    assert abs(total(mixed) / total(clean) - 1.5) < 0.1
    assert shards.count() == mixed.count()
    per = shards.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    assert all(r.n == r.m + 1 == r.d for r in per)
    assert P.run(spark, sf_dir).count() == shards.count()
