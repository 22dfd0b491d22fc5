"""Benchmark decontamination by a size-partitioned MinHash containment search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.llm.common import small, stored, table, words

WIDTH = 5
SHARE = 0.8
MISS = 1e-6


def _windows(toks: Column, width: int, of) -> Column:
    """of(list of `width` neighbouring words) at each place of the array; an empty array if there are too few."""
    last = F.size(toks) - F.lit(width)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: of([F.get(toks, i + k) for k in range(width)]))


def hashed_shingles(df: DataFrame, text: str, width: int, to: str) -> DataFrame:
    """Adds `to`: the distinct hashes of the text's word shingles in ascending order."""
    toks = df.withColumn("_toks", words(F.lower(F.col(text))))
    return toks.withColumn(to, F.sort_array(F.array_distinct(_windows(F.col("_toks"), width, lambda ws: F.xxhash64(*ws))))).drop("_toks")


def exact_shingles(df: DataFrame, text: str, width: int, to: str) -> DataFrame:
    """Adds `to`: the distinct word shingles of the text, as text."""
    toks = df.withColumn("_toks", words(F.lower(F.col(text))))
    return toks.withColumn(to, F.array_distinct(_windows(F.col("_toks"), width, lambda ws: F.concat_ws(" ", *ws)))).drop("_toks")


#: From this boost on every shingle is kept.
ALL = 4


def boost_for(needed: int, miss: float = MISS) -> int:
    """The least boost with which `needed` shingles all miss a sketch with a chance below `miss`."""
    boost = 0
    # a class's largest documents have one shingle for 2^b bins
    while boost < ALL and (1 - 2.0**boost * (1 - math.exp(-1 / 2.0**boost)) * 0.98) ** needed > miss:
        boost += 1
    return boost


def sketch(df: DataFrame, hashes: str, to: str, boost: int) -> DataFrame:
    """Adds `to`: one-permutation MinHashes of the ascending `hashes` at all boosts up to `boost`, as (level, hash): the hash is in the
    sketches of the boosts from its level on.

    Documents are partitioned by size, 2^c <= size < 2^(c+1), and a class has 2^(c+1+b) bins at boost b, so that a shingle is
    the least of its bin with a chance of at least exp(-1/2^b) or so in documents of any length: a short item
    isn't drowned by a long document. The bin is the hash's leading bits, so the first hash of each run in ascending order is the
    bin's minimum, and the bins of a greater boost lie within those of a lesser one.
    """
    size_class = F.floor(F.log2(F.greatest(F.size(hashes), F.lit(1)).cast("double"))).cast("int")
    sized = df.withColumn("_class", size_class)
    bits = lambda h, b: F.call_function("shiftright", h, F.greatest(F.lit(1), F.lit(63 - b) - F.col("_class")))

    def level(h: Column, i: Column) -> Column:
        out = F.lit(ALL)
        for b in reversed(range(min(boost + 1, ALL))):
            out = F.when((i == 0) | (bits(h, b) != bits(F.get(F.col(hashes), i - 1), b)), F.lit(b)).otherwise(out)
        return F.struct(out.alias("level"), h.alias("hash"))

    return sized.withColumn(to, F.filter(F.transform(hashes, level), lambda x: x["level"] <= boost)).drop("_class")


def item_boosts(sizes: DataFrame, share: float, miss: float) -> dict[int, int]:
    """The boost of each size class of items, 2^c <= shingles < 2^(c+1), by what must be there of the class's smallest; sizes: a column _q."""
    classes = sizes.groupBy(F.floor(F.log2(F.col("_q").cast("double"))).cast("int").alias("c")).agg(F.min("_q").alias("least"))  # 31 rows at most
    return {r.c: boost_for(math.ceil(share * r.least), miss) for r in classes.collect()}


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE, miss: float = MISS, broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of each pair where the document holds at least `share` of the
    distinct lower-cased `width`-word shingles of the item. An item of fewer words is one shingle, all of it, and is
    searched for exactly among the documents' runs of as many words.

    Candidates share a hash of an item with the document's sketch; their shingles are then joined with the items' as text
    and counted, so that only shingles that items have are shuffled. Documents are cut by size as in `sketch`, and so are items: those of a
    size class search a sketch of their own, whose bins follow the shingles that must be there of the class's shortest item. An index of at most `broadcast_rows` rows is
    broadcast, else both sides shuffle; so are the ids of the candidates. Null and empty texts hold nothing and
    are found nowhere; texts are searched whole, however long. Rows that repeat a document count once; an id on several
    texts gets the greatest containment of them, by document and by item; null ids stay and count as one. Other columns of
    either table aren't read.
    """
    clean = lambda df, key: df.select(F.col(key), F.col("text").cast("string").alias("_t"))
    docs, benchmark = clean(docs, "doc_id"), clean(benchmark, "item_id").distinct()
    items = benchmark.withColumn("_n", F.size(words(F.lower(F.col("_t"))))).filter("_n > 0")
    items = stored(items.withColumn("_i", F.xxhash64("_t")), "leak-items")
    long, short = items.filter(F.col("_n") >= width), items.filter(F.col("_n") < width)

    index = stored(hashed_shingles(long, "_t", width, "_h").select(F.size("_h").alias("_q"), F.explode("_h").alias("_hash")), "leak-index")
    boosts = item_boosts(index, share, miss)
    boost_of = F.create_map(*[F.lit(x) for pair in boosts.items() for x in pair]) if boosts else F.create_map().cast("map<int,int>")
    wanted = index.groupBy("_hash").agg(F.max(F.element_at(boost_of, F.floor(F.log2(F.col("_q").cast("double"))).cast("int"))).alias("_boost"))
    # no filter stands above the arrays: it would be pushed down and their expressions evaluated once for each word
    drawn = sketch(hashed_shingles(docs, "_t", width, "_h"), "_h", "_s", max(boosts.values(), default=0))
    probes = drawn.select("doc_id", F.explode_outer("_s").alias("_p")).select("doc_id", F.col("_p.hash").alias("_hash"), F.col("_p.level").alias("_level"))
    met = probes.join(small(stored(wanted, "leak-hashes"), broadcast_rows), "_hash").filter(F.col("_level") <= F.col("_boost"))
    ids = stored(met.select(F.col("doc_id").alias("_d")).distinct(), "leak-docs")

    back = docs.join(small(ids, broadcast_rows), F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi").withColumn("_k", F.xxhash64("_t"))
    have = exact_shingles(back, "_t", width, "_have").select("doc_id", "_k", F.explode_outer("_have").alias("_shingle"))
    want = exact_shingles(long, "_t", width, "_want").select("item_id", "_i", F.size("_want").alias("n_item"), F.explode("_want").alias("_shingle"))
    met = have.join(small(stored(want, "leak-shingles"), broadcast_rows), "_shingle")
    for n in sorted(r[0] for r in short.select("_n").distinct().collect()):  # below `width`
        runs = exact_shingles(docs.withColumn("_k", F.xxhash64("_t")), "_t", n, "_have").select("doc_id", "_k", F.explode_outer("_have").alias("_shingle"))
        wanted = exact_shingles(short.filter(F.col("_n") == n), "_t", n, "_want").select("item_id", "_i", F.lit(1).alias("n_item"), F.explode("_want").alias("_shingle"))
        met = met.unionByName(runs.join(small(stored(wanted, "leak-short"), broadcast_rows), "_shingle"))
    counted = met.select("doc_id", "_k", "item_id", "_i", "n_item", "_shingle").distinct().groupBy("doc_id", "_k", "item_id", "_i").agg(F.count("*").alias("n_shared"), F.max("n_item").cast("long").alias("n_item"))
    held = counted.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(F.col("containment") >= share)
    best = held.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("_b"))
    return best.select("doc_id", "item_id", "_b.n_shared", "_b.n_item", "_b.containment")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item; all columns stay, whatever their names.

    Null and empty texts hold none and stay. Every row of an id goes if one of its texts holds an item, repeated rows and those without id
    included; an empty table, or one without items to search, keeps all rows.
    """
    bad = stored(leaks(docs, benchmark, **options).select("doc_id").distinct(), "leaky")
    return docs.join(small(bad, 2_000_000), docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH i AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), b AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM i, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)
  UNION ALL SELECT item_id, array_to_string(w, ' ') FROM i WHERE len(w) BETWEEN 1 AND 4
), n AS (
  SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id
), t AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents
), d AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM t, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)
  UNION SELECT doc_id, array_to_string(w[k:k+z-1], ' ') FROM (SELECT doc_id, w, z FROM t, (SELECT DISTINCT len(w) AS z FROM i WHERE len(w) BETWEEN 1 AND 4)), LATERAL (SELECT unnest(range(1, len(w) - z + 2)) AS k)
), m AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_item AS BIGINT) AS n_item, n_shared::DOUBLE / n_item::DOUBLE AS containment
FROM m JOIN n USING (item_id) WHERE n_shared::DOUBLE / n_item::DOUBLE >= 0.8
"""
