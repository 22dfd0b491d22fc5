"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnflow.llm.common import n_words, small, stored, table

SEED = 20
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
EPOCHS = 2
BINS = 4096


def water_fill(sources: DataFrame, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """Adds `target` to one row per source (`source_size`, `weight`).

    A source's share is level * weight, clamped at epochs * source_size; what the clamped ones can't take goes to
    the others by weight. In order of cap / weight the clamped sources come first, so the level is the first
    (budget - caps before) / (weights from here on) that the source at hand can take. Sources without words get 0.
    One row per source goes through the window, never documents.
    """
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    caps = sources.withColumn("cap", (F.lit(epochs) * F.col("source_size")).cast("double"))
    levels = caps.select(
        "*",
        ((F.lit(float(budget)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)).alias("level"),
    )
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(everything)
    return levels.select("*", level.alias("_water")).select(
        *sources.columns,
        F.when(F.col("_water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("_water") * F.col("weight"))).alias("target"),
    )


def _drawn(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("~"))))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: int = SEED, bins: int = BINS) -> DataFrame:
    """docs with `size`, `source_size`, `target` and `taken` (words the mix takes, repeats counted).

    Sources by code point, null last, get the weights in turn. A source takes floor(target / source_size) whole
    passes over its documents, then documents in a seeded order until the rest of the target is used up; the last
    one may give a part of its words. The order is cut into bins by the draw's first digits: a sum per bin finds
    the bin where the rest ends, and running sums stay inside bins, so that no source has to fit in one task.
    Repeated rows count each; a null text has size 0 and gives nothing; an empty table gives an empty result.
    Rows of one id are taken in order of size and text. Texts are counted whole. Columns of docs named size, source_size,
    target or taken are replaced, all others stay.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    row = F.struct(*[F.col(c) for c in kept]).alias("_row")  # whatever their names, they don't meet those made here
    sized = docs.select(row, "doc_id", F.col("source"), n_words(F.col("text")).alias("size"), _drawn(F.col("doc_id"), seed).alias("_draw"), F.xxhash64("text").alias("_text"))
    sized = sized.withColumn("_bin", (F.conv(F.substring("_draw", 1, 6), 16, 10).cast("long") * bins / 16**6).cast("int"))
    by_bin = stored(sized.groupBy("source", "_bin").agg(F.sum("size").alias("_words")), "mix-bins")

    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    sizes = by_bin.groupBy("source").agg(F.sum("_words").alias("source_size"))
    filled = water_fill(sizes.withColumn("weight", weight), budget, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    filled = filled.withColumn("_whole", whole)
    filled = filled.withColumn("_rest", F.floor(F.col("target") - F.col("_whole") * F.col("source_size") + F.lit(0.5)).cast("long"))

    run = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = by_bin.select("source", "_bin", "_words", F.sum("_words").over(run).alias("_upto"))
    last = (
        cum.join(filled.select(F.col("source").alias("_s"), "_rest"), F.col("source").eqNullSafe(F.col("_s")))
        .filter(F.col("_upto") > F.col("_rest"))
        .groupBy("source")
        .agg(F.min(F.struct("_bin", (F.col("_upto") - F.col("_words")).alias("before"))).alias("_edge"))
        .select(F.col("source").alias("_e"), F.col("_edge._bin").alias("_edge"), F.col("_edge.before").alias("_before"))
    )
    plan = stored(
        filled.join(last, F.col("source").eqNullSafe(F.col("_e")), "left").select(F.col("source").alias("_source"), "source_size", "target", "_whole", "_rest", F.coalesce("_edge", F.lit(bins)).alias("_edge"), F.coalesce("_before", F.lit(0)).alias("_before")),
        "mix-plan",
    )

    ahead = Window.partitionBy("source", "_bin").orderBy("_draw", "doc_id", "size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    extra = (
        F.when(F.col("_bin") < F.col("_edge"), F.col("size"))
        .when(F.col("_bin") > F.col("_edge"), F.lit(0))
        .otherwise(F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_before") - F.col("_ahead"))))
    )
    return placed.join(small(plan, 100_000), F.col("source").eqNullSafe(F.col("_source"))).select(
        "_row.*", "size", "source_size", "target", (F.col("_whole") * F.col("size") + extra).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; a part of one counts as a whole if it is half or more.

    Null and empty texts have no words to give and go. Rows that repeat one another are documents each, ties are settled as in `mix`; an empty
    table gives an empty one. All columns stay, whatever their names.
    """
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(F.lit(0)).cast("int")
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(c) for c in docs.columns]).alias("whole"))
    mixed = mix(packed, **options).select("whole", F.explode(F.when(times > 0, F.sequence(F.lit(1), times))).alias("copy"))
    return mixed.select("whole.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '~')) AS draw
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) AS k FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE k WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, (2 * source_size)::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS i FROM w
), v AS (
  SELECT arg_min(level, i) AS water FROM l WHERE level <= cap / weight
), t AS (
  SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM l CROSS JOIN v
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t
), q AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.passes, CAST(floor(r.target - r.passes * r.source_size + 0.5) AS BIGINT) AS rest,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(passes * size + least(size, greatest(0, rest - ahead)) AS BIGINT) AS taken FROM q
"""
