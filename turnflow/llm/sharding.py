"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnflow.llm.common import table

SEED = 5
SHARDS = 24
RACKS, PER_RACK = 3, 4
BINS = 1024

#: (region, rack, shard, weight)
Leaf = tuple[str, str, int, float]


def tree(shards: int, racks: int = RACKS, per_rack: int = PER_RACK, base: int = SHARDS) -> list[Leaf]:
    """Shards 0, 1, ... of weight 1: the first `base` fill racks of `per_rack` and regions of `racks`, each further one
    stands in a region of its own. From `base` on a tree of one more shard is the tree with one more region: no weight
    inside the standing regions changes, so the only rows that move are those that the new region draws."""
    home = lambda k: (f"r{k // (racks * per_rack)}", f"r{k // (racks * per_rack)}.{k // per_rack % racks}") if k < base else (f"n{k}", f"n{k}.0")
    return [(*home(k), k, 1.0) for k in range(shards)]


def grown(leaves: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard in a region and rack of its own, as `tree` adds it."""
    new = max((k for _, _, k, _ in leaves), default=-1) + 1
    return [*leaves, (f"n{new}", f"n{new}.0", new, weight)]


def _children(leaves: Sequence[Leaf]) -> dict[str, dict[str, float]]:
    under: dict[str, dict[str, float]] = {}
    for region, rack, shard, weight in leaves:
        if weight > 0:
            for top, node in (("", region), (region, rack), (rack, str(shard))):
                under.setdefault(top, {})
                under[top][node] = under[top].get(node, 0.0) + weight
    return under


def place(key: Column, leaves: Sequence[Leaf], seed: int = SEED) -> Column:
    """The shard of a key: at each level every child draws -ln(u) / weight, u from a hash of key and child, and
    the least draw wins. A child's draw depends on nothing but the key, its name and its weight: where a weight
    grows, keys move only towards it, and where it shrinks, only away from it. The tree is a parameter, not data."""
    under = _children(leaves)
    known = F.create_map(*[x for top, nodes in under.items() for x in (F.lit(top), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("w")) for n, w in nodes.items()]))])
    text = F.coalesce(key.cast("string"), F.lit("~"))

    def step(node: Column) -> Column:
        def draw(child: Column) -> Column:
            head = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), text, child["name"])), 1, 13), 16, 10).cast("double")
            return F.struct((-F.log((head + F.lit(0.5)) / F.lit(float(2**52))) / child["w"]).alias("draw"), child["name"].alias("name"))

        return F.array_min(F.transform(F.element_at(known, node), draw))["name"]

    return step(step(step(F.lit("")))).cast("int")


def shard(docs: DataFrame, leaves: Sequence[Leaf], seed: int = SEED, bins: int = BINS) -> DataFrame:
    """docs with `shard` and `slot`, a gapless number from 0 inside the shard.

    The document's id and the tree decide, so a row finds its shard alone. Slots follow a hash of id and text: rows are
    numbered inside (shard, bin of that hash) and start after the rows of the bins before, so that no shard, and no id
    on many texts, has to be sorted in one task. Rows that repeat an id go to the same shard, each with its own slot;
    rows that also repeat the text are numbered in order of their other columns. A null id is a key like any other, null
    and empty texts differ. Columns named shard or slot are replaced, all others stay.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("~"))
    text = F.xxhash64("text") if "text" in docs.columns else F.xxhash64(*[F.col(c) for c, t in docs.dtypes if "map<" not in t])
    rest = F.xxhash64(*[F.col(c) for c, t in docs.dtypes if "map<" not in t and "variant" not in t])
    placed = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row"), place(F.col("doc_id"), leaves, seed).alias("shard"), F.md5(F.concat_ws("|", F.lit("slot"), part("doc_id"), text.cast("string"))).alias("mark"), rest.alias("rest"))
    placed = placed.withColumn("bin", (F.conv(F.substring("mark", 1, 6), 16, 10).cast("long") * bins / 16**6).cast("int"))
    counts = placed.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bin").orderBy("mark", "rest")
    return placed.withColumn("nth", F.row_number().over(inside) - 1).join(starts, ["shard", "bin"]).select("row.*", "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"))
    leaves = tree(SHARDS)
    out = shard(docs, leaves).withColumn("grown_shard", place(F.col("doc_id"), grown(leaves)))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
