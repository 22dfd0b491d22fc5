"""Bucketed delay distributions: counts and capped, reproducible samples per key, with the network's pool where thin.

A sample is the `cap` rows with the least MD5 of seed and flight. The least rows of a union are the least of
the parts' least rows, and counts add up: so each task sends on the counts and least rows of its own part (`least_rows`), one exchange by key merges
them, and the network's pools are merged from the keys' samples, of `cap` rows each. No task sorts a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnflow.constants import POOL_CAP, POOL_SAMPLES, SAMPLE_SEED
from turnflow.functions.numbers import bucket_bounds, delay_bucket
from turnflow.functions.stage import stored
from turnflow.operators.stats import turn_legs

NODE, EDGE = ("airport",), ("origin", "dest")
#: Rows that a task holds before it leaves out all but the least, and, if that doesn't help, passes them on.
HELD = 200_000


def sample_key(seed: str = SAMPLE_SEED) -> Column:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("~"))
    return F.md5(F.concat_ws("|", F.lit(seed), *[part(c) for c in ("Tail_Number", "flight_number", "FlightDate", "Origin", "Dest")]))


def node_universe(propagation: DataFrame) -> DataFrame:
    """airport, bucket of the arrival before the turn, departure delay after it."""
    legs = turn_legs(propagation)
    return legs.select(F.col("prev_dest").alias("airport"), delay_bucket(F.col("prev_arr_delay")).alias("bucket"), F.col("DepDelayMinutes").alias("value"), sample_key().alias("order"))


def edge_universe(propagation: DataFrame) -> DataFrame:
    """origin, dest, bucket of the departure delay, arrival delay."""
    return propagation.select(F.col("Origin").alias("origin"), F.col("Dest").alias("dest"), delay_bucket(F.col("DepDelayMinutes")).alias("bucket"), F.col("ArrDelayMinutes").alias("value"), sample_key().alias("order"))


def capped_sample(universe: DataFrame, keys: Sequence[str], cap: int = POOL_CAP) -> DataFrame:
    """At most `cap` rows of each key and bucket, as (keys, bucket, order, value); null values are left out."""
    usable = universe.filter("bucket IS NOT NULL AND value IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("order", "value"))
    return usable.withColumn("_n", rank).filter(F.col("_n") <= cap).select(*keys, "bucket", "order", F.round("value").cast("int").alias("value"))


def sizes(universe: DataFrame, keys: Sequence[str]) -> DataFrame:
    return universe.filter("bucket IS NOT NULL AND value IS NOT NULL").groupBy(*keys, "bucket").agg(F.count("*").alias("sample_size"))


def _places(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Of a table sorted by the columns, where a new group of them begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in names:
        codes = table[name].combine_chunks().dictionary_encode()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _least(rows: pa.Table, group: Sequence[str], cap: int) -> pa.Table:
    """Of each group the `cap` rows of least order."""
    rows = rows.sort_by([(c, "ascending") for c in (*group, "order", "value")])
    new = _places(rows, group)
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return rows.filter(pa.array(np.arange(len(new)) - start < cap))


def _partials(group: Sequence[str], cap: int, held: int) -> Callable:
    """Batches of (group, order, value) to rows of the same with n null, and one row with n for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, counts, room = [], [], held

        def out(table: pa.Table, like: pa.Schema) -> list[pa.RecordBatch]:
            """Columns that the table lacks are null."""
            columns = [table[f.name] if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in like]
            n = table["n"] if "n" in table.column_names else pa.nulls(table.num_rows, pa.int64())
            return pa.table([*columns, n], pa.schema([*[pa.field(f.name, f.type) for f in like], pa.field("n", pa.int64())])).to_batches(10_000)

        def total() -> pa.Table:
            return pa.concat_tables(counts).group_by(list(group)).aggregate([("n", "sum")]).rename_columns([*group, "n"])

        for batch in batches:
            some = pa.Table.from_batches([batch])
            rows.append(some)
            counts.append(some.group_by(list(group)).aggregate([([], "count_all")]).rename_columns([*group, "n"]))
            if sum(t.num_rows for t in rows) > room:
                rows = [_least(pa.concat_tables(rows), group, cap)]
                room = max(held, 2 * rows[0].num_rows)
                if rows[0].num_rows > held:
                    yield from out(rows[0], batch.schema)
                    rows, room = [], held
            if sum(t.num_rows for t in counts) > held:
                counts = [total()]
                if counts[0].num_rows > held // 2:
                    yield from out(counts[0], batch.schema)
                    counts = []
        if rows:
            yield from out(_least(pa.concat_tables(rows), group, cap), batch.schema)
        if counts:
            yield from out(total(), batch.schema)

    return run


def least_rows(universe: DataFrame, keys: Sequence[str], cap: int = POOL_CAP, held: int = HELD) -> DataFrame:
    """As `capped_sample`, with the number of all rows of the key and bucket beside each row, as `sizes` has it: both from one pass and one
    exchange, of at most `cap` rows and a count for each key, bucket and task."""
    group = [*keys, "bucket"]
    usable = universe.filter("bucket IS NOT NULL AND value IS NOT NULL").select(*group, "order", F.col("value").cast("double").alias("value"))
    schema = ", ".join(f"{c} {t}" for c, t in usable.dtypes) + ", n long"
    parts = usable.mapInArrow(_partials(group, cap, held), schema)
    w = Window.partitionBy(*group)
    rank = F.row_number().over(w.orderBy(F.col("n").isNotNull(), "order", "value"))
    merged = parts.select("*", F.sum("n").over(w).alias("sample_size"), rank.alias("_rank")).filter((F.col("_rank") <= cap) & F.col("n").isNull())
    return merged.select(*group, "order", F.round("value").cast("int").alias("value"), "sample_size")


def network_dist(sample: DataFrame, counts: DataFrame, samples: str, cap: int = POOL_CAP) -> DataFrame:
    """One row per bucket, from the keys' samples and counts; a bucket without rows has size 0 and a null pool."""
    least = capped_sample(sample, [], cap).groupBy("bucket").agg(F.sort_array(F.collect_list("value")).alias(samples))
    total = counts.groupBy("bucket").agg(F.sum("sample_size").alias("network_sample_size"))
    bounds = bucket_bounds(sample.sparkSession)
    out = bounds.join(F.broadcast(total), "bucket", "left").join(F.broadcast(least), "bucket", "left")
    return out.select("bucket", "bucket_low", "bucket_high", F.coalesce("network_sample_size", F.lit(0)).alias("network_sample_size"), samples)


def key_dist(known: DataFrame, pools: DataFrame, network: DataFrame, keys: Sequence[str], samples: str, size: str, enough: int = POOL_SAMPLES) -> DataFrame:
    """All known keys x buckets: the key's own pool from `enough` samples on, else the network's."""
    grid = known.select(*keys).distinct().crossJoin(F.broadcast(network.withColumnRenamed(samples, "_network")))  # five rows
    n = F.coalesce(F.col("sample_size"), F.lit(0))
    return grid.join(pools, [*keys, "bucket"], "left").select(
        *keys, "bucket", "bucket_low", "bucket_high", n.alias(size), (n < enough).alias("is_fallback"), F.when(n >= enough, F.col("_own")).otherwise(F.col("_network")).alias(samples)
    )


class Dists:
    """The distributions of one universe, over all keys and by key, from one stored table of its counts and least rows."""

    def __init__(self, universe: DataFrame, keys: Sequence[str], samples: str, size: str, cap: int = POOL_CAP):
        self.keys, self.samples, self.size, self.cap = keys, samples, size, cap
        self.rows = stored(least_rows(universe, keys, cap), f"{'-'.join(keys)}-samples")

    @property
    def pools(self) -> DataFrame:
        """Of each key and bucket its sample, sorted, and the number of its rows."""
        return self.rows.groupBy(*self.keys, "bucket").agg(F.sort_array(F.collect_list("value")).alias("_own"), F.max("sample_size").alias("sample_size"))

    @property
    def network(self) -> DataFrame:
        return network_dist(self.rows, self.pools, self.samples, self.cap)

    def by_key(self, known: DataFrame, enough: int = POOL_SAMPLES) -> DataFrame:
        return key_dist(known, self.pools, self.network, self.keys, self.samples, self.size, enough)


def node_dists(propagation: DataFrame) -> Dists:
    return Dists(node_universe(propagation), NODE, "dep_delay_samples", "airport_sample_size")


def edge_dists(propagation: DataFrame) -> Dists:
    return Dists(edge_universe(propagation), EDGE, "arr_delay_samples", "route_sample_size")


def network_node_dist(propagation: DataFrame) -> DataFrame:
    return node_dists(propagation).network


def node_dist(propagation: DataFrame, stats: DataFrame) -> DataFrame:
    return node_dists(propagation).by_key(stats)


def network_edge_dist(propagation: DataFrame) -> DataFrame:
    return edge_dists(propagation).network


def edge_dist(propagation: DataFrame, stats: DataFrame) -> DataFrame:
    return edge_dists(propagation).by_key(stats)


def fallback_rates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    per = lambda df, kind: df.groupBy("bucket").agg(F.avg(F.col("is_fallback").cast("int")).alias("fallback_rate"), F.count("*").alias("combos")).select(F.lit(kind).alias("kind"), "bucket", "fallback_rate", "combos")
    return per(nodes, "node").union(per(edges, "edge"))


def sample_fidelity(universe: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and median of each key's sample beside those of all its rows."""
    whole = universe.filter("bucket IS NOT NULL AND value IS NOT NULL").groupBy(*keys, "bucket").agg(F.count("*").alias("full_size"), F.avg("value").alias("full_mean"), F.percentile("value", 0.5).alias("full_median"))
    part = capped_sample(universe, keys).groupBy(*keys, "bucket").agg(F.count("*").alias("sample_size"), F.avg("value").alias("sample_mean"), F.percentile("value", 0.5).alias("sample_median"))
    return whole.join(part, [*keys, "bucket"])
