"""Monte Carlo delays along a table of paths.

Two requests for one path whose start delays lie in one bucket have the same draws, so each (path, start bucket) is
simulated once and joined back. Spark deals out this work by its cost, draws times hops, whatever its bytes; inside a task a path
is walked hop by hop on a vector of draws: bucket of each, draw of an index, value. Neither the plan nor what other paths carry grows
with the longest path. Only pools of legs in use are read. They go to the tasks whole up to `SENT_BYTES`; beyond that paths are
gathered by their first leg, a hot one in parts, and each group gets the pools of its own legs, once each: it is pools that shuffle, never draws.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnflow.constants import BUCKETS, DRAWS, LATE_BY
from turnflow.functions.numbers import PRIME, ROUNDS, delay_bucket, sorted_percentile
from turnflow.functions.stage import stored

#: Pools of up to so many bytes are sent to every task.
SENT_BYTES = 32 << 20
#: Draws times hops that a task takes, and legs of the paths that share pools, at about 20 KB a pool.
TASK_STEPS, GROUP_LEGS = 20_000_000, 2000
#: Up to so many known airports are checked as one set, which is sent to the tasks.
KNOWN_SENT = 10_000
NAMES = [b[0] for b in BUCKETS]
HIGHS = np.array([b[2] for b in BUCKETS[:-1]])
STOP = "hop int, airport string, origin string, {}, used_route_fallback boolean, used_thin_pool boolean"
KEEPS = {"draws": "draws array<int>", "turns": "draws array<int>, turned array<int>", "percentiles": ", ".join(f"{c} double" for c in ("p10", "p50", "p90", "mean", *[f"p_over_{t}" for t in LATE_BY]))}


def parse_path(text: Column) -> Column:
    """Codes between commas, arrows, hyphens and white space, in upper case."""
    return F.filter(F.split(F.upper(F.trim(text)), r"[,\->→\s]+"), lambda x: x != "")


def validate_path(paths: DataFrame, known: DataFrame, sent: int = KNOWN_SENT) -> DataFrame:
    """Adds unknown_codes and is_valid: two airports at least, all of them known. known has a row per airport, or several. What is unknown depends on a
    row's own path alone, so requests may share a path_id."""
    codes = known.select(F.col("airport").alias("code")).distinct()
    if codes.limit(sent + 1).count() <= sent:
        one = codes.agg(F.collect_set("code").alias("_known"))
        out = paths.crossJoin(F.broadcast(one)).withColumn("unknown_codes", F.array_sort(F.array_except("path", "_known"))).drop("_known")
    else:
        each = paths.select("path").distinct()
        bad = each.select("path", F.explode("path").alias("code")).join(codes, "code", "left_anti").groupBy("path").agg(F.array_sort(F.collect_set("code")).alias("_bad"))
        out = paths.join(bad, "path", "left").withColumn("unknown_codes", F.coalesce("_bad", F.array().cast("array<string>"))).select(*paths.columns, "unknown_codes")
    return out.withColumn("is_valid", (F.size("path") >= 2) & (F.size("unknown_codes") == 0))


def path_number(path: Column, bucket: Column) -> Column:
    """The number of a path and start bucket that its draws depend on; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.array_join(path, "-"), bucket)), 1, 13), 16, 10).cast("long") % PRIME


def pool_rows(dist: DataFrame, keys: tuple[str, ...], samples: str) -> DataFrame:
    """One row per key: map of bucket to struct(pool, thin)."""
    pool = F.struct(F.col(samples).alias("pool"), F.col("is_fallback").alias("thin"))
    return dist.filter(F.size(samples) > 0).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", pool))).alias("_pools"))


#: The pools of a key by number of the bucket, and which of them are blended.
Pools = tuple[list[np.ndarray], list[bool]]
NO_POOLS: Pools = ([np.zeros(0, np.int32)] * len(BUCKETS), [False] * len(BUCKETS))


def by_bucket(dist: DataFrame, keys: tuple[str, ...], samples: str) -> DataFrame:
    """One row per key: pools, an array by number of the bucket, and thin beside it."""
    own = lambda b: F.element_at("_pools", F.lit(b))
    none = F.array().cast("array<int>")
    return pool_rows(dist, keys, samples).select(
        *keys, F.array(*[F.coalesce(own(b)["pool"].cast("array<int>"), none) for b in NAMES]).alias("pools"), F.array(*[F.coalesce(own(b)["thin"], F.lit(False)) for b in NAMES]).alias("thin")
    )


def keyed_pools(rows: pa.Table, keys: tuple[str, ...]) -> dict[tuple, Pools]:
    """Pools by key, as views of the columns."""
    rows = rows.combine_chunks()
    if not rows.num_rows:
        return {}
    lists = rows["pools"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    inner = lists.flatten()
    values, ends = inner.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(inner).to_numpy())))
    n = len(BUCKETS)
    pools = ([values[ends[k] : ends[k + 1]] for k in range(n * i, n * i + n)] for i in range(rows.num_rows))
    return {key: (own, thin) for key, own, thin in zip(zip(*(rows[k].to_pylist() for k in keys), strict=True), pools, rows["thin"].to_pylist(), strict=True)}


def numbers(number: int, hop: int, step: int, n: int) -> np.ndarray:
    """`draw` of the stream of this step, for 0 .. n - 1."""
    v = (np.arange(n, dtype=np.int64) * 1000003 + (number * 7919 + hop * 613 + step * 31) % PRIME) % PRIME
    for m, s in ROUNDS:
        v = ((v ^ (v >> s)) * m) % PRIME
    return v


def resampled(bucket: np.ndarray, own: Pools, network: list[np.ndarray], u: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """For draws in these buckets (-1: none), each by one of the pool of its bucket, the key's, else the network's: new values, which there are, whether a bucket has no own pool, or a blended one."""
    value, there, fallback, thin = np.zeros(len(bucket), np.int32), np.zeros(len(bucket), bool), False, False
    for b in range(len(BUCKETS)):
        some = np.flatnonzero(bucket == b)
        if len(some):
            pool = own[0][b]
            fallback |= not len(pool)
            thin |= bool(len(pool) and own[1][b])
            pool = pool if len(pool) else network[b]
            if len(pool):
                value[some] = pool[u[some] % len(pool)]
                there[some] = True
    return value, there, fallback, thin


def in_buckets(value: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The number of each draw's bucket; -1 for a missing one."""
    return np.where(there, np.searchsorted(HIGHS, value), -1)


def edge_step(bucket: np.ndarray, pools: Pools, network: list[np.ndarray], number: int, hop: int) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """The delays after the flight to stop `hop`, of draws that departed in these buckets; see `resampled`."""
    return resampled(bucket, pools, network, numbers(number, hop, 0, len(bucket)))


def node_step(value: np.ndarray, there: np.ndarray, pools: Pools, network: list[np.ndarray], number: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """The delays after the turn at stop `hop`, of draws that arrived with these, and which there are."""
    return resampled(in_buckets(value, there), pools, network, numbers(number, hop, 1, len(value)))[:2]


def walk(path: list[str], start: int, number: int, edge: Callable[[int], Pools], node: Callable[[int], Pools], over: tuple[list, list], draws: int) -> Iterator[tuple]:
    """(hop, values, which there are, fallback, thin, values after the turn, which there are) of each stop."""
    bucket = np.full(draws, start)
    for hop in range(1, len(path)):
        value, there, fallback, thin = edge_step(bucket, edge(hop), over[0], number, hop)
        turned = node_step(value, there, node(hop), over[1], number, hop) if hop + 1 < len(path) else (value, np.zeros(draws, bool))
        yield hop, value, there, fallback, thin, *turned
        bucket = in_buckets(*turned)


def percentile(values: np.ndarray, q: float) -> float:
    """As `sorted_percentile`."""
    r = q * (len(values) - 1)
    low = int(r)
    here, after = float(values[low]), float(values[min(low + 1, len(values) - 1)])
    return here + (r - low) * (after - here)


def summary(values: np.ndarray) -> list[float]:
    v = np.sort(values)
    return [*[percentile(v, q) for q in (0.1, 0.5, 0.9)], int(v.sum(dtype=np.int64)) / len(v), *[int((v > t).sum()) / len(v) for t in LATE_BY]]


def walked(batch: pa.RecordBatch | pa.Table, edges: dict, nodes: dict, over: tuple[list, list], draws: int, keep: str) -> Iterator[pa.RecordBatch]:
    """(path, bucket_no, number) to (path, bucket_no, stops), a few at once."""
    for at in range(0, batch.num_rows, 64):
        some = batch.slice(at, 64)
        stops = []
        for path, start, number in zip(*(some.column(c).to_pylist() for c in ("path", "bucket_no", "number")), strict=True):
            edge, node = (lambda h, p=path: edges.get((p[h - 1], p[h]), NO_POOLS)), (lambda h, p=path: nodes.get((p[h],), NO_POOLS))
            rows = []
            for hop, value, there, fallback, thin, turned, still in walk(path, start, number, edge, node, over, draws):
                if keep != "percentiles":
                    told = {"draws": pa.array(value, mask=~there), "turned": pa.array(turned, mask=~still) if keep == "turns" else None}
                elif there.all():
                    told = dict(zip((c.split()[0] for c in KEEPS[keep].split(", ")), summary(value), strict=True))
                else:
                    continue
                rows.append({"hop": hop, "airport": path[hop], "origin": path[hop - 1], **told, "used_route_fallback": fallback, "used_thin_pool": thin})
            stops.append(rows)
        one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        path = one(some.column("path"))
        yield pa.record_batch([path, one(some.column("bucket_no")), stop_lists(stops, keep)], ["path", "bucket_no", "stops"])


def legs_of(work: DataFrame) -> DataFrame:
    """The legs of paths: origin, dest, and whether a turn follows at dest."""
    hop = F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("_hop")
    return work.select("*", hop).select(*work.columns, F.get("path", F.col("_hop") - 1).alias("origin"), F.get("path", F.col("_hop")).alias("dest"), (F.col("_hop") + 1 < F.size("path")).alias("turns"))


def dealt(work: DataFrame, draws: int, per_task: int = TASK_STEPS) -> DataFrame:
    """A stored table of paths in as many even parts as their draws and hops call for, and at least, while there are rows, two for each core."""
    n, hops = work.agg(F.count("*"), F.coalesce(F.sum(F.size("path") - 1), F.lit(0))).first()
    return work.repartition(max(1, min(n, max(2 * work.sparkSession.sparkContext.defaultParallelism, -(-hops * draws // per_task)))))


def pool_bytes(pools: DataFrame) -> int:
    """Bytes of stored pools, each list counted as so many numbers and a little more."""
    size = F.aggregate("pools", F.lit(200).cast("long"), lambda n, p: n + 4 * F.size(p) + 100)
    return pools.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def grouped_walk(work: DataFrame, edges: DataFrame, nodes: DataFrame, over: tuple[list, list], draws: int, keep: str, schema: str, group_legs: int) -> DataFrame:
    """Paths gathered by their first leg, of about `group_legs` legs in all, beside the pools of their legs, once for each group."""
    lead = [F.get("path", k).alias(f"_lead{k}") for k in (0, 1)]
    parts = work.groupBy(*lead).agg(F.ceil(F.sum(F.size("path") - 1) / group_legs).alias("_parts"))
    in_groups = work.select("*", *lead).join(parts, ["_lead0", "_lead1"])
    in_groups = in_groups.select("path", "bucket_no", "number", F.xxhash64("_lead0", "_lead1", F.pmod(F.xxhash64("path", "bucket_no"), F.col("_parts"))).alias("group"))
    in_groups = stored(in_groups, "path-groups")
    used = legs_of(in_groups.select("path", "group")).select("group", "origin", "dest", "turns")
    of_edges = used.select("group", "origin", "dest").distinct().join(edges, ["origin", "dest"])
    of_nodes = used.filter("turns").select("group", F.col("dest").alias("airport")).distinct().join(nodes, "airport")
    pools = of_edges.select(F.col("group").alias("of_group"), "origin", "dest", "pools", "thin").unionByName(of_nodes.select(F.col("group").alias("of_group"), F.lit(None).cast("string").alias("origin"), F.col("airport").alias("dest"), "pools", "thin"))

    def run(paths: pa.Table, own: pa.Table) -> pa.Table:
        if not paths.num_rows:
            return pa.table({"path": pa.array([], pa.list_(pa.string())), "bucket_no": pa.array([], pa.int32()), "stops": stop_lists([], keep)})
        turn = pc.is_null(own["origin"])
        edge, node = keyed_pools(own.filter(pc.invert(turn)), ("origin", "dest")), keyed_pools(own.filter(turn), ("dest",))
        return pa.Table.from_batches(list(walked(paths, edge, node, over, draws, keep)))

    return in_groups.groupBy("group").cogroup(pools.groupBy("of_group")).applyInArrow(run, schema)


def stop_lists(stops: list[list[dict]], keep: str) -> pa.Array:
    flat = [s for x in stops for s in x]
    names = ["hop", "airport", "origin", *[c.split()[0] for c in KEEPS[keep].split(", ")], "used_route_fallback", "used_thin_pool"]
    kinds = {"hop": pa.int32(), "airport": pa.string(), "origin": pa.string(), "draws": pa.list_(pa.int32()), "used_route_fallback": pa.bool_(), "used_thin_pool": pa.bool_()}
    columns = []
    for c in names:
        if c in ("draws", "turned"):
            parts = [s[c] for s in flat]
            ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(parts) if parts else pa.array([], pa.int32())))
        else:
            columns.append(pa.array([s[c] for s in flat], kinds.get(c, pa.float64())))
    ends = np.concatenate(([0], np.cumsum([len(x) for x in stops]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names))


def simulate_paths(
    paths: DataFrame, node_dist: DataFrame, edge_dist: DataFrame, network_node: DataFrame, network_edge: DataFrame, draws: int = DRAWS, keep: str = "draws", sent_bytes: int = SENT_BYTES, group_legs: int = GROUP_LEGS
) -> DataFrame:
    """paths with stops: array of (hop, airport, origin, draws or percentiles, used_route_fallback, used_thin_pool).

    keep='turns' has the draws after the turn at the stop too; keep='percentiles' has p10, p50, p90, mean and the chances of delays in place of the draws; stops of which a draw is
    missing are left out. Paths of fewer than two airports or with a start delay that no bucket holds get null stops. No turn is made
    before the first flight or after the last.
    """
    spark = paths.sparkSession
    number_of = F.create_map(*[x for i, b in enumerate(NAMES) for x in (F.lit(b), F.lit(i))])
    asked = paths.withColumn("_bucket", delay_bucket(F.col("start_delay")))
    good = F.coalesce((F.size("path") >= 2) & F.col("_bucket").isNotNull(), F.lit(False))
    work = asked.filter(good).select("path", F.col("_bucket").alias("bucket")).distinct()
    work = stored(work.select("path", F.element_at(number_of, F.col("bucket")).alias("bucket_no"), path_number(F.col("path"), F.col("bucket")).alias("number")), "path-work")
    legs = legs_of(work.select("path"))
    edges = edge_dist.join(legs.select("origin", "dest").distinct(), ["origin", "dest"], "left_semi")
    nodes = node_dist.join(legs.filter("turns").select(F.col("dest").alias("airport")).distinct(), "airport", "left_semi")
    edges, nodes = stored(by_bucket(edges, ("origin", "dest"), "arr_delay_samples"), "edge-pools"), stored(by_bucket(nodes, ("airport",), "dep_delay_samples"), "node-pools")
    over = tuple([np.array(pools.get(b) or [], np.int32) for b in NAMES] for pools in ({r["bucket"]: r[s] for r in d.select("bucket", s).collect()} for d, s in ((network_edge, "arr_delay_samples"), (network_node, "dep_delay_samples"))))
    schema = f"path array<string>, bucket_no int, stops array<struct<{', '.join(c.replace(' ', ':', 1) for c in STOP.format(KEEPS[keep]).split(', '))}>>"
    if pool_bytes(edges) + pool_bytes(nodes) <= sent_bytes:
        sent = spark.sparkContext.broadcast((keyed_pools(edges.toArrow(), ("origin", "dest")), keyed_pools(nodes.toArrow(), ("airport",))))
        found = dealt(work, draws).mapInArrow(lambda batches: (out for batch in batches for out in walked(batch, *sent.value, over, draws, keep)), schema)
    else:
        found = grouped_walk(work, edges, nodes, over, draws, keep, schema, group_legs)
    found = found.withColumnsRenamed({"path": "_path", "bucket_no": "_no"})
    # Each good request has its stops, so an inner join does, for which Spark can send the requests and leave the draws where they are.
    done = asked.filter(good).join(found, (F.col("path") == F.col("_path")) & (F.element_at(number_of, F.col("_bucket")) == F.col("_no"))).select(*paths.columns, "stops")
    return done.unionByName(asked.filter(~good).select(*paths.columns, F.lit(None).cast(done.schema["stops"].dataType).alias("stops")))


def summarize_stops(simulated: DataFrame, late_by: tuple[int, ...] = LATE_BY) -> DataFrame:
    """One row per stop: percentiles, mean, chances of more than so many minutes, flags.

    Of paths simulated with keep='percentiles' these are read from the stops, where they were made once for each path and start
    bucket, however many requests share it; of draws they are made for each request.
    """
    flat = simulated.select("path_id", F.inline("stops"))
    made = [*[f"p{q}" for q in (10, 50, 90)], "mean", *[f"p_over_{t}" for t in late_by]]
    if "draws" in flat.columns:
        flat = flat.filter("NOT exists(draws, x -> x IS NULL)").withColumn("_sorted", F.sort_array("draws"))
        n = F.size("draws")
        total = F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x)
        over = lambda t: F.size(F.filter("draws", lambda x: x > t)) / n
        values = [*[sorted_percentile(F.col("_sorted"), q / 100) for q in (10, 50, 90)], total / n, *[over(t) for t in late_by]]
        flat = flat.withColumns(dict(zip(made, values, strict=True)))
    return flat.select("path_id", "hop", "airport", "origin", *made, "used_route_fallback", "used_thin_pool")


def fan_table(simulated: DataFrame, summary: DataFrame) -> DataFrame:
    """The start and every stop of each path, in order, with a label."""
    start = simulated.filter("stops IS NOT NULL").select("path_id", F.lit(0).alias("hop"), F.get("path", 0).alias("airport"), F.col("start_delay").cast("double").alias("d"))
    first = start.select("path_id", "hop", "airport", *[F.col("d").alias(f"p{q}") for q in (10, 50, 90)], (F.col("d") > LATE_BY[0]).cast("double").alias("p_over_15"), F.lit(False).alias("used_route_fallback"))
    rest = summary.select("path_id", "hop", "airport", "p10", "p50", "p90", F.col("p_over_15"), "used_route_fallback")
    return first.union(rest).withColumn("label", F.concat(F.col("hop").cast("string"), F.lit(". "), F.col("airport")))


def fallback_hops(summary: DataFrame) -> DataFrame:
    """For each path with any, the stops that were reached through the network's pool, in order."""
    hops = summary.filter("used_route_fallback").groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("hop", "airport"))).alias("_h"))
    return hops.select("path_id", F.col("_h.airport").alias("fallback_stops"))
