"""The jobs: read, compose, write. Each derived table is rebuilt as a whole and can be run again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from turnflow.constants import CARRIERS, DRAWS, ROTATIONS
from turnflow.functions.stage import stage_scope, stored
from turnflow.operators import airports as A
from turnflow.operators import backtest as B
from turnflow.operators import distributions as D
from turnflow.operators import enrich, rotation, serving, stats
from turnflow.operators import simulate as M
from turnflow.sources.ledger import Load, load_files
from turnflow.sources.ontime import read_airport_reference
from turnflow.sources.tables import export_bundle, rebuild_table, require_tables


def utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """df, and what it counts of itself while it is written."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in counts.items()]), seen


def report(spark: SparkSession, schema: str, counts: dict) -> DataFrame:
    """One row of counts, by the names of the schema."""
    return spark.createDataFrame([tuple(counts[c.split()[0]] for c in schema.split(", "))], schema)


def ingest(spark: SparkSession, raw: str | list[str], reference: str, folder: str, carriers: Sequence[str] = CARRIERS, again: str = "skip") -> Load:
    """Airport table, and the months of `raw` that aren't there yet; see `load_files` for `again` and for what is returned."""
    rebuild_table(A.airport_lookup(read_airport_reference(utc(spark), reference)), f"{folder}/airport_timezones", files=1)
    return load_files(spark, raw, f"{folder}/flights", carriers, again)


def propagate(spark: SparkSession, folder: str, null_tail: str = "isolate") -> DataFrame:
    """Enriched flights, chained legs, the propagation table and both statistics; returns the reconciliation with
    missing_timezones and unmatched_airports, all counted while the enriched flights are written.

    The chained legs are read twice, for the minimum turns and for the table, and so are written in between: the
    shuffle by aircraft is done once. Legs without a tail number are starts of their own; null_tail='chain' takes them
    for one aircraft, which is scanned in segments.
    """
    require_tables(utc(spark), folder, ["flights", "airport_timezones"])
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    enriched, seen = observed(enrich.enrich_flights(read("flights"), read("airport_timezones")), **enrich.reconciled(), **enrich.codes_without_timezone(), missing_timezones=enrich.without_timezone())
    rebuild_table(enriched, f"{folder}/flights_enriched")
    segments = int(spark.conf.get("spark.sql.shuffle.partitions")) if null_tail == "chain" else None
    with stage_scope(spark):
        effects = rotation.with_effects(rotation.chained_legs(read("flights_enriched"), null_tail, segments))
        rebuild_table(effects, f"{folder}/chained_legs")
    min_turn = rotation.min_turn_blend(rotation.operational_turns(read("chained_legs")))
    rebuild_table(rotation.with_buffers(read("chained_legs"), min_turn).select(*rotation.PROPAGATION), f"{folder}/flights_propagation")
    rebuild_table(stats.airport_stats(read("flights_propagation")), f"{folder}/airport_stats", files=1)
    rebuild_table(stats.route_stats(read("flights_propagation")), f"{folder}/route_stats", files=1)
    counts = seen.get
    counts = counts | {"unmatched_airports": sorted({*counts["no_origin"], *counts["no_dest"]})}
    return report(spark, "checked long, matching long, mismatching long, missing_timezones long, unmatched_airports array<string>", counts)


def distribute(spark: SparkSession, folder: str) -> DataFrame:
    """The four distributions; returns the fallback rates."""
    require_tables(utc(spark), folder, ["flights_propagation", "airport_stats", "route_stats"])
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    legs = read("flights_propagation")
    with stage_scope(spark):
        for kind, dists, known in (("node", D.node_dists(legs), read("airport_stats")), ("edge", D.edge_dists(legs), read("route_stats"))):
            rebuild_table(dists.network, f"{folder}/network_{kind}_delay_distributions", files=1)
            rebuild_table(dists.by_key(known), f"{folder}/{kind}_delay_distributions")
    return D.fallback_rates(read("node_delay_distributions"), read("edge_delay_distributions"))


def export(spark: SparkSession, folder: str, to: str) -> DataFrame:
    """The six serving tables; returns what has no coordinates."""
    names = ["network_node_delay_distributions", "node_delay_distributions", "network_edge_delay_distributions", "edge_delay_distributions"]
    require_tables(utc(spark), folder, ["airport_stats", "route_stats", "airport_timezones", *names])
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    places = read("airport_timezones")
    points, arcs = serving.airport_points(read("airport_stats"), places), serving.route_arcs(read("route_stats"), places)
    export_bundle({"airport_points": points, "route_arcs": arcs} | {n: read(n) for n in names}, to)
    return serving.export_dropped(read("airport_stats"), read("route_stats"), places)


def simulate(spark: SparkSession, requests: DataFrame, folder: str, draws: int = DRAWS) -> DataFrame:
    """Requests (path_id, path_text, start_delay) parsed, checked and simulated; writes path_checks, simulated_stops and
    simulated_fan, and returns the stops of each path that only the network's pool could reach."""
    names = ["network_node_delay_distributions", "node_delay_distributions", "network_edge_delay_distributions", "edge_delay_distributions"]
    require_tables(utc(spark), folder, names)
    net_node, node, net_edge, edge = (spark.read.parquet(f"{folder}/{n}") for n in names)
    asked = requests.select("path_id", M.parse_path(F.col("path_text")).alias("path"), "start_delay")
    rebuild_table(M.validate_path(asked, node), f"{folder}/path_checks")
    good = spark.read.parquet(f"{folder}/path_checks").filter("is_valid").select("path_id", "path", "start_delay")
    with stage_scope(spark):
        simulated = stored(M.simulate_paths(good, node, edge, net_node, net_edge, draws, "percentiles"), "simulated")
        rebuild_table(M.summarize_stops(simulated), f"{folder}/simulated_stops")
        stops = spark.read.parquet(f"{folder}/simulated_stops")
        rebuild_table(M.fan_table(simulated, stops), f"{folder}/simulated_fan")
    return M.fallback_hops(stops)


def backtest(spark: SparkSession, folder: str, rotations: int | None = ROTATIONS, draws: int = DRAWS) -> DataFrame:
    """Replays rotations (a seeded choice, or all with None) from their first delay; writes replay_coverage and returns its report,
    with how many rotations were replayed and how many skipped, for a missing delay or an unknown stop, beside each row."""
    names = ["network_node_delay_distributions", "node_delay_distributions", "network_edge_delay_distributions", "edge_delay_distributions"]
    require_tables(utc(spark), folder, ["flights_propagation", *names])
    net_node, node, net_edge, edge = (spark.read.parquet(f"{folder}/{n}") for n in names)
    legs = spark.read.parquet(f"{folder}/flights_propagation")
    asked, seen = observed(
        B.usable_rotations(B.rotation_paths(legs, B.sample_rotations(legs, rotations)), node), replayed_rotations=F.count_if("is_usable"), skipped_rotations=F.count_if(~F.col("is_usable"))
    )
    with stage_scope(spark):
        usable = stored(asked.filter("is_usable"), "rotations")
        rebuild_table(B.replay_coverage(M.simulate_paths(usable, node, edge, net_node, net_edge, draws, "percentiles")), f"{folder}/replay_coverage")
    return B.coverage_report(spark.read.parquet(f"{folder}/replay_coverage")).withColumns({name: F.lit(n) for name, n in seen.get.items()})
