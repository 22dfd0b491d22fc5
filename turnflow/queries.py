"""One query per operator, over flights derived from the tables in sf_dir."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.constants import DRAWS, KEEP
from turnflow.functions.numbers import bucket_bounds, delay_bucket
from turnflow.functions.stage import shared_dir, stored
from turnflow.functions.when import hhmm_split, local_hhmm, minutes_between
from turnflow.jobs.flow import utc
from turnflow.operators import airports as A
from turnflow.operators import backtest as B
from turnflow.operators import cleaning as C
from turnflow.operators import distributions as D
from turnflow.operators import enrich as E
from turnflow.operators import rotation as R
from turnflow.operators import serving as S
from turnflow.operators import simulate as M
from turnflow.operators import stats as T
from turnflow.oracles import ENDINGS, oracle
from turnflow.sources import derived
from turnflow.sources.ledger import ledger, load_files
from turnflow.sources.ontime import AIRPORT_FILE, append_new_months, read_airport_reference, read_ontime
from turnflow.sources.sheets import as_workbooks, sheet_table
from turnflow.sources.tables import export_bundle, rebuild_table, require_tables

CLEAN = [c for c in KEEP if c not in ("DayOfWeek", "OriginCityName", "OriginState", "DestCityName", "DestState", "DepDel15", "ArrDel15", "TaxiOut", "WheelsOff", "WheelsOn", "TaxiIn", "CancellationCode", "AirTime", "Distance")]
TIMES = ("CRSDepTimestampUTC", "CRSArrTimestampUTC", "DepTimestampUTC", "ArrTimestampUTC")


class Tables:
    """The tables of one folder, made on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = utc(spark), sf_dir, {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def raw(self) -> DataFrame:
        """Stored, as exports are files: else the optimizer writes each derived expression out again wherever a later one uses it."""
        return self._once("raw", lambda: stored(derived.raw_flights(self.spark, self.sf_dir), "raw"))

    @property
    def airports(self) -> DataFrame:
        return A.airport_lookup(derived.airports(self.spark, self.sf_dir))

    @property
    def flights(self) -> DataFrame:
        return C.clean_flights(self.raw)

    @property
    def attached(self) -> DataFrame:
        return E.attach_timezones(self.flights, self.airports)

    @property
    def enriched(self) -> DataFrame:
        """From stored flights, as in the jobs."""
        flights = self._once("flights", lambda: stored(self.flights, "flights"))
        return E.enrich_flights(flights, self.airports)

    @property
    def effects(self) -> DataFrame:
        return R.with_effects(R.chained_legs(self.enriched))

    @property
    def propagation(self) -> DataFrame:
        """Stored where it is read more than once: the chained legs, and the table itself."""

        def make() -> DataFrame:
            legs = stored(self.effects, "chained")
            return R.with_buffers(legs, R.min_turn_blend(R.operational_turns(legs))).select(*R.PROPAGATION)

        return self._once("propagation", make)

    @property
    def stored_propagation(self) -> DataFrame:
        return self._once("stored", lambda: stored(self.propagation, "propagation"))

    @property
    def turns(self) -> DataFrame:
        return R.operational_turns(R.chained_legs(self.enriched))

    @property
    def nodes(self) -> D.Dists:
        return self._once("nodes", lambda: D.node_dists(self.stored_propagation))

    @property
    def edges(self) -> D.Dists:
        return self._once("edges", lambda: D.edge_dists(self.stored_propagation))

    @property
    def node_dist(self) -> DataFrame:
        return self._once("node_dist", lambda: stored(self.nodes.by_key(T.airport_stats(self.stored_propagation)), "node-dist"))

    @property
    def edge_dist(self) -> DataFrame:
        return self._once("edge_dist", lambda: stored(self.edges.by_key(T.route_stats(self.stored_propagation)), "edge-dist"))

    @property
    def points(self) -> DataFrame:
        return S.airport_points(T.airport_stats(self.stored_propagation), self.airports)

    @property
    def arcs(self) -> DataFrame:
        return S.route_arcs(T.route_stats(self.stored_propagation), self.airports)

    @property
    def paths(self) -> DataFrame:
        asked = derived.path_requests(self.spark, self.sf_dir)
        return asked.select("path_id", M.parse_path(F.col("path_text")).alias("path"), "start_delay")

    def simulated(self, paths: DataFrame, keep: str) -> DataFrame:
        return M.simulate_paths(paths, self.node_dist, self.edge_dist, self.nodes.network, self.edges.network, DRAWS, keep)

    @property
    def valid_paths(self) -> DataFrame:
        return M.validate_path(self.paths, self.node_dist).filter("is_valid").select("path_id", "path", "start_delay")

    @property
    def requests(self) -> DataFrame:
        return self._once("simulated", lambda: stored(self.simulated(self.valid_paths, "draws"), "simulated"))

    @property
    def in_brief(self) -> DataFrame:
        """Requests with the percentiles of their stops, of each path and start bucket once: no request carries draws."""
        return self.simulated(self.valid_paths, "percentiles")

    @property
    def rotations(self) -> DataFrame:
        legs = self.stored_propagation
        return B.rotation_paths(legs, B.sample_rotations(legs, None))

    @property
    def replayed(self) -> DataFrame:
        usable = stored(B.usable_rotations(self.rotations, self.node_dist).filter("is_usable"), "rotations")
        return B.replay_coverage(self.simulated(usable, "percentiles"))


def ID() -> Column:
    return F.col("Flight_Number_Reporting_Airline").alias("flight_number")


def text(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


def flag(c: str) -> Column:
    """0, 1 or null: engines differ in how they hand over null booleans."""
    return F.col(c).cast("int").alias(c)


def joined(c: str) -> Column:
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


def fixed(c: str) -> Column:
    return (F.round(F.col(c) * 1000000, 0) / 1000000).alias(c)


def swap(df: DataFrame, *columns: Column) -> DataFrame:
    """df with the columns of these names replaced."""
    return df.withColumns(dict(zip(df.select(*columns).columns, columns, strict=True)))


def _focus(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The chosen airport and route, as tables."""
    codes = t.airports.select(F.col("iata").alias("airport"))
    chosen = codes.filter("airport = 'N01'")
    route = codes.filter("airport = 'N00'").select(F.col("airport").alias("origin"), F.lit("N02").alias("dest"))
    return chosen, route


def _ids(pair: tuple[DataFrame, DataFrame]) -> DataFrame:
    points, arcs = pair
    return points.select(F.col("airport").alias("id")).union(arcs.select(F.concat_ws("-", "origin", "dest")))


def _append(t: Tables) -> DataFrame:
    flights = t.flights
    loaded = flights.filter("Month % 2 = 0 OR (Reporting_Airline = 'UA' AND Month % 3 = 0)").select("Year", "Month", "Reporting_Airline")
    return append_new_months(flights, loaded).select(ID(), "Year", "Month", "Reporting_Airline")


def _keep(t: Tables) -> DataFrame:
    df, missing = C.select_keep_columns(t.raw)
    return df.agg(F.count("*").alias("row_count")).select("row_count", F.lit(len(df.columns)).cast("long").alias("n_kept"), F.lit(len(missing)).cast("long").alias("n_missing"))


def _support(t: Tables) -> DataFrame:
    points, arcs = S.min_support_filter(t.points, t.arcs, 20, 5)
    return points.select(F.col("airport").alias("id"), F.col("turn_events").alias("events")).union(arcs.select(F.concat_ws("-", "origin", "dest"), "flights"))


def _split(t: Tables) -> DataFrame:
    return t.flights.select(ID(), hhmm_split(F.col("DepTime")).alias("_s")).select("flight_number", "_s.hour", "_s.minute", "_s.days")


def _propagation(t: Tables) -> DataFrame:
    return swap(t.propagation, *[text(c) for c in ("FlightDate", "operating_day", "DepTimestampUTC", "ArrTimestampUTC")], *[fixed(c) for c in ("empirical_min_turn_min", "scheduled_buffer", "propagated_delay")], flag("is_overnight_turn"), flag("min_turn_is_fallback"))


def _stops(df: DataFrame) -> DataFrame:
    return swap(df, *[fixed(c) for c in ("p10", "p50", "p90", "mean", "p_over_15", "p_over_30", "p_over_60")])


def _step(t: Tables, turn: bool) -> DataFrame:
    first = t.simulated(t.valid_paths, "turns").select("path_id", F.size("path").alias("n"), F.col("stops")[0].alias("s"))
    if turn:
        return first.filter("n > 2").select("path_id", F.array_join(F.col("s.turned").cast("array<string>"), ",").alias("draws"))
    return first.select("path_id", F.array_join(F.col("s.draws").cast("array<string>"), ",").alias("draws"), "s.used_route_fallback")


def _simulated(t: Tables) -> DataFrame:
    return swap(t.requests.select("path_id", F.inline("stops")), joined("draws"))


def _fan(t: Tables) -> DataFrame:
    simulated = stored(t.in_brief, "simulated")  # read twice
    return swap(M.fan_table(simulated, M.summarize_stops(simulated)), *[fixed(c) for c in ("p10", "p50", "p90", "p_over_15")])


def _rotations(t: Tables) -> DataFrame:
    df = t.rotations.withColumn("actual", F.col("actual").cast("array<int>"))
    return swap(df, text("operating_day"), joined("path"), joined("actual")).select("Tail_Number", "operating_day", "path", "actual", "start_delay")


def _bounds(t: Tables) -> DataFrame:
    legs = t.propagation.groupBy(delay_bucket(F.col("ArrDelayMinutes")).alias("bucket")).agg(F.count("*").alias("legs"))
    out = bucket_bounds(t.spark).join(legs, "bucket", "left")
    return out.select("bucket", "bucket_low", "bucket_high", F.coalesce("legs", F.lit(0)).alias("legs"))


def _folder(t: Tables, name: str) -> str:
    """A new folder that all executors see."""
    return f"{shared_dir(t.spark)}/turnflow/{name}-{uuid.uuid4().hex}"


def _exports(t: Tables) -> str:
    """The raw records as monthly exports of three layouts: as they are, the other way round, and without a few columns."""
    raw, folder = t.raw, _folder(t, "exports")
    layouts = (raw.columns, raw.columns[::-1], [c for c in sorted(raw.columns) if c not in ("DepDelay", "ArrDelay", "Unnamed: 109")])
    for k, columns in enumerate(layouts):
        part = raw.filter(F.col("Month").cast("int") % len(layouts) == k).select(*columns)
        part.write.mode("append").option("header", True).csv(folder)
    return folder


def _read(t: Tables) -> DataFrame:
    df = C.cast_nullable_ints(read_ontime(t.spark, _exports(t)))
    return df.select(ID(), "Year", "Month", F.trim("Tail_Number").alias("Tail_Number"), "Reporting_Airline", "Origin", "Dest", "DepTime", F.col("DepDelay").cast("double").alias("DepDelay"), F.col("ArrDelayMinutes").cast("double").alias("ArrDelayMinutes"))


def _sheets(t: Tables) -> DataFrame:
    """The raw records as workbooks and back, numbers as numbers."""
    numbers = [c for c in t.raw.columns if c.endswith(("Time", "Delay", "DelayMinutes")) or c.startswith("Flight_")]
    df = C.cast_nullable_ints(sheet_table(as_workbooks(t.raw, numbers), t.raw.columns), ["Flight_Number_Reporting_Airline"])
    return df.select(ID(), "Year", "Month", F.trim("Tail_Number").alias("Tail_Number"), "Reporting_Airline", "Origin", "Dest", "FlightDate", "DepTime", "CRSArrTime", F.col("ArrDelay").cast("double").alias("ArrDelay"))


def _loads(t: Tables) -> DataFrame:
    """Even months first, then everything twice: what the table and its ledger have in the end."""
    exports, flights = _exports(t), f"{_folder(t, 'flights')}/flights"
    early = t.raw.filter("CAST(Month AS INT) % 2 = 0")
    early.write.option("header", True).csv(f"{flights}-early")
    for paths in (f"{flights}-early", exports, exports):
        load_files(t.spark, paths, flights)
    entered = ledger(t.spark, flights).select(F.explode("months").alias("m")).groupBy("m.Year", "m.Month", "m.Reporting_Airline").agg(F.sum("m.rows").alias("entered"))
    there = t.spark.read.parquet(flights).groupBy("Year", "Month", "Reporting_Airline").agg(F.count("*").alias("flights"))
    return there.join(entered, ["Year", "Month", "Reporting_Airline"], "full")


def _rebuilt(t: Tables) -> DataFrame:
    """A table written, replaced by a version made of itself, checked and read."""
    folder = _folder(t, "tables")
    rebuild_table(t.airports, f"{folder}/airport_timezones", files=1)
    rebuild_table(t.spark.read.parquet(f"{folder}/airport_timezones").filter("iata < 'N12'"), f"{folder}/airport_timezones")
    require_tables(t.spark, folder, ["airport_timezones"])
    return t.spark.read.parquet(f"{folder}/airport_timezones")


def _reference(t: Tables) -> DataFrame:
    """The airports as a reference file without a header, with what it lacks as \\N, and read from it."""
    path, known = _folder(t, "reference"), derived.airports(t.spark, t.sf_dir)
    columns = [c.split()[0] for c in AIRPORT_FILE.split(", ")]
    known.select(*[F.col(c) if c in known.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.option("nullValue", "\\N").csv(path)
    return read_airport_reference(t.spark, path).select("airport_id", "name", "city", "iata", "icao", "lat", "lon", "tz_name")


def _bundle(t: Tables) -> DataFrame:
    """The serving tables of airports and routes, exported twice as one folder and read from it."""
    folder = _folder(t, "bundle")
    for _ in range(2):
        export_bundle({"airport_points": t.points, "route_arcs": t.arcs}, folder)
    points, arcs = (t.spark.read.parquet(f"{folder}/{name}") for name in ("airport_points", "route_arcs"))
    return points.select(F.col("airport").alias("id"), F.col("turn_events").alias("events"), "lat").union(arcs.select(F.concat_ws("-", "origin", "dest"), "flights", "dest_lat"))


def _required(t: Tables) -> DataFrame:
    """Tables that the jobs' contracts accept, with their rows."""
    folder, legs = _folder(t, "required"), t.stored_propagation
    made = {"flights": t.flights, "airport_timezones": t.airports, "flights_propagation": legs, "airport_stats": T.airport_stats(legs), "route_stats": T.route_stats(legs)}
    for name, df in made.items():
        rebuild_table(df, f"{folder}/{name}")
    require_tables(t.spark, folder, made)
    counts = [t.spark.read.parquet(f"{folder}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("row_count")) for name in made]
    return reduce(DataFrame.union, counts)


def _segments(t: Tables) -> DataFrame:
    """One carrier's legs without tail numbers, chained in segments of time."""
    enriched = t.enriched.withColumn("Tail_Number", F.when(F.col("Reporting_Airline") != "UA", F.col("Tail_Number")))
    return R.with_effects(R.chained_legs(enriched, "chain", 16)).select("flight_number", "prev_dest", "prev_flight_number", "rotation_leg_number", "cumulative_node_delay")


def _column(name: str) -> Callable[[Tables], DataFrame]:
    return lambda t: t.effects.select("flight_number", name)


MAKE: dict[str, Callable[[Tables], DataFrame]] = {
    "read_ontime": _read,
    "read_sheets": _sheets,
    "load_months": _loads,
    "rebuild_table": _rebuilt,
    "read_airport_reference": _reference,
    "export_bundle": _bundle,
    "require_tables": _required,
    "append_new_months": _append,
    "filter_carriers": lambda t: C.cast_nullable_ints(C.filter_carriers(t.raw)).select(ID(), "Reporting_Airline"),
    "select_keep_columns": _keep,
    "fill_delay_causes": lambda t: C.cast_nullable_ints(C.fill_delay_causes(t.raw)).select(ID(), "CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay"),
    "cast_nullable_ints": lambda t: C.cast_nullable_ints(t.raw).select(ID(), "CRSDepTime", "DepTime", "CRSArrTime", "ArrTime", "CRSElapsedTime", "ActualElapsedTime", "OriginAirportID", "DestAirportID"),
    "parse_flight_date": lambda t: C.cast_nullable_ints(C.parse_flight_date(t.raw)).select(ID(), text("FlightDate")),
    "trim_codes": lambda t: C.cast_nullable_ints(C.trim_codes(t.raw)).select(ID(), "Tail_Number"),
    "cast_flags": lambda t: C.cast_nullable_ints(C.cast_flags(t.raw)).select(ID(), "Cancelled", "Diverted"),
    "clean_flights": lambda t: t.flights.select(*CLEAN).withColumn("FlightDate", F.col("FlightDate").cast("string")),
    "airport_lookup": lambda t: t.airports,
    "unmatched_airports": lambda t: A.unmatched_airports(t.flights, t.airports),
    "attach_timezones": lambda t: t.attached.select(ID(), "Origin", "Dest", "origin_tz", "dest_tz"),
    "missing_timezone_count": lambda t: E.missing_timezone_count(t.attached),
    "hhmm_split": _split,
    "localize_to_utc": lambda t: E.actual_utc(t.attached).select(ID(), F.col("DepTimestampUTC").cast("string").alias("utc")),
    "scheduled_utc": lambda t: E.scheduled_utc(t.attached).select(ID(), F.col("CRSDepTimestampUTC").cast("string").alias("dep"), F.col("CRSArrTimestampUTC").cast("string").alias("arr")),
    "actual_utc": lambda t: E.actual_utc(t.attached).select(ID(), F.col("DepTimestampUTC").cast("string").alias("dep"), F.col("ArrTimestampUTC").cast("string").alias("arr")),
    "utc_to_local_hhmm": lambda t: t.enriched.select(ID(), local_hhmm(F.col("ArrTimestampUTC"), F.col("dest_tz")).alias("hhmm")),
    "arrival_reconciliation": lambda t: E.arrival_reconciliation(t.enriched),
    "enrich_flights": lambda t: swap(t.enriched.select(*CLEAN, "origin_tz", "dest_tz", *TIMES), text("FlightDate"), *[text(c) for c in TIMES]),
    "operating_day": lambda t: R.previous_leg(R.completed_legs(t.enriched)).select(ID(), text("operating_day")),
    "minutes_between": lambda t: t.enriched.select(ID(), minutes_between(F.col("CRSDepTimestampUTC"), F.col("ArrTimestampUTC")).alias("minutes")),
    "completed_legs": lambda t: R.completed_legs(t.enriched).select(ID(), "Tail_Number", "Origin", "Dest"),
    "previous_leg": lambda t: R.previous_leg(R.completed_legs(t.enriched)).select(ID(), "lag_dest", "lag_arr_delay", "lag_flight_number", text("lag_arr_utc"), text("lag_crs_arr_utc")),
    "chain_legs": lambda t: R.chained_legs(t.enriched).select(ID(), "prev_dest", "prev_arr_delay", "prev_flight_number", "is_first_leg"),
    **{c: _column(c) for c in ("rotation_leg_number", "node_effect", "edge_effect_delay", "edge_effect_schedule", "scheduled_turn_min", "cumulative_node_delay")},
    "chain_in_segments": _segments,
    "is_overnight_turn": lambda t: t.effects.select("flight_number", flag("is_overnight_turn")),
    "operational_turns": lambda t: t.turns,
    "network_min_turn": lambda t: R.network_min_turn(t.turns).select(fixed("default_min_turn_min")),
    "airport_min_turn": lambda t: swap(R.airport_min_turn(t.turns), fixed("airport_min_turn_min")),
    "min_turn_blend": lambda t: swap(R.min_turn_blend(t.turns), fixed("empirical_min_turn_min")),
    "scheduled_buffer": lambda t: t.propagation.select("flight_number", fixed("scheduled_buffer")),
    "propagated_delay": lambda t: t.propagation.select("flight_number", fixed("propagated_delay")),
    "build_propagation": _propagation,
    "airport_stats": lambda t: T.airport_stats(t.propagation),
    "route_stats": lambda t: T.route_stats(t.propagation),
    "delay_bucket": lambda t: t.propagation.select("flight_number", delay_bucket(F.col("ArrDelayMinutes")).alias("bucket")),
    "bucket_bounds": _bounds,
    "capped_sample": lambda t: D.capped_sample(D.node_universe(t.propagation), D.NODE),
    "least_rows": lambda t: D.least_rows(D.edge_universe(t.propagation), D.EDGE),
    "network_node_dist": lambda t: swap(t.nodes.network, joined("dep_delay_samples")),
    "node_dist": lambda t: swap(t.nodes.by_key(T.airport_stats(t.stored_propagation)), joined("dep_delay_samples")),
    "network_edge_dist": lambda t: swap(t.edges.network, joined("arr_delay_samples")),
    "edge_dist": lambda t: swap(t.edges.by_key(T.route_stats(t.stored_propagation)), joined("arr_delay_samples")),
    "fallback_rates": lambda t: swap(D.fallback_rates(t.node_dist, t.edge_dist), fixed("fallback_rate")),
    "sample_fidelity": lambda t: swap(D.sample_fidelity(D.node_universe(t.stored_propagation), D.NODE), fixed("full_mean"), fixed("sample_mean")),
    "airport_points": lambda t: t.points,
    "route_arcs": lambda t: t.arcs,
    "export_dropped": lambda t: S.export_dropped(T.airport_stats(t.stored_propagation), T.route_stats(t.stored_propagation), t.airports),
    "parse_path": lambda t: swap(t.paths.select("path_id", "path"), joined("path")),
    "validate_path": lambda t: swap(M.validate_path(t.paths, t.node_dist).select("path_id", "unknown_codes", "is_valid"), joined("unknown_codes")),
    "simulate_paths": _simulated,
    "edge_step": lambda t: _step(t, False),
    "node_step": lambda t: _step(t, True),
    "summarize_stops": lambda t: _stops(M.summarize_stops(t.in_brief)),
    "fan_table": _fan,
    "fallback_hops": lambda t: swap(M.fallback_hops(M.summarize_stops(t.in_brief)), joined("fallback_stops")),
    "sample_rotations": lambda t: swap(B.sample_rotations(t.propagation), text("operating_day")),
    "rotation_paths": _rotations,
    "usable_rotations": lambda t: B.usable_rotations(t.rotations, t.node_dist).select("Tail_Number", text("operating_day"), "is_usable"),
    "replay_coverage": lambda t: swap(t.replayed, text("operating_day")),
    "coverage_report": lambda t: swap(B.coverage_report(t.replayed), fixed("covered_share")),
    "min_support_filter": _support,
    "focus_connected": lambda t: _ids(S.focus_connected(t.points, t.arcs, *_focus(t))),
    "focus_exact": lambda t: _ids(S.focus_exact(t.points, t.arcs, *_focus(t))),
    "code_search": lambda t: S.code_search(t.arcs, " n0 ", ("origin", "dest")).select("origin", "dest"),
    "focus_metrics": lambda t: S.focus_metrics(t.points, t.arcs),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: MAKE[name](Tables(spark, sf_dir))


QUERIES = {name: _query(name) for name in MAKE}
ORACLES = {name: oracle(name) for name in ENDINGS}
