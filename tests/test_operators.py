"""Hand-made rows at the edges of the flight operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnflow.functions.numbers import delay_bucket, sorted_percentile
from turnflow.functions.when import hhmm_split, localize_to_utc, minutes_between, operating_day
from turnflow.operators import airports as A
from turnflow.operators import cleaning as C
from turnflow.operators import distributions as D
from turnflow.operators import enrich as E
from turnflow.operators import rotation as R
from turnflow.operators import serving as S
from turnflow.operators import simulate as M
from turnflow.operators import stats as T

NY = "America/New_York"


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("day", "hhmm", "tz", "want"),
    [
        ("2024-06-01", 830, NY, "2024-06-01 12:30:00"),
        ("2024-06-01", 2400, NY, "2024-06-02 04:00:00"),
        ("2024-06-01", 0, NY, "2024-06-01 04:00:00"),
        ("2024-06-01", None, NY, None),
        ("2024-06-01", 830, None, None),
        ("2024-03-10", 230, NY, None),  # skipped
        ("2024-11-03", 130, NY, None),  # twice
        ("2024-11-03", 300, NY, "2024-11-03 08:00:00"),
        ("2024-11-03", 130, "America/Phoenix", "2024-11-03 08:30:00"),
    ],
)
def test_localize(spark, day, hhmm, tz, want):
    df = spark.createDataFrame([(dt.date.fromisoformat(day), hhmm, tz)], "d date, h long, tz string")
    assert one(df.select(localize_to_utc(F.col("d"), F.col("h"), F.col("tz")).cast("string"))) == [(want,)]


def test_hhmm_and_minutes(spark):
    df = spark.createDataFrame([(2400,), (5,), (1359,), (None,)], "h long").select(hhmm_split(F.col("h")).alias("s")).select("s.*")
    assert one(df) == [(0, 0, 1), (0, 5, 0), (13, 59, 0), (None, None, None)]
    t = spark.sql("SELECT timestamp'2024-01-01 00:00:59' a, timestamp'2024-01-01 00:01:00' b")
    assert one(t.select(minutes_between(F.col("a"), F.col("b")), minutes_between(F.col("b"), F.col("a")))) == [(1, -1)]


def test_operating_day_starts_at_half_past_four(spark):
    df = spark.sql("SELECT timestamp'2024-06-02 08:29:00' a, timestamp'2024-06-02 08:30:00' b")
    assert one(df.select(operating_day(F.col("a"), F.lit(NY)).cast("string"), operating_day(F.col("b"), F.lit(NY)).cast("string"))) == [("2024-06-01", "2024-06-02")]


def test_buckets_and_percentiles(spark):
    x = [-5.0, 0.0, 0.5, 1.0, 15.0, 16.0, 30.0, 31.0, 60.0, 61.0, None]
    df = spark.createDataFrame([(v,) for v in x], "x double").select(delay_bucket(F.col("x")))
    assert [r[0] for r in df.collect()] == ["on_time_or_early", "on_time_or_early", None, "1_15", "1_15", "16_30", "16_30", "31_60", "31_60", "60_plus", None]
    p = spark.createDataFrame([([1, 2, 3, 4],), ([],), ([7],)], "a array<int>").select(sorted_percentile(F.col("a"), 0.5))
    assert one(p) == [(2.5,), (None,), (7.0,)]


def test_cleaning(spark):
    raw = spark.createDataFrame(
        [("DL", "6/1/2024 12:00:00 AM", " N1 ", "830.0", "", "1.00", None, "2024", "6"), ("AA", "2024-06-01", "N2", "x", "3", "", "0", "2024", "6")],
        "Reporting_Airline string, FlightDate string, Tail_Number string, DepTime string, CarrierDelay string, Cancelled string, Diverted string, Year string, Month string",
    ).withColumn("Unnamed: 9", F.lit("x"))
    got = C.clean_flights(raw)
    assert "Unnamed: 9" not in got.columns
    r = got.collect()
    assert len(r) == 1
    assert (r[0].Tail_Number, r[0].DepTime, r[0].CarrierDelay, r[0].Cancelled, r[0].Diverted, str(r[0].FlightDate), r[0].Year) == ("N1", 830, 0.0, 1, 0, "2024-06-01", 2024)
    assert C.cast_nullable_ints(raw).filter("Reporting_Airline = 'AA'").first().DepTime is None
    assert "Dest" in C.select_keep_columns(raw)[1]


def test_airports(spark):
    ref = spark.createDataFrame([(2, "AAA", NY, "1", "2", "b", "c"), (1, "AAA", NY, "1", "2", "a", "c"), (3, None, NY, "1", "2", "x", "c"), (4, "BBB", None, "1", "2", "x", "c")], "airport_id int, iata string, tz_name string, lat string, lon string, name string, city string")
    known = A.airport_lookup(ref)
    assert [(r.iata, r.name, r.lat) for r in known.collect()] == [("AAA", "a", 1.0)]
    flights = spark.createDataFrame([("AAA", "BBB"), ("CCC", None)], "Origin string, Dest string")
    assert sorted(r.code for r in A.unmatched_airports(flights, known).collect()) == ["BBB", "CCC"]
    assert E.missing_timezone_count(E.attach_timezones(flights, known)).first()[0] == 3


def legs(spark, rows):
    """(tail, number, origin, dest, departure minute, minutes in the air, dep delay, arr delay, cancelled)"""
    df = spark.createDataFrame(rows, "Tail_Number string, Flight_Number_Reporting_Airline long, Origin string, Dest string, m int, air int, DepDelayMinutes double, ArrDelayMinutes double, Cancelled int")
    at = lambda c: F.timestamp_add("MINUTE", c, F.lit("2024-06-01 12:00:00").cast("timestamp"))
    return df.select(
        "*", F.lit(0).alias("Diverted"), F.lit("DL").alias("Reporting_Airline"), F.lit(NY).alias("origin_tz"), F.lit("2024-06-01").cast("date").alias("FlightDate"),
        at(F.col("m")).alias("DepTimestampUTC"), at(F.col("m") + F.col("air")).alias("ArrTimestampUTC"),
        at(F.col("m") - F.col("DepDelayMinutes").cast("int")).alias("CRSDepTimestampUTC"), at(F.col("m") + F.col("air") - F.col("ArrDelayMinutes").cast("int")).alias("CRSArrTimestampUTC"),
        F.col("air").alias("ActualElapsedTime"), F.col("air").alias("CRSElapsedTime"),
    )


def test_chain(spark):
    rows = [
        ("T1", 1, "A", "B", 0, 60, 0.0, 10.0, 0),
        ("T1", 2, "B", "C", 100, 60, 25.0, 5.0, 0),
        ("T1", 3, "C", "D", 200, 60, 0.0, 0.0, 1),  # cancelled
        ("T1", 4, "D", "E", 300, 60, 3.0, 3.0, 0),  # a fresh start
        ("T1", 5, "E", "F", 600, 60, 0.0, 0.0, 0),  # a long turn
        (None, 6, "A", "B", 0, 60, 0.0, 0.0, 0),
        (None, 7, "B", "C", 100, 60, 0.0, 0.0, 0),
    ]
    chained = R.chained_legs(legs(spark, rows))
    prop = {r.flight_number: r for r in R.build_propagation(chained).collect()}
    assert sorted(prop) == [1, 2, 4, 5, 6, 7]
    assert prop[1].is_first_leg and prop[1].node_effect is None and prop[1].propagated_delay is None
    assert prop[2].prev_dest == "B" and prop[2].node_effect == 15.0 and prop[2].prev_flight_number == 1
    assert prop[4].is_first_leg and prop[4].rotation_leg_number == 3
    assert prop[5].is_overnight_turn and prop[5].node_effect == -3.0
    assert prop[2].cumulative_node_delay == 15.0 and prop[5].cumulative_node_delay == 12.0
    assert not prop[7].is_first_leg
    alone = {r.Flight_Number_Reporting_Airline: r for r in R.chained_legs(legs(spark, rows), "isolate").collect()}
    assert alone[7].is_first_leg and not alone[2].is_first_leg
    stats = T.airport_stats(R.build_propagation(chained)).collect()
    assert {r.airport: r.turn_events for r in stats} == {"B": 2}


def test_equal_departures_follow_the_flight_number(spark):
    rows = [("T", 2, "B", "C", 0, 60, 0.0, 0.0, 0), ("T", 1, "A", "B", 0, 60, 0.0, 0.0, 0)]
    got = {r.Flight_Number_Reporting_Airline: r.prev_dest for r in R.chained_legs(legs(spark, rows)).collect()}
    assert got == {1: None, 2: "B"}


@pytest.mark.parametrize(("n", "fallback"), [(9, True), (10, False)])
def test_minimum_turn_needs_ten(spark, n, fallback):
    turns = spark.createDataFrame([("A", 30 + i) for i in range(n)] + [("B", 100)] * 20, "turn_airport string, sched_turn_min long")
    row = R.min_turn_blend(turns).filter("turn_airport = 'A'").first()
    assert row.min_turn_is_fallback == fallback


def test_turn_bounds(spark):
    chained = spark.sql("SELECT 'A' prev_dest, timestamp'2024-01-01 00:00:00' prev_crs_arr_timestamp_utc, timestampadd(MINUTE, m, timestamp'2024-01-01 00:00:00') CRSDepTimestampUTC FROM VALUES (19), (20), (180), (181), (-5) t(m)")
    assert sorted(r.sched_turn_min for r in R.operational_turns(chained).collect()) == [20, 180]


@pytest.mark.parametrize(("n", "own", "kept"), [(29, False, 29), (30, True, 30), (201, True, 200)])
def test_pools(spark, n, own, kept):
    u = spark.createDataFrame([("A", "1_15", float(i), f"{i:04d}") for i in range(n)] + [("B", "1_15", 5.0, f"x{i}") for i in range(40)], "airport string, bucket string, value double, order string")
    sample, counts = D.capped_sample(u, D.NODE), D.sizes(u, D.NODE)
    net = D.network_dist(sample, counts, "s")
    assert {r.bucket: r.network_sample_size for r in net.collect()} == {"on_time_or_early": 0, "1_15": n + 40, "16_30": 0, "31_60": 0, "60_plus": 0}
    dists = D.Dists(u, D.NODE, "s", "size")
    assert sorted(map(tuple, dists.network.collect())) == sorted(map(tuple, net.collect()))
    rows = {(r.airport, r.bucket): r for r in dists.by_key(u).collect()}
    a = rows["A", "1_15"]
    assert a.is_fallback != own and a.size == n
    if own:
        assert len(a.s) == kept
    assert rows["A", "60_plus"].s is None and rows["A", "60_plus"].size == 0


def test_paths_and_simulation(spark):
    paths = spark.createDataFrame([(1, "aaa -> bbb", 45.0), (2, "AAA, CCC", 0.0), (3, "AAA", 0.0), (4, "bbb→aaa-bbb", 0.5), (5, "BBB AAA", 0.0)], "path_id long, path_text string, start_delay double")
    paths = paths.select("path_id", M.parse_path(F.col("path_text")).alias("path"), "start_delay")
    known = spark.createDataFrame([("AAA",), ("BBB",)], "airport string")
    checked = {r.path_id: (r.is_valid, r.unknown_codes) for r in M.validate_path(paths, known).collect()}
    assert checked == {1: (True, []), 2: (False, ["CCC"]), 3: (False, []), 4: (True, []), 5: (True, [])}
    names = [b for b, *_ in (("on_time_or_early",), ("1_15",), ("16_30",), ("31_60",), ("60_plus",))]
    edges = spark.createDataFrame([("AAA", "BBB", b, False, [40 + i]) for i, b in enumerate(names)], "origin string, dest string, bucket string, is_fallback boolean, arr_delay_samples array<int>")
    nodes = spark.createDataFrame([("AAA", b, False, [1]) for b in names], "airport string, bucket string, is_fallback boolean, dep_delay_samples array<int>")
    net_e = spark.createDataFrame([(b, [7]) for b in names], "bucket string, arr_delay_samples array<int>")
    net_n = spark.createDataFrame([(b, [2]) for b in names], "bucket string, dep_delay_samples array<int>")
    sim = M.simulate_paths(paths, nodes, edges, net_n, net_e, 16)
    got = {r.path_id: r.stops for r in sim.collect()}
    assert [s.draws for s in got[1]] == [[43] * 16] and not got[1][0].used_route_fallback
    assert got[3] is None and got[4] is None
    assert [s.draws for s in got[5]] == [[7] * 16] and got[5][0].used_route_fallback
    summary = M.summarize_stops(sim)
    assert {(r.path_id, r.hop): (r.p50, r.p_over_30) for r in summary.collect()} == {(1, 1): (43.0, 1.0), (2, 1): (7.0, 0.0), (5, 1): (7.0, 0.0)}
    assert {r.path_id: r.fallback_stops for r in M.fallback_hops(summary).collect()} == {2: ["CCC"], 5: ["AAA"]}
    far = M.simulate_paths(paths, nodes, edges, net_n, net_e, 16, sent_bytes=0)  # pools dealt to groups of paths
    assert {r.path_id: r.stops for r in far.collect()} == got
    brief = {r.path_id: r.stops for r in M.simulate_paths(paths, nodes, edges, net_n, net_e, 16, keep="percentiles", sent_bytes=0).collect()}
    assert [(s.p10, s.p50, s.p90, s.mean, s.p_over_30) for s in brief[1]] == [(43.0, 43.0, 43.0, 43.0, 1.0)] and brief[3] is None
    assert sorted(r.label for r in M.fan_table(sim, summary).filter("path_id = 1").collect()) == ["0. AAA", "1. BBB"]


def test_focus(spark):
    points = spark.createDataFrame([("A",), ("B",), ("C",)], "airport string")
    arcs = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A")], "origin string, dest string")
    none_a, none_r = points.limit(0), arcs.limit(0)
    assert S.focus_connected(points, arcs, none_a, none_r)[1].count() == 3
    p, a = S.focus_connected(points, arcs, points.filter("airport = 'A'"), none_r)
    assert sorted(r.airport for r in p.collect()) == ["A", "B", "C"] and a.count() == 2
    p, a = S.focus_exact(points, arcs, none_a, arcs.filter("origin = 'B'"))
    assert p.count() == 0 and a.count() == 1
    assert S.code_search(arcs, " b ", ("origin", "dest")).count() == 2


@pytest.mark.parametrize("held", [1, 40, 200_000])
def test_least_rows_from_one_exchange(spark, held):
    """Counts and least rows from one pass are those of two, whatever a task holds; ties, nulls and hot keys included."""
    import random

    r = random.Random(6)
    rows = [(r.choice(["A", "A", "A", "B", None]), r.choice(["x", "y"]), r.choice(["1_15", "16_30", None]), r.choice([None, float(r.randint(0, 9))]), f"{r.randint(0, 400):04d}") for _ in range(3000)]
    u = spark.createDataFrame(rows, "origin string, dest string, bucket string, value double, order string").repartition(7)
    got = D.least_rows(u, D.EDGE, 20, held)
    want = D.capped_sample(u, D.EDGE, 20)
    key = lambda df: sorted(tuple("~" if v is None else str(v) for v in x) for x in df.collect())
    assert key(got.drop("sample_size")) == key(want) and len(key(want)) > 100
    assert key(got.select("origin", "dest", "bucket", "sample_size").distinct()) == key(D.sizes(u, D.EDGE))
    assert D.least_rows(u.limit(0), D.EDGE).count() == 0
    plan = D.least_rows(spark.createDataFrame(rows, u.schema), D.EDGE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
