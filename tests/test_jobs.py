"""Files in, tables out, and again: appends add nothing twice, rebuilt tables stay the same."""

from __future__ import annotations

import csv

import pytest

from turnflow.jobs import flow
from turnflow.sources import derived
from turnflow.sources.ontime import append_new_months, read_airport_reference
from turnflow.sources.tables import require_tables
from turnflow.streaming.months import watch_months


def write_csv(path, df):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows([["" if v is None else v for v in r] for r in df.collect()])


@pytest.fixture(scope="module")
def files(spark, sf_dir, tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    raw = derived.raw_flights(spark, sf_dir)
    write_csv(top / "raw/a.csv", raw.filter("CAST(Month AS INT) <= 2"))
    write_csv(top / "raw2/b.csv", raw.filter("Month = '2' OR Month = '3'").drop("Unnamed: 109"))
    with (top / "airports.dat").open("w", newline="") as f:
        for r in derived.airports(spark, sf_dir).collect():
            csv.writer(f).writerow([r.airport_id, r.name, r.city, "X", r.iata, "\\N", r.lat, r.lon, 0, -5, "A", r.tz_name, "airport", "x"])
        csv.writer(f).writerow([999, "late twin", "c", "X", "N01", "\\N", 0, 0, 0, 0, "A", "America/Denver", "airport", "x"])
        csv.writer(f).writerow([998, "no code", "c", "X", "\\N", "\\N", 0, 0, 0, 0, "A", "America/Denver", "airport", "x"])
    return top


def test_all_jobs(spark, files, tmp_path):
    folder = str(tmp_path / "tables")
    first = flow.ingest(spark, str(files / "raw/a.csv"), str(files / "airports.dat"), folder)
    assert first.loaded > 0 and first.skipped == 0
    assert flow.ingest(spark, str(files / "raw/a.csv"), str(files / "airports.dat"), folder).loaded == 0
    assert flow.ingest(spark, [str(files / "raw/a.csv"), str(files / "raw2/b.csv")], str(files / "airports.dat"), folder).loaded > 0
    assert spark.read.parquet(f"{folder}/airport_timezones").filter("iata = 'N01'").count() == 1
    report = flow.propagate(spark, folder).first()
    assert report.checked == report.matching + report.mismatching > 0
    legs = spark.read.parquet(f"{folder}/flights_propagation")
    assert len(legs.columns) == 26
    assert legs.filter("is_first_leg <> (node_effect IS NULL)").count() == 0
    routes = spark.read.parquet(f"{folder}/route_stats")
    assert routes.filter("amplify_events + absorb_events + neutral_events <> flights").count() == 0
    before = legs.count()
    flow.propagate(spark, folder)
    assert spark.read.parquet(f"{folder}/flights_propagation").count() == before
    rates = flow.distribute(spark, folder)
    assert {r.kind for r in rates.collect()} == {"node", "edge"}
    dropped = flow.export(spark, folder, str(tmp_path / "out")).first()
    assert dropped.airports_dropped == 0
    require_tables(spark, str(tmp_path / "out"), ["airport_points", "route_arcs", "network_node_delay_distributions", "node_delay_distributions", "network_edge_delay_distributions", "edge_delay_distributions"])
    asked = spark.createDataFrame([(1, "N00 -> N01 -> N02", 20.0), (2, "N00, XXX", 0.0), (3, "n01-n00", None)], "path_id long, path_text string, start_delay double")
    for _ in range(2):
        flow.simulate(spark, asked, folder, draws=50).collect()
        stops = spark.read.parquet(f"{folder}/simulated_stops").collect()
        assert sorted((r.path_id, r.hop) for r in stops) == [(1, 1), (1, 2)] and all(r.p10 <= r.p50 <= r.p90 for r in stops)
        assert spark.read.parquet(f"{folder}/simulated_fan").filter("path_id = 1").count() == 3
    report = {(r.hop_position, r.start_bucket): r for r in flow.backtest(spark, folder, rotations=None, draws=50).collect()}
    assert 0 < report[None, None].covered_share <= 1
    assert report[None, None].hops == spark.read.parquet(f"{folder}/replay_coverage").count()


def test_missing_tables_are_named(spark, tmp_path):
    with pytest.raises(RuntimeError, match="flights, airport_timezones"):
        flow.propagate(spark, str(tmp_path))


def test_reference_nulls(spark, files):
    ref = read_airport_reference(spark, str(files / "airports.dat"))
    assert ref.filter("iata IS NULL").count() == 1


def test_append_by_key(spark):
    new = spark.createDataFrame([(2024, 1, "DL"), (2024, 1, "UA"), (2024, 2, "DL")], "Year int, Month int, Reporting_Airline string")
    assert sorted(tuple(r) for r in append_new_months(new, new.filter("Month = 1 AND Reporting_Airline = 'DL'")).collect()) == [(2024, 1, "UA"), (2024, 2, "DL")]


def test_stream(spark, files, tmp_path, sf_dir):
    for _ in range(2):
        watch_months(spark, str(files / "raw"), str(tmp_path / "flights"), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "flights"))
    want = derived.all_flights(spark, sf_dir).filter("Month <= 2 AND Reporting_Airline <> 'AA'")
    assert got.count() == want.count() > 0
