"""Files by their own headers, loads that are lost half way, tables that are replaced, and what jobs expect of them."""

from __future__ import annotations

import gzip

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from turnflow.functions.stage import stage_scope, stored
from turnflow.jobs import flow
from turnflow.sources import ledger as L
from turnflow.sources import tables as T
from turnflow.sources.ledger import ledger, load_files
from turnflow.sources.ontime import header_groups, read_ontime
from turnflow.streaming.months import watch_months

FIRST = "Year,Month,Reporting_Airline,Origin,Dest,Unnamed: 9\n2024,1,DL,BOS,SEA,\n2024,1,UA,BOS,JFK,\n2024,1,AA,BOS,JFK,\n"
SECOND = '"Year","Month","Dest","Origin","Reporting_Airline","Tail_Number"\r\n2024,2,SEA,BOS,DL," N1 "\r\n'


@pytest.fixture
def folder(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.csv").write_text(FIRST)
    (raw / "b [1] 50%.csv").write_text(SECOND)
    (raw / "c.csv").write_text("﻿" + FIRST.replace("2024,1", "2024,3"))
    with gzip.open(raw / "d.csv.gz", "wt") as f:
        f.write(FIRST.replace("2024,1", "2024,4"))
    (raw / "empty.csv").write_text("")
    return raw


def ends(df):
    return sorted((int(r.Month), r.Origin, r.Dest, r.Reporting_Airline) for r in df.collect())


WANT = [(m, "BOS", d, c) for m in (1, 3, 4) for d, c in (("JFK", "AA"), ("JFK", "UA"), ("SEA", "DL"))] + [(2, "BOS", "SEA", "DL")]


def test_columns_by_name(spark, folder):
    whole = read_ontime(spark, str(folder))
    assert ends(whole) == sorted(WANT)
    assert ends(read_ontime(spark, [str(folder / "a.csv"), str(folder / "[b-d]*")])) == sorted(WANT)
    assert [r.Tail_Number for r in whole.filter("Month = 2").collect()] == [" N1 "]
    groups = header_groups(spark, str(folder))
    assert sorted(len(files) for _, files in groups) == [1, 3]  # the mark at the start of c.csv is no part of a name
    with pytest.raises(ValueError, match="no file with a header"):
        read_ontime(spark, str(folder / "empty.csv"))


def loaded(spark, flights):
    return sorted((r.Year, r.Month, r.Reporting_Airline, r.Dest) for r in spark.read.parquet(flights).collect())


ALL = sorted((2024, m, c, d) for m, _, d, c in WANT if c != "AA")


def test_stream_by_name(spark, folder, tmp_path):
    flights, marks = str(tmp_path / "t/flights"), str(tmp_path / "marks")
    watch_months(spark, str(folder), flights, marks, files_at_once=2).awaitTermination()
    assert loaded(spark, flights) == ALL
    (folder / "again.csv").write_text(FIRST.replace("JFK", "LAX"))  # more of month 1, later
    watch_months(spark, str(folder), flights, marks).awaitTermination()
    assert loaded(spark, flights) == sorted([*ALL, (2024, 1, "UA", "LAX"), (2024, 1, "DL", "SEA")])
    for _ in range(2):  # a batch that is run again
        assert load_files(spark, [str(folder / "a.csv"), str(folder / "again.csv")], flights, again="add").loaded == 0


def test_load_is_told(spark, folder, tmp_path):
    flights = str(tmp_path / "t/flights")
    (folder / "other.csv").write_text(FIRST.replace("DL", "B6").replace("UA", "B6"))
    first = load_files(spark, str(folder), flights)
    told = {f.file.rpartition("/")[2]: f for f in first.files}
    assert (first.loaded, first.skipped, first.known_files) == (len(ALL), 0, 0)
    assert told["a.csv"].loaded == 2 and "Tail_Number" in told["a.csv"].missing and "Tail_Number" not in told["b [1] 50%.csv"].missing
    assert [f.rpartition("/")[2] for f in first.without_rows] == ["other.csv"]
    again = load_files(spark, str(folder), flights)
    assert (again.loaded, again.skipped, again.known_files, again.files) == (0, 0, 5, [])
    (folder / "twin.csv").write_text(FIRST)
    twin = load_files(spark, str(folder), flights)
    assert (twin.loaded, twin.skipped, twin.known_files) == (0, 2, 5)
    more = load_files(spark, str(folder), flights, carriers=("DL", "UA", "AA", "B6"))  # carriers that are added later come from old files too
    assert loaded(spark, flights) == sorted([*ALL, *[(2024, m, "AA", "JFK") for m in (1, 3, 4)] + [(2024, 1, "AA", "JFK")] * 2, (2024, 1, "B6", "SEA"), (2024, 1, "B6", "JFK")])
    assert more.loaded == 7 and more.skipped == len(ALL) + 2
    entered = ledger(spark, flights).select(F.explode("months").alias("m")).agg(F.sum("m.rows")).first()[0]
    assert entered == spark.read.parquet(flights).count()


class Lost(Exception):
    pass


def test_lost_before_the_entry(spark, folder, tmp_path, monkeypatch):
    """Rows that were only set aside are dropped, and the month is loaded as a whole."""
    flights = str(tmp_path / "t/flights")
    with monkeypatch.context() as m:
        m.setattr(L.Files, "write", lambda *_: (_ for _ in ()).throw(Lost()))
        with pytest.raises(Lost):
            load_files(spark, str(folder), flights)
    assert not (tmp_path / "t/flights").exists() and list((tmp_path / "t/flights_staging").iterdir())
    assert load_files(spark, str(folder), flights).loaded == len(ALL)
    assert loaded(spark, flights) == ALL


def test_lost_while_moving(spark, folder, tmp_path, monkeypatch):
    """A half-moved load is completed by the next, which loads nothing twice."""
    flights, real, moved = str(tmp_path / "t/flights"), L.Files.rename, []

    def rename(self, path, to):
        if "_staging/" in path:
            if len(moved) == 2:
                raise Lost
            moved.append(path)
        real(self, path, to)

    with monkeypatch.context() as m:
        m.setattr(L.Files, "rename", rename)
        with pytest.raises(Lost):
            load_files(spark, str(folder), flights)
    assert 0 < len(loaded(spark, flights)) < len(ALL)
    assert load_files(spark, str(folder), flights).known_files == 4
    assert loaded(spark, flights) == ALL
    assert not (tmp_path / "t/flights_staging").exists() or not list((tmp_path / "t/flights_staging").iterdir())


def test_table_from_before_the_ledger(spark, folder, tmp_path):
    flights = str(tmp_path / "t/flights")
    spark.createDataFrame([(2024, 1, "DL", "OLD")], "Year int, Month int, Reporting_Airline string, Dest string").write.partitionBy("Year", "Month").parquet(flights)
    first = load_files(spark, str(folder / "a.csv"), flights)
    assert (first.loaded, first.skipped) == (1, 1)
    assert load_files(spark, str(folder), flights).loaded == len(ALL) - 2
    assert loaded(spark, flights) == sorted([(2024, 1, "DL", "OLD"), *[x for x in ALL if x[:3] != (2024, 1, "DL")]])


def rows(spark, path):
    return sorted(r.x for r in spark.read.parquet(path).collect())


def test_failing_write_keeps_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    T.rebuild_table(spark.range(5).withColumnRenamed("id", "x"), path)
    bad = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("x"))
    with pytest.raises(PySparkException, match="lost"):
        T.rebuild_table(bad, path)
    assert rows(spark, path) == [0, 1, 2, 3, 4]
    T.rebuild_table(spark.read.parquet(path).selectExpr("x + 1 AS x"), path, files=1)  # made of itself
    assert rows(spark, path) == [1, 2, 3, 4, 5]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_lost_between_renames(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "airport_stats"), T.Files.rename
    frame = lambda n: spark.range(n).withColumnRenamed("id", "x")
    T.rebuild_table(frame(2), path)
    with monkeypatch.context() as m:
        m.setattr(T.Files, "rename", lambda self, a, b: real(self, a, b) if a == path else (_ for _ in ()).throw(Lost()))
        with pytest.raises(Lost):
            T.rebuild_table(frame(3), path)
    assert not (tmp_path / "airport_stats").exists()
    T.recover(spark, path)
    assert rows(spark, path) == [0, 1, 2]
    T.rebuild_table(frame(1), path)
    assert rows(spark, path) == [0]


def test_bundle_agrees(spark, tmp_path):
    to = str(tmp_path / "out")
    pair = lambda n: {k: spark.range(n).withColumnRenamed("id", "x") for k in ("a", "b")}
    T.export_bundle(pair(2), to)
    bad = pair(3) | {"b": spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("x"))}
    with pytest.raises(PySparkException, match="lost"):
        T.export_bundle(bad, to)
    assert rows(spark, f"{to}/a") == rows(spark, f"{to}/b") == [0, 1]
    T.export_bundle(pair(4), to)
    assert rows(spark, f"{to}/a") == rows(spark, f"{to}/b") == [0, 1, 2, 3]
    (tmp_path / "out/notes").mkdir()
    with pytest.raises(ValueError, match="notes"):
        T.export_bundle(pair(1), to)


def test_contracts(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([("N01", "UTC", 1.0, "n", "c")], "iata string, tz_name string, lat double, name string, city string").write.parquet(f"{folder}/airport_timezones")
    with pytest.raises(RuntimeError, match=r"missing tables in .*: flights; airport_timezones.lon \(double\) is missing"):
        T.require_tables(spark, folder, ["flights", "airport_timezones"])
    with pytest.raises(RuntimeError, match="airport_timezones.lon"):
        T.require_tables(spark, folder, ["airport_timezones"])
    spark.createDataFrame([("N01", 1)], "iata string, lon int").write.mode("overwrite").parquet(f"{folder}/airport_timezones")
    with pytest.raises(RuntimeError, match=r"lon \(double\) is int"):
        T.require_tables(spark, folder, ["airport_timezones"])
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/x.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        T.require_tables(spark, folder, ["broken"])  # there, but broken: not called missing


def test_scope_deletes_its_own(spark):
    before = stored(spark.range(3), "kept")
    with stage_scope(spark):
        within = stored(spark.range(4), "gone")
        assert within.count() == 4
    assert before.count() == 3
    with pytest.raises(Exception, match="does not exist"):
        within.count()


def test_reports_of_jobs(spark, sf_dir, tmp_path):
    """The jobs tell, of what they write, the counts that a second scan would give."""
    from turnflow.operators import airports as A
    from turnflow.operators import cleaning as C
    from turnflow.operators import enrich as E
    from turnflow.sources import derived

    folder = str(tmp_path)
    flights, places = C.clean_flights(derived.raw_flights(spark, sf_dir)), A.airport_lookup(derived.airports(spark, sf_dir))
    flights.write.parquet(f"{folder}/flights")
    places.write.parquet(f"{folder}/airport_timezones")
    told = flow.propagate(spark, folder).first()
    assert told.missing_timezones == E.missing_timezone_count(E.attach_timezones(flights, places)).first()[0] > 0
    assert told.unmatched_airports == [r.code for r in A.unmatched_airports(flights, places).collect()] == ["N24"]
    enriched = spark.read.parquet(f"{folder}/flights_enriched")
    assert tuple(told)[:3] == tuple(E.arrival_reconciliation(enriched).first())
    flow.distribute(spark, folder)
    report = flow.backtest(spark, folder, rotations=None, draws=20).collect()
    legs = spark.read.parquet(f"{folder}/flights_propagation")
    n = legs.filter("Tail_Number IS NOT NULL AND operating_day IS NOT NULL").groupBy("Tail_Number", "operating_day").count().filter("count >= 2").count()
    assert {(r.replayed_rotations, r.skipped_rotations) for r in report} == {(report[0].replayed_rotations, n - report[0].replayed_rotations)}
    assert report[0].replayed_rotations > 0
