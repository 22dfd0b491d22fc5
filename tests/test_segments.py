"""One long key scanned in segments, beside the window over the whole key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from turnflow.operators import rotation as R
from turnflow.operators import segments as S

NY = "America/New_York"


def legs(spark, n, tails):
    """n legs in time, some at equal times, between three airports; tails: an expression of the id."""
    df = spark.range(n).selectExpr("id", f"{tails} AS Tail_Number", "CAST(id * 7919 % 1000003 AS BIGINT) AS Flight_Number_Reporting_Airline", "pmod(xxhash64(id), 3) AS o", "pmod(xxhash64(id, 1), 3) AS d")
    at = lambda m: F.timestamp_add("MINUTE", m.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    m = F.floor(F.col("id") / 3) * 2
    code = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    return df.select(
        "Tail_Number", "Flight_Number_Reporting_Airline", code("o").alias("Origin"), code("d").alias("Dest"), F.lit(NY).alias("origin_tz"), F.lit("DL").alias("Reporting_Airline"),
        F.lit(0).alias("Cancelled"), F.lit(0).alias("Diverted"), F.lit("2024-01-01").cast("date").alias("FlightDate"), (F.col("id") % 50).cast("double").alias("DepDelayMinutes"), (F.col("id") * 13 % 70).cast("double").alias("ArrDelayMinutes"),
        at(m).alias("DepTimestampUTC"), at(m + 40).alias("ArrTimestampUTC"), at(m - 5).alias("CRSDepTimestampUTC"), at(m + 30).alias("CRSArrTimestampUTC"), F.lit(40).cast("long").alias("ActualElapsedTime"), F.lit(35).cast("long").alias("CRSElapsedTime"),
    )


def digest(df):
    row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)])
    return df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.count_if("is_first_leg"), F.max("rotation_leg_number")).first()


@pytest.mark.parametrize("tails", ["CAST(NULL AS STRING)", "CASE WHEN id % 5 < 3 THEN NULL ELSE concat('T', id % 20) END"])
@pytest.mark.parametrize("segments", [1, 7, 40])
def test_equals_windows(spark, tails, segments):
    df = legs(spark, 6000, tails)
    want = R.with_effects(R.chained_legs(df))
    got = R.with_effects(R.chained_legs(df, "chain", segments))
    assert sorted(got.columns) == sorted(want.columns)
    assert digest(got) == digest(want)
    assert want.exceptAll(got.select(want.columns)).count() == 0


def test_a_million_legs_without_tail(spark):
    """They are chained, numbered and summed in many even tasks, as one window over all of them would."""
    df = legs(spark, 1_000_000, "CAST(NULL AS STRING)")
    chained = R.chained_legs(df, "chain", 24)
    held = [r[1] for r in chained.groupBy(S.SEGMENT).count().collect()]
    assert len(held) == 24 and max(held) < 2 * 1_000_000 / 24
    assert digest(R.with_effects(chained)) == digest(R.with_effects(R.chained_legs(df)))


def test_empty_and_single(spark):
    for n in (0, 1):
        df = legs(spark, n, "CAST(NULL AS STRING)")
        assert R.with_effects(R.chained_legs(df, "chain", 5)).count() == n


def test_null_values_are_carried(spark):
    """A null in the last row of a segment is carried as null, and sums go on over nulls."""
    rows = spark.createDataFrame([("k", i, None if i % 3 == 0 else i) for i in range(30)], "k string, t int, v int")
    ranged = S.in_segments(rows, ["k"], ["t"], 10)
    got = {r.t: r.p for r in S.lagged(ranged, ["k"], ["t"], {"p": "v"}).collect()}
    assert got == {i: None if i == 0 or (i - 1) % 3 == 0 else i - 1 for i in range(30)}
    sums = {r.t: (r.n, r.s) for r in S.running(ranged, ["k"], ["t"], "n", {"s": F.col("v")}).collect()}
    assert sums == {i: (i + 1, sum(j for j in range(i + 1) if j % 3) or None) for i in range(30)}
