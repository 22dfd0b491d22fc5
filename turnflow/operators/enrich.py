"""Local clock times to UTC. The airport table is a dimension; Spark broadcasts it while it is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnflow.functions.when import local_hhmm, localize_to_utc, plus_minutes


def attach_timezones(flights: DataFrame, airports: DataFrame) -> DataFrame:
    zone = lambda code, to: airports.select(F.col("iata").alias(code), F.col("tz_name").alias(to))
    return flights.join(zone("Origin", "origin_tz"), "Origin", "left").join(zone("Dest", "dest_tz"), "Dest", "left")


def without_timezone() -> Column:
    """Of attached flights, how many ends have no zone."""
    return F.count_if(F.col("origin_tz").isNull()) + F.count_if(F.col("dest_tz").isNull())


def codes_without_timezone() -> dict[str, Column]:
    """The distinct airports of attached flights that have no zone, at either end."""
    return {f"no_{end}": F.collect_set(F.when(F.col(zone).isNull(), F.col(code))) for end, zone, code in (("origin", "origin_tz", "Origin"), ("dest", "dest_tz", "Dest"))}


def missing_timezone_count(attached: DataFrame) -> DataFrame:
    return attached.agg(without_timezone().alias("missing_timezones"))


def scheduled_utc(attached: DataFrame) -> DataFrame:
    dep = localize_to_utc(F.col("FlightDate"), F.col("CRSDepTime"), F.col("origin_tz"))
    df = attached.withColumn("CRSDepTimestampUTC", dep)
    return df.withColumn("CRSArrTimestampUTC", plus_minutes(F.col("CRSDepTimestampUTC"), F.col("CRSElapsedTime").cast("int")))


def actual_utc(attached: DataFrame, rollover: bool = False) -> DataFrame:
    """DepTime counts on the flight's date. With rollover it counts on the next day if it is more than 12 hours before
    the scheduled time."""
    day = F.col("FlightDate")
    if rollover:
        minutes = lambda c: F.floor(F.col(c) / 100) * 60 + F.col(c) % 100
        day = F.when(minutes("CRSDepTime") - minutes("DepTime") > 720, F.date_add(day, 1)).otherwise(day)
    df = attached.withColumn("DepTimestampUTC", localize_to_utc(day, F.col("DepTime"), F.col("origin_tz")))
    return df.withColumn("ArrTimestampUTC", plus_minutes(F.col("DepTimestampUTC"), F.col("ActualElapsedTime").cast("int")))


def enrich_flights(flights: DataFrame, airports: DataFrame, rollover: bool = False) -> DataFrame:
    return actual_utc(scheduled_utc(attach_timezones(flights, airports)), rollover)


def reconciled() -> dict[str, Column]:
    """How many arrivals, turned back to local HHMM, equal the reported ArrTime."""
    back = local_hhmm(F.col("ArrTimestampUTC"), F.col("dest_tz"))
    both = back.isNotNull() & F.col("ArrTime").isNotNull()
    return {"checked": F.count_if(both), "matching": F.count_if(both & (back == F.col("ArrTime"))), "mismatching": F.count_if(both & (back != F.col("ArrTime")))}


def arrival_reconciliation(enriched: DataFrame) -> DataFrame:
    return enriched.agg(*[c.alias(name) for name, c in reconciled().items()])
