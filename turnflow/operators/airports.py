"""The airport dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def airport_lookup(reference: DataFrame) -> DataFrame:
    """iata, tz_name, lat, lon, name, city: rows with both codes, of each iata the one with the least airport_id."""
    first = F.row_number().over(Window.partitionBy("iata").orderBy("airport_id"))
    usable = reference.filter("iata IS NOT NULL AND tz_name IS NOT NULL").withColumn("_n", first).filter("_n = 1")
    return usable.select("iata", "tz_name", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), "name", "city")


def unmatched_airports(flights: DataFrame, airports: DataFrame) -> DataFrame:
    codes = flights.select(F.explode(F.array("Origin", "Dest")).alias("code")).filter("code IS NOT NULL").distinct()
    return codes.join(airports.select(F.col("iata").alias("code")), "code", "left_anti")
