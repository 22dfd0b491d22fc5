"""Airport and route statistics of the propagation table: pre-aggregated sums per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnflow.constants import DEADBAND
from turnflow.functions.numbers import round2


def _kinds(x: Column, deadband: int) -> list[Column]:
    return [F.count_if(x > deadband).alias("amplify_events"), F.count_if(x < -deadband).alias("absorb_events"), F.count_if(F.abs(x) <= deadband).alias("neutral_events")]


def turn_legs(propagation: DataFrame) -> DataFrame:
    """Legs after a turn of the same day; a turn of unknown length is none."""
    return propagation.filter("node_effect IS NOT NULL AND is_overnight_turn = false")


def airport_stats(propagation: DataFrame, deadband: int = DEADBAND) -> DataFrame:
    x = F.col("node_effect")
    per = turn_legs(propagation).groupBy(F.col("prev_dest").alias("airport"))
    return per.agg(F.count("*").alias("turn_events"), round2(F.avg(x)).alias("avg_node_effect"), round2(F.percentile(x, 0.5)).alias("median_node_effect"), *_kinds(x, deadband))


def route_stats(propagation: DataFrame, deadband: int = DEADBAND) -> DataFrame:
    x = F.col("edge_effect_delay")
    per = propagation.groupBy(F.col("Origin").alias("origin"), F.col("Dest").alias("dest"))
    return per.agg(F.count("*").alias("flights"), round2(F.avg(x)).alias("avg_edge_effect_delay"), round2(F.avg("edge_effect_schedule")).alias("avg_edge_effect_schedule"), *_kinds(x, deadband))
