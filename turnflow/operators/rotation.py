"""Legs of an aircraft chained in time, and what each turn and each flight did to the delay.

Everything up to the running sums needs one shuffle, by aircraft. The minimum turns are a pre-aggregated shuffle over
the chained legs; their table has one row per airport.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnflow.constants import MAX_TURN, MIN_TURN, MIN_TURN_SAMPLES, MIN_TURN_SHARE
from turnflow.functions.when import minutes_between, operating_day
from turnflow.operators.segments import SEGMENT, in_segments, lagged, running

#: Equal departure times are taken in this order.
IN_TIME = ("DepTimestampUTC", "Flight_Number_Reporting_Airline", "Origin", "Dest")
LAGGED = {"lag_dest": "Dest", "lag_arr_delay": "ArrDelayMinutes", "lag_flight_number": "Flight_Number_Reporting_Airline", "lag_arr_utc": "ArrTimestampUTC", "lag_crs_arr_utc": "CRSArrTimestampUTC"}
CHAINED = {"prev_dest": "lag_dest", "prev_arr_delay": "lag_arr_delay", "prev_flight_number": "lag_flight_number", "prev_arr_timestamp_utc": "lag_arr_utc", "prev_crs_arr_timestamp_utc": "lag_crs_arr_utc"}
PROPAGATION = (
    "Reporting_Airline", "Tail_Number", "flight_number", "prev_flight_number", "Origin", "Dest", "prev_dest", "FlightDate", "operating_day",
    "DepTimestampUTC", "ArrTimestampUTC", "DepDelayMinutes", "ArrDelayMinutes", "prev_arr_delay", "is_first_leg", "rotation_leg_number",
    "node_effect", "edge_effect_delay", "edge_effect_schedule", "scheduled_turn_min", "is_overnight_turn", "empirical_min_turn_min",
    "min_turn_is_fallback", "scheduled_buffer", "propagated_delay", "cumulative_node_delay",
)


def completed_legs(enriched: DataFrame) -> DataFrame:
    return enriched.filter("Cancelled = 0 AND Diverted = 0 AND DepTimestampUTC IS NOT NULL AND ArrTimestampUTC IS NOT NULL")


def previous_leg(completed: DataFrame, null_tail: str = "chain", segments: int | None = None) -> DataFrame:
    """Adds the last leg's values and the operating day. Legs without a tail number count as one aircraft with
    'chain'; with 'isolate' each is a start of its own and they don't meet in one task. No aircraft flies enough legs to burden a task, but those without a
    number may: with `segments` they are chained in so many ranges of time, to the same result, and keep the number of theirs in `_segment`."""
    w = Window.partitionBy("Tail_Number").orderBy(*IN_TIME)
    df = completed.withColumn("operating_day", operating_day(F.col("DepTimestampUTC"), F.col("origin_tz")))
    add = lambda d: d.select("*", *[F.lag(x).over(w).alias(to) for to, x in LAGGED.items()])
    if null_tail == "chain" and segments is None:
        return add(df)
    named, unnamed = add(df.filter("Tail_Number IS NOT NULL")), df.filter("Tail_Number IS NULL")
    if null_tail == "chain":
        ranged = in_segments(unnamed, ["Tail_Number"], IN_TIME, segments)
        return named.withColumn(SEGMENT, F.lit(None).cast("int")).unionByName(lagged(ranged, ["Tail_Number"], IN_TIME, LAGGED))
    return named.union(unnamed.select("*", *[F.lit(None).cast(df.schema[x].dataType).alias(to) for to, x in LAGGED.items()]))


def chain_legs(lagged: DataFrame) -> DataFrame:
    """The last leg counts only if it landed where this one starts."""
    goes_on = F.col("lag_dest") == F.col("Origin")
    return lagged.select(
        *[c for c in lagged.columns if c not in LAGGED],
        *[F.when(goes_on, F.col(x)).alias(to) for to, x in CHAINED.items()],
        (F.col("lag_dest").isNull() | (F.col("lag_dest") != F.col("Origin"))).alias("is_first_leg"),
    )


def _of_day() -> Window:
    return Window.partitionBy("Tail_Number", "operating_day").orderBy(*IN_TIME)


def rotation_leg_number() -> Column:
    return F.row_number().over(_of_day())


def node_effect() -> Column:
    return F.when(~F.col("is_first_leg"), F.col("DepDelayMinutes") - F.col("prev_arr_delay"))


def edge_effect_delay() -> Column:
    return F.col("ArrDelayMinutes") - F.col("DepDelayMinutes")


def edge_effect_schedule() -> Column:
    return F.col("ActualElapsedTime") - F.col("CRSElapsedTime")


def scheduled_turn_min() -> Column:
    return minutes_between(F.col("prev_crs_arr_timestamp_utc"), F.col("CRSDepTimestampUTC"))


def is_overnight_turn(longest: int = MAX_TURN) -> Column:
    return ~F.col("is_first_leg") & (scheduled_turn_min() > longest)


def _own_effect() -> Column:
    return F.when(F.col("is_first_leg"), F.lit(0.0)).otherwise(F.col("DepDelayMinutes") - F.col("prev_arr_delay"))


def cumulative_node_delay() -> Column:
    return F.sum(_own_effect()).over(_of_day().rowsBetween(Window.unboundedPreceding, Window.currentRow))


def operational_turns(chained: DataFrame, shortest: int = MIN_TURN, longest: int = MAX_TURN) -> DataFrame:
    turns = chained.filter("prev_dest IS NOT NULL").select(F.col("prev_dest").alias("turn_airport"), scheduled_turn_min().alias("sched_turn_min"))
    return turns.filter(F.col("sched_turn_min").between(shortest, longest))


def network_min_turn(turns: DataFrame, share: float = MIN_TURN_SHARE) -> DataFrame:
    return turns.agg(F.percentile("sched_turn_min", share).alias("default_min_turn_min"))


def airport_min_turn(turns: DataFrame, share: float = MIN_TURN_SHARE) -> DataFrame:
    return turns.groupBy("turn_airport").agg(F.count("*").alias("turn_sample_size"), F.percentile("sched_turn_min", share).alias("airport_min_turn_min"))


def min_turn_blend(turns: DataFrame, samples: int = MIN_TURN_SAMPLES) -> DataFrame:
    """An airport's own minimum turn from so many samples on, else the network's, which is one row."""
    own = airport_min_turn(turns).crossJoin(F.broadcast(network_min_turn(turns)))
    enough = F.col("turn_sample_size") >= samples
    return own.select("turn_airport", "turn_sample_size", F.when(enough, F.col("airport_min_turn_min")).otherwise(F.col("default_min_turn_min")).alias("empirical_min_turn_min"), (~enough).alias("min_turn_is_fallback"))


def chained_legs(enriched: DataFrame, null_tail: str = "chain", segments: int | None = None) -> DataFrame:
    return chain_legs(previous_leg(completed_legs(enriched), null_tail, segments))


def with_effects(chained: DataFrame) -> DataFrame:
    """All columns that need the chained legs alone. Legs that were chained in segments are numbered and summed in them."""
    alone = {
        "flight_number": F.col("Flight_Number_Reporting_Airline"),
        "node_effect": node_effect(),
        "edge_effect_delay": edge_effect_delay(),
        "edge_effect_schedule": edge_effect_schedule(),
        "scheduled_turn_min": scheduled_turn_min(),
        "is_overnight_turn": is_overnight_turn(),
    }
    in_day = {"rotation_leg_number": rotation_leg_number(), "cumulative_node_delay": cumulative_node_delay()}
    if SEGMENT not in chained.columns:
        return chained.select("*", *[c.alias(to) for to, c in (alone | in_day).items()])
    whole = chained.filter(F.col(SEGMENT).isNull()).select("*", *[c.alias(to) for to, c in in_day.items()])
    parts = running(chained.filter(F.col(SEGMENT).isNotNull()), ["Tail_Number", "operating_day"], IN_TIME, "rotation_leg_number", {"cumulative_node_delay": _own_effect()})
    return whole.unionByName(parts).drop(SEGMENT).withColumns(alone)


def with_buffers(effects: DataFrame, min_turn: DataFrame) -> DataFrame:
    df = effects.join(min_turn.drop("turn_sample_size").withColumnRenamed("turn_airport", "prev_dest"), "prev_dest", "left")
    buffer = F.col("scheduled_turn_min") - F.col("empirical_min_turn_min")
    late = F.greatest(F.lit(0.0), F.col("prev_arr_delay") - buffer)
    return df.withColumns({"scheduled_buffer": F.when(~F.col("is_first_leg"), buffer), "propagated_delay": F.when(~F.col("is_first_leg"), late)})


def build_propagation(chained: DataFrame) -> DataFrame:
    """All columns of the propagation table. chained is read twice: hand over a stored table."""
    return with_buffers(with_effects(chained), min_turn_blend(operational_turns(chained))).select(*PROPAGATION)
