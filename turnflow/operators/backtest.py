"""Calibration: real rotations replayed from their first departure delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnflow.constants import ROTATIONS
from turnflow.functions.numbers import delay_bucket


def sample_rotations(propagation: DataFrame, n: int | None = ROTATIONS, seed: str = "replay") -> DataFrame:
    """(Tail_Number, operating_day) of rotations of two legs at least: n by seeded hash, or all."""
    found = propagation.filter("Tail_Number IS NOT NULL AND operating_day IS NOT NULL").groupBy("Tail_Number", "operating_day").agg(F.count("*").alias("legs")).filter("legs >= 2")
    if n is None:
        return found
    key = F.md5(F.concat_ws("|", F.lit(seed), "Tail_Number", F.col("operating_day").cast("string")))
    return found.orderBy(key, "Tail_Number", "operating_day").limit(n)


def rotation_paths(propagation: DataFrame, rotations: DataFrame) -> DataFrame:
    """One row per rotation: path, actual arrival delays, departure delay of the first leg."""
    legs = propagation.join(rotations.select("Tail_Number", "operating_day"), ["Tail_Number", "operating_day"], "left_semi")
    leg = F.struct(F.col("rotation_leg_number").alias("n"), F.col("Origin").alias("o"), F.col("Dest").alias("d"), F.coalesce(F.col("ArrDelayMinutes"), F.lit(float("nan"))).alias("arr"), F.col("DepDelayMinutes").alias("dep"))
    per = legs.groupBy("Tail_Number", "operating_day").agg(F.sort_array(F.collect_list(leg)).alias("_l"))
    path = F.concat(F.array(F.col("_l")[0]["o"]), F.col("_l.d"))
    return per.select("Tail_Number", "operating_day", path.alias("path"), F.transform("_l.arr", lambda x: F.when(~F.isnan(x), x)).alias("actual"), F.col("_l")[0]["dep"].alias("start_delay"))


def usable_rotations(paths: DataFrame, known: DataFrame) -> DataFrame:
    """Adds is_usable: no delay is null and every stop between the ends has a distribution."""
    inner = paths.select("Tail_Number", "operating_day", F.explode(F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0)))).alias("airport"))
    bad = inner.join(known.select("airport").distinct(), "airport", "left_anti").select("Tail_Number", "operating_day").distinct().withColumn("_bad", F.lit(True))
    whole = F.col("start_delay").isNotNull() & ~F.exists("actual", lambda x: x.isNull())
    return paths.join(bad, ["Tail_Number", "operating_day"], "left").withColumn("is_usable", whole & F.col("_bad").isNull()).drop("_bad")


def replay_coverage(simulated: DataFrame) -> DataFrame:
    """One row per hop of rotations simulated with keep='percentiles' (`actual` beside `stops`): inside [p10, p90] or not."""
    hops = simulated.select("Tail_Number", "operating_day", delay_bucket(F.col("start_delay")).alias("start_bucket"), "actual", F.explode("stops").alias("s"))
    return hops.select("Tail_Number", "operating_day", F.col("s.hop").alias("hop_position"), "start_bucket", F.get("actual", F.col("s.hop") - 1).between(F.col("s.p10"), F.col("s.p90")).alias("covered"))


def coverage_report(records: DataFrame) -> DataFrame:
    """Share of covered hops over all, by hop and by start bucket, in one pass."""
    share = F.avg(F.col("covered").cast("int")).alias("covered_share")
    return records.groupingSets([[], ["hop_position"], ["start_bucket"]], "hop_position", "start_bucket").agg(share, F.count("*").alias("hops"))
