"""Buckets, rounding, seeded draws and percentiles as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.constants import BUCKETS


def round2(x: Column) -> Column:
    return F.round(x * 100, 0) / 100


def delay_bucket(x: Column, buckets: Sequence = BUCKETS) -> Column:
    """The name of the closed range that holds the delay; null for null and for values between two ranges."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(buckets):
        inside = F.lit(True) if low is None else x >= low
        out = F.when(inside if high is None else inside & (x <= high), F.lit(name)).otherwise(out)
    return out


def bucket_bounds(spark: SparkSession, buckets: Sequence = BUCKETS) -> DataFrame:
    return spark.createDataFrame([(i, *b) for i, b in enumerate(buckets)], "bucket_no int, bucket string, bucket_low int, bucket_high int")


PRIME = 2147483647
#: multiplier and shift of each round
ROUNDS = ((48271, 15), (69621, 13), (39373, 16))


def sorted_percentile(values: Column, q: float) -> Column:
    """Linear interpolation between neighbours of an ascending array; null if it is empty."""
    r = F.lit(float(q)) * (F.size(values) - 1)
    low = F.floor(r).cast("int")
    here, after = F.get(values, low).cast("double"), F.get(values, F.least(low + 1, F.size(values) - 1)).cast("double")
    return F.when(F.size(values) > 0, here + (r - low) * (after - here))
