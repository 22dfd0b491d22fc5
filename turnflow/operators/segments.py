"""Scans along one long key in many tasks: its rows are cut into ranges of their order, each range is scanned apart, and what the
scan would carry over a boundary is added from a small table with a row for each key and range."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnflow.functions.stage import stored

SEGMENT = "_segment"


def in_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], segments: int) -> DataFrame:
    """df, stored, with the number of the range of (keys, order) that a row lies in. Spark samples the rows for ranges of even size; rows of equal
    keys and order share one."""
    return stored(df.repartitionByRange(segments, *keys, *order).withColumn(SEGMENT, F.spark_partition_id()), "segments")


def _beside(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with what its key carries into its segment; null keys are keys."""
    names = [*keys, SEGMENT]
    carried = carried.withColumnsRenamed({k: f"_of_{k}" for k in names})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in names])
    return rows.join(carried, same, "left").drop(*[f"_of_{k}" for k in names])


def lagged(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Rows in segments with the value of each column in the row before, as `lag` over the whole key gives it. columns: name to source."""
    w = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    within = rows.select("*", *[F.lag(x).over(w).alias(to) for to, x in columns.items()], (F.row_number().over(w) == 1).alias("_first"))
    last = F.max_by(F.struct(*[F.col(x).alias(to) for to, x in columns.items()]), F.struct(*order)).alias("_last")
    ends = rows.groupBy(*keys, SEGMENT).agg(last)
    carried = ends.select(*keys, SEGMENT, F.lag("_last").over(Window.partitionBy(*keys).orderBy(SEGMENT)).alias("_before"))
    out = _beside(within, carried, keys)
    return out.withColumns({to: F.when(F.col("_first"), F.col(f"_before.{to}")).otherwise(F.col(to)) for to in columns}).drop("_first", "_before")


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], number: str, sums: Mapping[str, Column]) -> DataFrame:
    """Rows in segments with their number in the key's order, and with running sums, as windows over the whole key give them."""
    w = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.select("*", F.row_number().over(w).alias(number), *[F.sum(x).over(upto).alias(to) for to, x in sums.items()])
    totals = rows.groupBy(*keys, SEGMENT).agg(F.count("*").alias("_n"), *[F.sum(x).alias(f"_{to}") for to, x in sums.items()])
    before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, SEGMENT, F.sum("_n").over(before).alias("_n"), *[F.sum(f"_{to}").over(before).alias(f"_{to}") for to in sums])
    out = _beside(within, carried, keys)
    added = {to: F.when(F.col(to).isNull(), F.col(f"_{to}")).otherwise(F.col(to) + F.coalesce(F.col(f"_{to}"), F.lit(0))) for to in sums}
    return out.withColumns({number: (F.col(number) + F.coalesce("_n", F.lit(0))).cast("int"), **added}).drop("_n", *[f"_{to}" for to in sums])
