"""Helpers shared by the corpus operators: reading tables, cutting lineage, text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.functions.stage import stored

__all__ = ["SPACE", "WORD", "n_words", "small", "stored", "table", "unit", "words"]

#: A word is a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def unit(seed: int, *parts: Column) -> Column:
    """A draw in (0, 1) from the first 52 bits of an MD5 of seed and parts; the same in any SQL engine."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    head = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double")
    return (head + F.lit(0.5)) / F.lit(float(2**52))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marks a stored table for broadcasting if it has no more than so many rows; else the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df
