"""Readers of monthly records and of the airport reference, and appends by month."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.sources.sheets import is_sheet, read_sheets, sheet_headers

MONTH = ("Year", "Month", "Reporting_Airline")
AIRPORT_FILE = "airport_id long, name string, city string, country string, iata string, icao string, lat double, lon double, alt double, utc_offset string, dst string, tz_name string, type string, source string"
#: Larger than any file: with it each file is one task.
WHOLE = str(1 << 50)


def literal(path: str) -> str:
    """A path as a pattern that only it fits."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _decoded(path):
    """The path that Spark's metadata column gives in URL encoding."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def listed_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, length of all files at the paths; none is read."""
    return spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths)).select(F.col("path").alias("file"), "length")


def headers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, header: the first line of each text file that has one. Each file is a task of its own, which ends after that line."""
    apart = spark.newSession()
    for setting, value in (("files.maxPartitionBytes", WHOLE), ("files.openCostInBytes", WHOLE), ("execution.arrow.maxRecordsPerBatch", "1")):
        apart.conf.set(f"spark.sql.{setting}", value)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    lines = apart.read.text([paths] if isinstance(paths, str) else list(paths)).filter(~is_sheet(F.col("_metadata.file_path"))).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("header"))
    line = F.regexp_replace("header", "^﻿|\r$", "")
    return lines.mapInArrow(first, "file string, header string").select(_decoded(F.col("file")).alias("file"), line.alias("header"))


def header_groups(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[str, list[str]]]:
    """The distinct headers, in order, with their files, text files and workbooks apart. Spark's own readers keep the list of files on the driver too."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    every = [r for found in (headers(spark, paths), sheet_headers(spark, paths)) for r in found.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()]
    return sorted((r.header, r.files) for r in every)


def read_group(spark: SparkSession, header: str, files: Sequence[str], source: str | None = None) -> DataFrame:
    """Files of one header, all text; a file with another one is an error. With `source`, a column of that name has each row's file."""
    if files[0].lower().endswith(".xlsx"):
        return read_sheets(spark, [literal(f) for f in files], header, source)
    df = spark.read.option("header", True).option("enforceSchema", False).csv([literal(f) for f in files])
    return df.withColumn(source, _decoded(F.col("_metadata.file_path"))) if source else df


def read_ontime(spark: SparkSession, paths: str | Sequence[str], source: str | None = None) -> DataFrame:
    """CSV exports and workbooks with a header, all text: files, folders or patterns. Columns are joined by name: files are grouped by their own
    headers, each group is read once, and columns that a group lacks are null in its rows."""
    groups = header_groups(spark, paths)
    if not groups:
        raise ValueError(f"no file with a header in {paths}")
    return read_groups(spark, groups, source)


def read_groups(spark: SparkSession, groups: Sequence[tuple[str, list[str]]], source: str | None = None) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_group(spark, header, files, source) for header, files in groups])


def read_airport_reference(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AIRPORT_FILE).option("header", False).option("nullValue", "\\N").csv(path)


def append_new_months(new: DataFrame, loaded: DataFrame, keys: Sequence[str] = MONTH) -> DataFrame:
    """The rows of months and carriers that aren't loaded yet. loaded: distinct keys, a row per month and carrier. Null keys equal one another."""
    there = loaded.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return new.join(there, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")
