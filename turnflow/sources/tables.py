"""Tables that are replaced as a whole, and what the jobs expect of those that they read.

A new version is written beside the table, under a hidden name, and takes its place by a rename once it is whole. A job that is lost
while it writes leaves the old version; one that is lost between the two renames is carried on by the next job or check
that touches the table (`recover`). The serving tables are one folder that is replaced at once, so that they always agree.
One job writes a table at a time.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.functions.files import Files

_POOL = {"bucket": "string", "bucket_low": "int", "bucket_high": "int", "is_fallback": "boolean"}
_EVENTS = {"amplify_events": "bigint", "absorb_events": "bigint", "neutral_events": "bigint"}
#: Columns that the jobs read of each table, with their types.
CONTRACTS: dict[str, dict[str, str]] = {
    "flights": {
        "Year": "int", "Month": "int", "FlightDate": "date", "Reporting_Airline": "string", "Tail_Number": "string", "Flight_Number_Reporting_Airline": "bigint", "Origin": "string", "Dest": "string",
        "CRSDepTime": "bigint", "DepTime": "bigint", "ArrTime": "bigint", "DepDelayMinutes": "double", "ArrDelayMinutes": "double", "CRSElapsedTime": "bigint", "ActualElapsedTime": "bigint", "Cancelled": "int", "Diverted": "int",
    },
    "airport_timezones": {"iata": "string", "tz_name": "string", "lat": "double", "lon": "double", "name": "string", "city": "string"},
    "flights_propagation": {
        "Tail_Number": "string", "flight_number": "bigint", "FlightDate": "date", "operating_day": "date", "Origin": "string", "Dest": "string", "prev_dest": "string", "DepDelayMinutes": "double", "ArrDelayMinutes": "double",
        "prev_arr_delay": "double", "rotation_leg_number": "int", "node_effect": "double", "is_overnight_turn": "boolean",
    },
    "airport_stats": {"airport": "string", "turn_events": "bigint", "avg_node_effect": "double", "median_node_effect": "double", **_EVENTS},
    "route_stats": {"origin": "string", "dest": "string", "flights": "bigint", "avg_edge_effect_delay": "double", "avg_edge_effect_schedule": "double", **_EVENTS},
    "network_node_delay_distributions": {"bucket": "string", "dep_delay_samples": "array<int>"},
    "node_delay_distributions": {"airport": "string", **_POOL, "dep_delay_samples": "array<int>"},
    "network_edge_delay_distributions": {"bucket": "string", "arr_delay_samples": "array<int>"},
    "edge_delay_distributions": {"origin": "string", "dest": "string", **_POOL, "arr_delay_samples": "array<int>"},
}


def _beside(path: str, what: str) -> str:
    folder, name = posixpath.split(path.rstrip("/"))
    return posixpath.join(folder, f".{name}.{what}")


def recover(spark: SparkSession, path: str) -> None:
    """Ends what a lost job began: a version that was whole takes its place, one that wasn't goes."""
    files, new, old = Files(spark, path), _beside(path, "next"), _beside(path, "old")
    if not files.exists(path) and files.exists(old):
        files.rename(new if files.exists(new) else old, path)
    for left in (new, old):
        files.delete(left)


def _switch(spark: SparkSession, path: str) -> None:
    """The version written beside takes the table's place."""
    files, new, old = Files(spark, path), _beside(path, "next"), _beside(path, "old")
    if files.exists(path):
        files.rename(path, old)
    files.rename(new, path)
    files.delete(old)


def rebuild_table(df: DataFrame, path: str, files: int | None = None) -> None:
    """Replaces a derived table as a whole; small ones go into so many files. df may read the table that it replaces."""
    recover(df.sparkSession, path)
    (df.repartition(files) if files else df).write.parquet(_beside(path, "next"))
    _switch(df.sparkSession, path)


def export_bundle(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Replaces a folder of small tables at once. It must not hold anything else."""
    spark = next(iter(tables.values())).sparkSession
    recover(spark, folder)
    others = [n for n in Files(spark, folder).names(folder) if n not in tables and not n.startswith((".", "_"))]
    if others:
        raise ValueError(f"{folder} holds more than the bundle: {', '.join(others)}")
    for name, df in tables.items():
        df.repartition(1).write.parquet(posixpath.join(_beside(folder, "next"), name))
    _switch(spark, folder)


def table_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None if there is none or only an empty folder. Any other fault is the caller's to see."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def require_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    """Fails with the names of all tables that aren't there and of all columns that a job needs and that are missing or of another type."""
    missing, wrong = [], []
    for name in names:
        path = f"{folder.rstrip('/')}/{name}"
        recover(spark, path)
        found = table_there(spark, path)
        if found is None:
            missing.append(name)
            continue
        has = {c.lower(): kind for c, kind in found.dtypes}
        for c, kind in CONTRACTS.get(name, {}).items():
            if has.get(c.lower()) != kind:
                wrong.append(f"{name}.{c} ({kind}) is {has.get(c.lower(), 'missing')}")
    if missing:
        raise RuntimeError(f"missing tables in {folder}: {', '.join(missing)}" + (f"; {', '.join(wrong)}" if wrong else ""))
    if wrong:
        raise RuntimeError(f"tables in {folder} lack what the job reads: {', '.join(wrong)}")


def empty_like(df: DataFrame) -> DataFrame:
    return df.filter(F.lit(False))
