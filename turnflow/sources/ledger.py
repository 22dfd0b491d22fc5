"""Loads of monthly files into one table, each of them whole or not at all, and the ledger that says what is in it.

A load writes its rows aside, then its entry into the ledger by one rename: from then on it counts. Only after that its files are moved
into the table. A job that is lost before the entry leaves rows aside, which the next load drops; one that is lost after it leaves a
table that lacks some of them, which the next load moves first. One job loads at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from turnflow.constants import CARRIERS, KEEP
from turnflow.functions.files import Files
from turnflow.operators.cleaning import clean_flights, select_keep_columns
from turnflow.sources.ontime import MONTH, append_new_months, header_groups, listed_files, literal, read_group, read_groups
from turnflow.sources.tables import table_there

#: An entry of the ledger: a file of a load, what it lacked, and its rows by month and carrier.
ENTRY = "load string, file string, length long, carriers array<string>, missing array<string>, has_rows boolean, months array<struct<Year:int,Month:int,Reporting_Airline:string,rows:long>>"


@dataclass(frozen=True)
class LoadedFile:
    file: str
    missing: list[str]
    has_rows: bool
    loaded: int


@dataclass(frozen=True)
class Load:
    """What a load did: new rows; rows of months that were there; files that an earlier load has read; and each file read now, with the columns
    that it lacks, whether it has rows of the carriers, and how many of them are new."""

    loaded: int = 0
    skipped: int = 0
    known_files: int = 0
    files: list[LoadedFile] = field(default_factory=list)

    @property
    def without_rows(self) -> list[str]:
        return [f.file for f in self.files if not f.has_rows]


def ledger(spark: SparkSession, flights: str) -> DataFrame:
    """All entries; none for a table that no load has written."""
    path = f"{flights.rstrip('/')}_ledger"
    if not Files(spark, path).names(path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json(path)


def carry_on(spark: SparkSession, flights: str) -> None:
    """Moves what committed loads have left aside into the table, and drops what others have."""
    top = flights.rstrip("/")
    files = Files(spark, top)
    committed = {n.removesuffix(".json") for n in files.names(f"{top}_ledger")}
    for load in files.names(f"{top}_staging"):
        aside = f"{top}_staging/{load}"
        for name in files.below(aside) if load in committed else []:
            where, _, last = name.rpartition("/")
            if last.startswith("part-"):
                files.rename(f"{aside}/{name}", f"{top}/{where.rpartition('/_file=')[0]}/{load}-{where.rpartition('=')[2]}-{last}")
        files.delete(aside)


def adopt(spark: SparkSession, flights: str) -> None:
    """Gives a table that was written without a ledger one entry, of no file, with its months."""
    files, path = Files(spark, flights), f"{flights}_ledger"
    old = None if files.names(path) else table_there(spark, flights)
    if old is not None:
        months = [r.asDict() for r in old.groupBy(*MONTH).agg(F.count("*").alias("rows")).collect()]
        entry = {"load": "load-000000", "file": "", "length": 0, "carriers": [], "missing": [], "has_rows": True, "months": months}
        files.write(f"{path}/load-000000.json", json.dumps(entry) + "\n")


def loaded_months(entries: DataFrame) -> DataFrame:
    """Year, Month, Reporting_Airline and _file, the hash of the file, of what is in the table."""
    keys = entries.select("file", F.explode("months").alias("m"))
    return keys.select("m.Year", "m.Month", "m.Reporting_Airline", F.xxhash64("file").alias("_file"))


def load_files(spark: SparkSession, paths: str | Sequence[str], flights: str, carriers: Sequence[str] = CARRIERS, again: str = "skip", literal_paths: bool = False) -> Load:
    """Cleans monthly files and appends what is new to the table at `flights`.

    again: 'skip' leaves out months and carriers that any earlier load has brought; 'add' only those that the same file has, so
    that a month may come in several files. Files that an earlier load has read for these carriers, with their length of now, aren't read again. Paths are patterns, unless
    they are literal.
    """
    top = flights.rstrip("/")
    paths = [literal(p) for p in ([paths] if isinstance(paths, str) else paths)] if literal_paths else paths
    carry_on(spark, top)
    adopt(spark, top)
    entries = ledger(spark, top)
    known = entries.filter(F.size(F.array_except(F.array(*map(F.lit, carriers)), "carriers")) == 0).select("file", "length").distinct()
    listed = listed_files(spark, paths)
    new = listed.join(known, ["file", "length"], "left_anti").collect()  # Spark's own readers list them on the driver too
    n_known = listed.count() - len(new)
    if not new:
        return Load(known_files=n_known)
    groups = header_groups(spark, [literal(r.file) for r in new])
    raw = read_groups(spark, groups, source="_source")
    clean = clean_flights(raw, carriers, ("_source",)).withColumn("_file", F.xxhash64("_source"))
    seen = Observation("load")
    clean = clean.observe(seen, F.count("*").alias("rows"), F.collect_set("_file").alias("files"))
    fresh = append_new_months(clean.drop("_source"), loaded_months(entries), MONTH if again == "skip" else (*MONTH, "_file"))
    load = f"load-{1 + max((int(n.split('-')[1].split('.')[0]) for n in Files(spark, top).names(f'{top}_ledger')), default=0):06d}"
    fresh.write.partitionBy("Year", "Month", "_file").parquet(f"{top}_staging/{load}")
    rows = seen.get
    staged = table_there(spark, f"{top}_staging/{load}")
    counts = [] if staged is None else staged.groupBy(*MONTH, "_file").agg(F.count("*").alias("rows")).collect()
    numbers = {r.file: r.number for r in spark.createDataFrame([(r.file,) for r in new], "file string").select("file", F.xxhash64("file").alias("number")).collect()}
    lacks = {f: lack for header, files in groups for lack in [select_keep_columns(read_group(spark, header, files[:1]))[1]] for f in files}
    lines = []
    for r in new:
        months = [{"Year": c.Year, "Month": c.Month, "Reporting_Airline": c.Reporting_Airline, "rows": c.rows} for c in counts if c._file == numbers[r.file]]
        lines.append({"load": load, "file": r.file, "length": r.length, "carriers": list(carriers), "missing": lacks.get(r.file, list(KEEP)), "has_rows": numbers[r.file] in rows["files"], "months": months})
    Files(spark, top).write(f"{top}_ledger/{load}.json", "".join(json.dumps(line) + "\n" for line in lines))
    carry_on(spark, top)
    done = [LoadedFile(x["file"], x["missing"], x["has_rows"], sum(m["rows"] for m in x["months"])) for x in lines]
    loaded = sum(f.loaded for f in done)
    return Load(loaded, rows["rows"] - loaded, n_known, done)
