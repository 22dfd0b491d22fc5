"""Cleaning of raw monthly records: text columns in, typed columns out, one projection over one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnflow.constants import CALENDAR, CARRIERS, CAUSES, CODES, DELAYS, FLAGS, INTS, KEEP


def filter_carriers(raw: DataFrame, carriers: Sequence[str] = CARRIERS) -> DataFrame:
    return raw.filter(F.col("Reporting_Airline").isin(*carriers))


def select_keep_columns(raw: DataFrame, keep: Sequence[str] = KEEP) -> tuple[DataFrame, list[str]]:
    """The kept columns that are there, and the names of those that aren't."""
    return raw.select(*[c for c in keep if c in raw.columns]), [c for c in keep if c not in raw.columns]


def _each(df: DataFrame, names: Sequence[str], to) -> DataFrame:
    return df.withColumns({c: to(F.col(c)) for c in names if c in df.columns})


def number(x: Column) -> Column:
    return x.try_cast("double")


def fill_delay_causes(df: DataFrame, causes: Sequence[str] = CAUSES) -> DataFrame:
    """Blank causes are 0: they are not given for short delays."""
    return _each(df, causes, lambda x: F.coalesce(number(x), F.lit(0.0)))


def cast_nullable_ints(df: DataFrame, ints: Sequence[str] = INTS) -> DataFrame:
    """Texts like 830.0 are whole numbers; what isn't a number is null."""
    return _each(df, ints, lambda x: number(x).try_cast("long"))


def parse_flight_date(df: DataFrame, name: str = "FlightDate") -> DataFrame:
    day = lambda x: F.substring_index(F.trim(x.cast("string")), " ", 1)
    return _each(df, [name], lambda x: F.coalesce(F.try_to_date(day(x), "yyyy-MM-dd"), F.try_to_date(day(x), "M/d/yyyy")))


def trim_codes(df: DataFrame, codes: Sequence[str] = CODES) -> DataFrame:
    return _each(df, codes, F.trim)


def cast_flags(df: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    return _each(df, flags, lambda x: F.coalesce(number(x).try_cast("int"), F.lit(0)))


def clean_flights(raw: DataFrame, carriers: Sequence[str] = CARRIERS, beside: Sequence[str] = ()) -> DataFrame:
    """All of the above; calendar columns become ints, delays doubles. Columns named in `beside` stay as they are."""
    df, _ = select_keep_columns(filter_carriers(raw, carriers), (*KEEP, *beside))
    df = cast_flags(trim_codes(parse_flight_date(cast_nullable_ints(fill_delay_causes(df)))))
    return _each(_each(df, CALENDAR, lambda x: number(x).try_cast("int")), DELAYS, number)
