"""Flight-shaped tables derived from the generic test tables, as SQL text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK = {
    "json": lambda c, k: f"CAST(get_json_object({c}, '$.{k}') AS BIGINT)",
    "div": lambda a, b: f"(({a}) DIV {b})",
    "local": lambda t, tz: f"from_utc_timestamp({t}, {tz})",
    "plus": lambda t, m: f"timestampadd(MINUTE, CAST({m} AS INT), {t})",
    "ts": lambda c: f"CAST({c} AS TIMESTAMP)",
}
DUCK = {
    "json": lambda c, k: f"CAST(json_extract_string({c}, '$.{k}') AS BIGINT)",
    "div": lambda a, b: f"(({a}) // {b})",
    "local": lambda t, tz: f"timezone({tz}, timezone('UTC', {t}))",
    "plus": lambda t, m: f"({t} + to_minutes(CAST({m} AS BIGINT)))",
    "ts": lambda c: f"CAST({c} AS TIMESTAMP)",
}


def code(i: str) -> str:
    return f"('N' || lpad(CAST({i} AS STRING), 2, '0'))"


def airports_sql() -> str:
    return f"""
SELECT CAST(n_nationkey AS BIGINT) AS airport_id, {code("n_nationkey")} AS iata,
       CASE n_nationkey % 6 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Chicago' WHEN 2 THEN 'America/Denver'
            WHEN 3 THEN 'America/Phoenix' WHEN 4 THEN 'America/Los_Angeles' ELSE 'Pacific/Honolulu' END AS tz_name,
       CAST(25.0 + n_nationkey AS DOUBLE) AS lat, CAST(-120.0 + 2 * n_nationkey AS DOUBLE) AS lon, n_name AS name, r_name AS city
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 24"""


def flights_sql(d: dict) -> str:
    """All carriers; expects a relation `ref` of airports beside `events`."""
    sched = d["plus"]("dep_utc", "-dep_delay")
    arr = d["plus"]("dep_utc", "actual")
    crs_arr = d["plus"]("dep_utc", "crs - dep_delay")
    hhmm = lambda t, tz: f"CASE WHEN {tz} IS NOT NULL THEN CAST(hour({d['local'](t, tz)}) * 100 + minute({d['local'](t, tz)}) AS BIGINT) END"
    day = f"CAST(coalesce({d['local'](sched, 'otz')}, {sched}) AS DATE)"
    return f"""
SELECT CAST(year(day) AS INT) AS Year, CAST(month(day) AS INT) AS Month, CAST(day(day) AS INT) AS DayofMonth, day AS FlightDate,
       CASE WHEN user_id % 5 < 2 THEN 'DL' WHEN user_id % 5 < 4 THEN 'UA' ELSE 'AA' END AS Reporting_Airline,
       'T' || CAST(user_id AS STRING) AS Tail_Number, event_id AS Flight_Number_Reporting_Airline,
       10000 + oi AS OriginAirportID, origin AS Origin, 10000 + di AS DestAirportID, dest AS Dest,
       {hhmm(sched, "otz")} AS CRSDepTime, {hhmm("dep_utc", "otz")} AS DepTime, CAST(dep_delay AS DOUBLE) AS DepDelay,
       CAST(greatest(0, dep_delay) AS DOUBLE) AS DepDelayMinutes, {hhmm(crs_arr, "dtz")} AS CRSArrTime, {hhmm(arr, "dtz")} AS ArrTime,
       CAST(arr_delay AS DOUBLE) AS ArrDelay, CAST(greatest(0, arr_delay) AS DOUBLE) AS ArrDelayMinutes,
       CAST(CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END AS INT) AS Cancelled, CAST(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS INT) AS Diverted,
       crs AS CRSElapsedTime, actual AS ActualElapsedTime,
       CASE WHEN arr_delay >= 15 THEN CAST(arr_delay - {d["div"]("arr_delay", "2")} AS DOUBLE) END AS CarrierDelay,
       CASE WHEN arr_delay >= 15 THEN CAST(0 AS DOUBLE) END AS WeatherDelay, CASE WHEN arr_delay >= 15 THEN CAST(0 AS DOUBLE) END AS NASDelay,
       CASE WHEN arr_delay >= 15 THEN CAST(0 AS DOUBLE) END AS SecurityDelay,
       CASE WHEN arr_delay >= 15 THEN CAST({d["div"]("arr_delay", "2")} AS DOUBLE) END AS LateAircraftDelay
FROM (
  SELECT h.*, {day} AS day FROM (
    SELECT g.*, o.tz_name AS otz, a.tz_name AS dtz, {code("oi")} AS origin, {code("di")} AS dest, crs + arr_delay - dep_delay AS actual
    FROM (
      SELECT event_id, user_id, {d["div"]("pk * pk", "400")} AS oi, {d["div"]("k * k", "400")} AS di,
             {d["plus"]("date_trunc('minute', " + d["ts"]("ts") + ")", "(user_id % 12) * 43200")} AS dep_utc,
             CAST(floor(value) AS BIGINT) - 30 AS dep_delay, CAST(floor(value) AS BIGINT) - 50 + (event_id * 7919 % 41) AS arr_delay, 50 + (event_id * 31 % 90) AS crs
      FROM (
        SELECT event_id, user_id, ts, value, k, coalesce(lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS pk
        FROM (SELECT event_id, user_id, ts, value, {d["json"]("props", "k")} AS k FROM events) e0
      ) e1
    ) g LEFT JOIN ref o ON {code("oi")} = o.iata LEFT JOIN ref a ON {code("di")} = a.iata
  ) h
) f"""


def _view(spark: SparkSession, sf_dir: str, sql: str, **tables: DataFrame) -> DataFrame:
    names = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "nation", "region", "customer") if f" {t}" in sql} | tables
    for t in names:
        sql = sql.replace(f" {t} ", f" {{{t}}} ")
    return spark.sql(sql, **names)


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, airports_sql())


def all_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed records of all carriers."""
    sql = flights_sql(SPARK).replace("FROM events)", "FROM {events})").replace("JOIN ref ", "JOIN {ref} ")
    return spark.sql(sql, events=spark.read.parquet(f"{sf_dir}/events.parquet"), ref=airports(spark, sf_dir))


def raw_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as a raw export has them: text, whole numbers as 830.0, padded codes, a stray column."""
    df = all_flights(spark, sf_dir)
    dotted = {c: F.col(c).cast("double").cast("string") for c in df.columns if c not in ("FlightDate", "Reporting_Airline", "Tail_Number", "Origin", "Dest", "Year", "Month", "DayofMonth")}
    return df.withColumns(dotted | {"FlightDate": F.date_format("FlightDate", "M/d/yyyy"), "Tail_Number": F.concat(F.lit("  "), "Tail_Number", F.lit(" ")), "Year": F.col("Year").cast("string"), "Month": F.col("Month").cast("string"), "DayofMonth": F.col("DayofMonth").cast("string"), "Unnamed: 109": F.lit(None).cast("string")})


def path_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_id, path_text, start_delay of every customer; routes that no flight has are asked for too."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    at = lambda e: F.concat(F.lit("N"), F.lpad(F.expr(e).cast("string"), 2, "0"))
    text = F.concat_ws(" -> ", at("c_custkey % 24"), at("c_custkey DIV 24 % 24"), at("(c_custkey * 5 + 1) % 24"))
    return c.select(F.col("c_custkey").alias("path_id"), text.alias("path_text"), (F.col("c_custkey") * 13 % 75).cast("double").alias("start_delay"))


REQUESTS_SQL = f"""
SELECT c_custkey AS path_id, {code("c_custkey % 24")} || ' -> ' || {code("c_custkey // 24 % 24")} || ' -> ' || {code("(c_custkey * 5 + 1) % 24")} AS path_text,
       CAST(c_custkey * 13 % 75 AS DOUBLE) AS start_delay
FROM customer"""
