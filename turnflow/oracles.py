"""SQL that gives the queries' rows, for DuckDB over the same tables: one chain of relations, and an ending per query."""

from __future__ import annotations

from turnflow.constants import BUCKETS, DEADBAND, DRAWS, LATE_BY, POOL_CAP, POOL_SAMPLES, SAMPLE_SEED
from turnflow.functions.numbers import PRIME, ROUNDS
from turnflow.sources.derived import DUCK, REQUESTS_SQL, airports_sql, flights_sql

CAUSES = "CarrierDelay WeatherDelay NASDelay SecurityDelay LateAircraftDelay".split()


def bucket(x: str) -> str:
    arms = []
    for name, low, high in BUCKETS:
        test = " AND ".join(t for t in (f"{x} >= {low}" if low is not None else "", f"{x} <= {high}" if high is not None else "") if t)
        arms.append(f"WHEN {test} THEN '{name}'")
    return f"CASE {' '.join(arms)} END"


def fix(x: str) -> str:
    return f"round(({x}) * 1000000, 0) / 1000000"


def draw(i: str, c: str) -> str:
    v = f"((CAST({i} AS BIGINT) * 1000003 + {c}) % {PRIME})"
    for m, s in ROUNDS:
        v = f"((xor({v}, {v} >> {s}) * {m}) % {PRIME})"
    return v


def stream(number: str, hop: str, step: int) -> str:
    return f"((CAST({number} AS BIGINT) * 7919 + {hop} * 613 + {step * 31}) % {PRIME})"


def _local(u: str, tz: str) -> str:
    return f"timezone({tz}, timezone('UTC', {u}))"


def _sure(u: str, local: str, tz: str) -> str:
    return f"CASE WHEN {_local(u, tz)} = {local} AND {_local(u + ' + INTERVAL 1 HOUR', tz)} <> {local} AND {_local(u + ' - INTERVAL 1 HOUR', tz)} <> {local} THEN {u} END"


def _kinds(x: str) -> str:
    return f"count(*) FILTER ({x} > {DEADBAND}) AS amplify_events, count(*) FILTER ({x} < -{DEADBAND}) AS absorb_events, count(*) FILTER (abs({x}) <= {DEADBAND}) AS neutral_events"


def _turn(a: str, b: str) -> str:
    return f"date_diff('minute', {a}, {b})"


_ORDER = "DepTimestampUTC, Flight_Number_Reporting_Airline, Origin, Dest"
_BOUNDS = ", ".join(f"({i}, '{n}', {'NULL' if a is None else a}, {'NULL' if b is None else b})" for i, (n, a, b) in enumerate(BUCKETS))


def _dist(universe: str, keys: str, samples: str, stats: str, size: str) -> str:
    on = " AND ".join(f"g.{k} = o.{k}" for k in keys.split(", "))
    return f"""
{universe}_s AS (SELECT *, row_number() OVER (PARTITION BY {keys}, bucket ORDER BY ord, value) AS rn, row_number() OVER (PARTITION BY bucket ORDER BY ord, value) AS rb
  FROM {universe} WHERE bucket IS NOT NULL AND value IS NOT NULL),
{universe}_own AS (SELECT {keys}, bucket, count(*) AS n, list_sort(list(CAST(value AS INT)) FILTER (rn <= {POOL_CAP})) AS pool FROM {universe}_s GROUP BY {keys}, bucket),
{universe}_net AS (SELECT b.bucket, b.bucket_low, b.bucket_high, count(s.bucket) AS network_sample_size, list_sort(list(CAST(s.value AS INT)) FILTER (s.rb <= {POOL_CAP})) AS {samples}
  FROM bounds b LEFT JOIN {universe}_s s ON b.bucket = s.bucket GROUP BY ALL),
{universe}_dist AS (SELECT {", ".join("g." + k for k in keys.split(", "))}, g.bucket, g.bucket_low, g.bucket_high, coalesce(o.n, 0) AS {size}, coalesce(o.n, 0) < {POOL_SAMPLES} AS is_fallback,
  CASE WHEN coalesce(o.n, 0) >= {POOL_SAMPLES} THEN o.pool ELSE g.{samples} END AS {samples}
  FROM (SELECT * FROM (SELECT DISTINCT {keys} FROM {stats}) CROSS JOIN {universe}_net) g LEFT JOIN {universe}_own o ON {on} AND g.bucket = o.bucket)"""


def _number(path: str, start: str) -> str:
    return f"CAST('0x' || substr(md5(array_to_string({path}, '-') || '|' || {start}), 1, 13) AS BIGINT) % {PRIME}"


def _simulated(name: str, requests: str) -> str:
    """requests: path, start_delay. Rows (path, start, hop, i, e, fallback, thin) of each draw at each stop, of each path and start bucket once."""
    return f"""
{name}_work AS (SELECT DISTINCT path, start, {_number("path", "start")} AS number, CASE start {" ".join(f"WHEN '{b}' THEN {low if low is not None else high}" for b, low, high in BUCKETS)} END AS x0 FROM (SELECT path, {bucket("start_delay")} AS start FROM {requests}) WHERE start IS NOT NULL AND len(path) >= 2),
{name} AS (
  SELECT path, start, number, 1 AS hop, i, CAST(x0 AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS e, false AS fallback, false AS thin FROM {name}_work, (SELECT unnest(range({DRAWS})) AS i)
  UNION ALL
  SELECT path, start, number, hop + 1, i, CASE WHEN len(path) > hop + 1 THEN nodes[1 + {draw("i", stream("number", "hop", 1))} % len(nodes)] END, e, fallback, thin
  FROM (
    SELECT q.*, CASE WHEN len(n.dep_delay_samples) > 0 THEN n.dep_delay_samples ELSE nn.dep_delay_samples END AS nodes
    FROM (
      SELECT path, start, number, hop, i, edges[1 + {draw("i", stream("number", "hop", 0))} % len(edges)] AS e, fallback, thin
      FROM (
        SELECT r.path, r.start, r.number, r.hop, r.i, CASE WHEN len(d.arr_delay_samples) > 0 THEN d.arr_delay_samples ELSE nd.arr_delay_samples END AS edges,
               d.arr_delay_samples IS NULL AS fallback, coalesce(d.is_fallback AND d.arr_delay_samples IS NOT NULL, false) AS thin
        FROM {name} r LEFT JOIN edgeu_dist d ON d.origin = r.path[r.hop] AND d.dest = r.path[r.hop + 1] AND d.bucket = {bucket("r.x")}
        LEFT JOIN edgeu_net nd ON nd.bucket = {bucket("r.x")} WHERE r.hop < len(r.path) AND r.x IS NOT NULL
      )
    ) q LEFT JOIN nodeu_dist n ON n.airport = q.path[q.hop + 1] AND n.bucket = {bucket("q.e")} LEFT JOIN nodeu_net nn ON nn.bucket = {bucket("q.e")}
  )
),
{name}_stops AS (SELECT path, start, hop - 1 AS hop, path[hop] AS airport, path[hop - 1] AS origin, list(CAST(e AS INT) ORDER BY i) AS draws, {", ".join(f"{fix(f'quantile_cont(e, {q / 100})')} AS p{q}" for q in (10, 50, 90))}, {fix("avg(e)")} AS mean,
  {", ".join(f"{fix(f'avg(CASE WHEN e > {t} THEN 1.0 ELSE 0.0 END)')} AS p_over_{t}" for t in LATE_BY)}, bool_or(fallback) AS used_route_fallback, bool_or(thin) AS used_thin_pool
  FROM {name} WHERE hop > 1 GROUP BY path, start, hop)"""


def _ctes() -> str:
    crs, dep = "(CAST(FlightDate AS TIMESTAMP) + to_minutes(CAST({0} // 100 * 60 + {0} % 100 AS BIGINT)))".format("CRSDepTime"), "(CAST(FlightDate AS TIMESTAMP) + to_minutes(CAST({0} // 100 * 60 + {0} % 100 AS BIGINT)))".format("DepTime")
    keep = "CASE WHEN lag_dest = Origin THEN {} END AS {}"
    return f"""WITH RECURSIVE ref AS ({airports_sql()}),
allf AS ({flights_sql(DUCK)}),
flights AS (SELECT * REPLACE ({", ".join(f"coalesce({c}, 0) AS {c}" for c in CAUSES)}) FROM allf WHERE Reporting_Airline IN ('DL', 'UA')),
att AS (SELECT f.*, o.tz_name AS origin_tz, d.tz_name AS dest_tz FROM flights f LEFT JOIN ref o ON f.Origin = o.iata LEFT JOIN ref d ON f.Dest = d.iata),
enr0 AS (SELECT *, {crs} AS l_crs, {dep} AS l_dep FROM att),
enr1 AS (SELECT *, timezone('UTC', timezone(origin_tz, l_crs)) AS u_crs, timezone('UTC', timezone(origin_tz, l_dep)) AS u_dep FROM enr0),
enr2 AS (SELECT *, {_sure("u_crs", "l_crs", "origin_tz")} AS CRSDepTimestampUTC, {_sure("u_dep", "l_dep", "origin_tz")} AS DepTimestampUTC FROM enr1),
enr AS (SELECT *, CRSDepTimestampUTC + to_minutes(CRSElapsedTime) AS CRSArrTimestampUTC, DepTimestampUTC + to_minutes(ActualElapsedTime) AS ArrTimestampUTC FROM enr2),
done AS (SELECT *, CAST({_local("DepTimestampUTC", "origin_tz")} - INTERVAL '4 hours 30 minutes' AS DATE) AS operating_day FROM enr WHERE Cancelled = 0 AND Diverted = 0 AND DepTimestampUTC IS NOT NULL AND ArrTimestampUTC IS NOT NULL),
lagged AS (SELECT *, lag(Dest) OVER w AS lag_dest, lag(ArrDelayMinutes) OVER w AS lag_arr_delay, lag(Flight_Number_Reporting_Airline) OVER w AS lag_flight_number,
  lag(ArrTimestampUTC) OVER w AS lag_arr_utc, lag(CRSArrTimestampUTC) OVER w AS lag_crs_arr_utc FROM done WINDOW w AS (PARTITION BY Tail_Number ORDER BY {_ORDER})),
chained AS (SELECT *, {", ".join(keep.format(a, b) for a, b in (("lag_dest", "prev_dest"), ("lag_arr_delay", "prev_arr_delay"), ("lag_flight_number", "prev_flight_number"), ("lag_arr_utc", "prev_arr_timestamp_utc"), ("lag_crs_arr_utc", "prev_crs_arr_timestamp_utc")))},
  (lag_dest IS NULL OR lag_dest <> Origin) AS is_first_leg FROM lagged),
turns AS (SELECT prev_dest AS turn_airport, {_turn("prev_crs_arr_timestamp_utc", "CRSDepTimestampUTC")} AS sched_turn_min FROM chained WHERE prev_dest IS NOT NULL AND {_turn("prev_crs_arr_timestamp_utc", "CRSDepTimestampUTC")} BETWEEN 20 AND 180),
netturn AS (SELECT quantile_cont(sched_turn_min, 0.05) AS default_min_turn_min FROM turns),
ownturn AS (SELECT turn_airport, count(*) AS turn_sample_size, quantile_cont(sched_turn_min, 0.05) AS airport_min_turn_min FROM turns GROUP BY turn_airport),
minturn AS (SELECT turn_airport, turn_sample_size, CASE WHEN turn_sample_size >= 10 THEN airport_min_turn_min ELSE default_min_turn_min END AS empirical_min_turn_min, turn_sample_size < 10 AS min_turn_is_fallback FROM ownturn CROSS JOIN netturn),
eff AS (SELECT *, Flight_Number_Reporting_Airline AS flight_number, row_number() OVER w AS rotation_leg_number, CASE WHEN NOT is_first_leg THEN DepDelayMinutes - prev_arr_delay END AS node_effect,
  ArrDelayMinutes - DepDelayMinutes AS edge_effect_delay, ActualElapsedTime - CRSElapsedTime AS edge_effect_schedule, {_turn("prev_crs_arr_timestamp_utc", "CRSDepTimestampUTC")} AS scheduled_turn_min,
  (NOT is_first_leg AND {_turn("prev_crs_arr_timestamp_utc", "CRSDepTimestampUTC")} > 180) AS is_overnight_turn,
  sum(CASE WHEN is_first_leg THEN 0 ELSE DepDelayMinutes - prev_arr_delay END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_node_delay
  FROM chained WINDOW w AS (PARTITION BY Tail_Number, operating_day ORDER BY {_ORDER})),
prop AS (SELECT e.*, m.empirical_min_turn_min, m.min_turn_is_fallback, CASE WHEN NOT is_first_leg THEN scheduled_turn_min - empirical_min_turn_min END AS scheduled_buffer,
  CASE WHEN NOT is_first_leg THEN greatest(0, prev_arr_delay - (scheduled_turn_min - empirical_min_turn_min)) END AS propagated_delay FROM eff e LEFT JOIN minturn m ON e.prev_dest = m.turn_airport),
astats AS (SELECT prev_dest AS airport, count(*) AS turn_events, round(avg(node_effect) * 100, 0) / 100 AS avg_node_effect, round(quantile_cont(node_effect, 0.5) * 100, 0) / 100 AS median_node_effect, {_kinds("node_effect")}
  FROM prop WHERE node_effect IS NOT NULL AND is_overnight_turn = false GROUP BY prev_dest),
rstats AS (SELECT Origin AS origin, Dest AS dest, count(*) AS flights, round(avg(edge_effect_delay) * 100, 0) / 100 AS avg_edge_effect_delay, round(avg(edge_effect_schedule) * 100, 0) / 100 AS avg_edge_effect_schedule, {_kinds("edge_effect_delay")} FROM prop GROUP BY Origin, Dest),
bounds(bucket_no, bucket, bucket_low, bucket_high) AS (VALUES {_BOUNDS}),
keyed AS (SELECT *, md5('{SAMPLE_SEED}|' || Tail_Number || '|' || CAST(flight_number AS VARCHAR) || '|' || CAST(FlightDate AS VARCHAR) || '|' || Origin || '|' || Dest) AS ord FROM prop),
nodeu AS (SELECT prev_dest AS airport, {bucket("prev_arr_delay")} AS bucket, DepDelayMinutes AS value, ord FROM keyed WHERE node_effect IS NOT NULL AND is_overnight_turn = false),
edgeu AS (SELECT Origin AS origin, Dest AS dest, {bucket("DepDelayMinutes")} AS bucket, ArrDelayMinutes AS value, ord FROM keyed),{_dist("nodeu", "airport", "dep_delay_samples", "astats", "airport_sample_size")},{_dist("edgeu", "origin, dest", "arr_delay_samples", "rstats", "route_sample_size")},
points AS (SELECT s.*, r.name AS airport_name, r.city, r.lat, r.lon FROM astats s JOIN ref r ON s.airport = r.iata),
arcs AS (SELECT s.*, o.lat AS origin_lat, o.lon AS origin_lon, d.lat AS dest_lat, d.lon AS dest_lon FROM rstats s JOIN ref o ON s.origin = o.iata JOIN ref d ON s.dest = d.iata),
known AS (SELECT list(DISTINCT airport) AS known_codes FROM nodeu_dist),
asked AS ({REQUESTS_SQL}),
parsed AS (SELECT path_id, list_filter(regexp_split_to_array(upper(trim(path_text)), '[,\\->→\\s]+'), lambda x: x <> '') AS path, start_delay FROM asked),
valid AS (SELECT *, list_sort(list_distinct(list_filter(path, lambda c: NOT list_contains(known_codes, c)))) AS unknown_codes FROM parsed CROSS JOIN known),
good AS (SELECT path_id, path, start_delay FROM valid WHERE len(path) >= 2 AND len(unknown_codes) = 0),{_simulated("sim", "good")},
stops AS (SELECT g.path_id, s.* EXCLUDE (path, start) FROM good g JOIN sim_stops s ON g.path = s.path AND s.start = {bucket("g.start_delay")}),
rot AS (SELECT Tail_Number, operating_day, count(*) AS legs FROM prop GROUP BY ALL HAVING count(*) >= 2),
rpaths AS (SELECT Tail_Number, operating_day, list_concat([first(Origin ORDER BY rotation_leg_number)], list(Dest ORDER BY rotation_leg_number)) AS path, list(ArrDelayMinutes ORDER BY rotation_leg_number) AS actual, first(DepDelayMinutes ORDER BY rotation_leg_number) AS start_delay
  FROM prop SEMI JOIN rot USING (Tail_Number, operating_day) GROUP BY ALL),
usable AS (SELECT *, len(list_filter(path[2:len(path) - 1], lambda c: NOT list_contains(known_codes, c))) = 0 AS is_usable FROM rpaths CROSS JOIN known),
replayed AS (SELECT path, start_delay FROM usable WHERE is_usable),{_simulated("rep", "replayed")},
covered AS (SELECT Tail_Number, operating_day, hop AS hop_position, start AS start_bucket, actual[hop] BETWEEN p10 AND p90 AS covered
  FROM usable u JOIN rep_stops s ON u.path = s.path AND s.start = {bucket("u.start_delay")} WHERE is_usable)
"""


def _text(x: str) -> str:
    return f"array_to_string({x}, ',')"


_PROP = """Reporting_Airline, Tail_Number, flight_number, prev_flight_number, Origin, Dest, prev_dest, CAST(FlightDate AS VARCHAR) AS FlightDate, CAST(operating_day AS VARCHAR) AS operating_day,
CAST(DepTimestampUTC AS VARCHAR) AS DepTimestampUTC, CAST(ArrTimestampUTC AS VARCHAR) AS ArrTimestampUTC, DepDelayMinutes, ArrDelayMinutes, prev_arr_delay, is_first_leg, rotation_leg_number, node_effect, edge_effect_delay,
edge_effect_schedule, scheduled_turn_min, CAST(is_overnight_turn AS INT) AS is_overnight_turn, {0} AS empirical_min_turn_min, CAST(min_turn_is_fallback AS INT) AS min_turn_is_fallback, {1} AS scheduled_buffer, {2} AS propagated_delay, cumulative_node_delay""".format(fix("empirical_min_turn_min"), fix("scheduled_buffer"), fix("propagated_delay"))
_CLEAN = "Year, Month, DayofMonth, CAST(FlightDate AS VARCHAR) AS FlightDate, Reporting_Airline, Tail_Number, Flight_Number_Reporting_Airline, OriginAirportID, Origin, DestAirportID, Dest, CRSDepTime, DepTime, DepDelay, DepDelayMinutes, CRSArrTime, ArrTime, ArrDelay, ArrDelayMinutes, Cancelled, Diverted, CRSElapsedTime, ActualElapsedTime, " + ", ".join(CAUSES)
_ID = "Flight_Number_Reporting_Airline AS flight_number"
_FOCUS_ROUTES = "(origin = 'N01' OR dest = 'N01' OR (origin = 'N00' AND dest = 'N02'))"

ENDINGS = {
    "read_ontime": f"SELECT {_ID}, CAST(Year AS VARCHAR) AS Year, CAST(Month AS VARCHAR) AS Month, Tail_Number, Reporting_Airline, Origin, Dest, DepTime, CASE WHEN Month % 3 < 2 THEN DepDelay END AS DepDelay, ArrDelayMinutes FROM allf",
    "read_sheets": f"SELECT {_ID}, CAST(Year AS VARCHAR) AS Year, CAST(Month AS VARCHAR) AS Month, Tail_Number, Reporting_Airline, Origin, Dest, strftime(FlightDate, '%-m/%-d/%Y') AS FlightDate, CAST(DepTime AS VARCHAR) AS DepTime, CAST(CRSArrTime AS VARCHAR) AS CRSArrTime, ArrDelay FROM allf",
    "load_months": "SELECT Year, Month, Reporting_Airline, count(*) AS flights, count(*) AS entered FROM flights GROUP BY ALL",
    "read_airport_reference": "SELECT airport_id, name, city, iata, CAST(NULL AS VARCHAR) AS icao, lat, lon, tz_name FROM ref",
    "export_bundle": "SELECT airport AS id, turn_events AS events, lat FROM points UNION ALL SELECT origin || '-' || dest, flights, dest_lat FROM arcs",
    "require_tables": "SELECT 'flights' AS name, count(*) AS row_count FROM flights UNION ALL SELECT 'airport_timezones', count(*) FROM ref UNION ALL SELECT 'flights_propagation', count(*) FROM prop UNION ALL SELECT 'airport_stats', count(*) FROM astats UNION ALL SELECT 'route_stats', count(*) FROM rstats",
    "rebuild_table": "SELECT iata, tz_name, lat, lon, name, city FROM ref WHERE iata < 'N12'",
    "append_new_months": f"SELECT {_ID}, Year, Month, Reporting_Airline FROM flights WHERE NOT (Month % 2 = 0 OR Reporting_Airline = 'UA' AND Month % 3 = 0)",
    "filter_carriers": f"SELECT {_ID}, Reporting_Airline FROM allf WHERE Reporting_Airline IN ('DL', 'UA')",
    "select_keep_columns": "SELECT count(*) AS row_count, CAST(28 AS BIGINT) AS n_kept, CAST(14 AS BIGINT) AS n_missing FROM allf",
    "fill_delay_causes": f"SELECT {_ID}, {', '.join(f'coalesce({c}, 0) AS {c}' for c in CAUSES)} FROM allf",
    "cast_nullable_ints": f"SELECT {_ID}, CRSDepTime, DepTime, CRSArrTime, ArrTime, CRSElapsedTime, ActualElapsedTime, OriginAirportID, DestAirportID FROM allf",
    "parse_flight_date": f"SELECT {_ID}, CAST(FlightDate AS VARCHAR) AS FlightDate FROM allf",
    "trim_codes": f"SELECT {_ID}, Tail_Number FROM allf",
    "cast_flags": f"SELECT {_ID}, Cancelled, Diverted FROM allf",
    "clean_flights": f"SELECT {_CLEAN} FROM flights",
    "airport_lookup": "SELECT iata, tz_name, lat, lon, name, city FROM ref",
    "unmatched_airports": "SELECT DISTINCT code FROM (SELECT Origin AS code FROM flights UNION ALL SELECT Dest FROM flights) WHERE code NOT IN (SELECT iata FROM ref)",
    "attach_timezones": f"SELECT {_ID}, Origin, Dest, origin_tz, dest_tz FROM att",
    "missing_timezone_count": "SELECT count(*) FILTER (origin_tz IS NULL) + count(*) FILTER (dest_tz IS NULL) AS missing_timezones FROM att",
    "hhmm_split": f"SELECT {_ID}, CASE WHEN DepTime // 100 = 24 THEN 0 ELSE DepTime // 100 END AS hour, DepTime % 100 AS minute, CASE WHEN DepTime IS NULL THEN NULL WHEN DepTime // 100 = 24 THEN 1 ELSE 0 END AS days FROM flights",
    "localize_to_utc": f"SELECT {_ID}, CAST(DepTimestampUTC AS VARCHAR) AS utc FROM enr",
    "scheduled_utc": f"SELECT {_ID}, CAST(CRSDepTimestampUTC AS VARCHAR) AS dep, CAST(CRSArrTimestampUTC AS VARCHAR) AS arr FROM enr",
    "actual_utc": f"SELECT {_ID}, CAST(DepTimestampUTC AS VARCHAR) AS dep, CAST(ArrTimestampUTC AS VARCHAR) AS arr FROM enr",
    "utc_to_local_hhmm": f"SELECT {_ID}, hour({_local('ArrTimestampUTC', 'dest_tz')}) * 100 + minute({_local('ArrTimestampUTC', 'dest_tz')}) AS hhmm FROM enr",
    "arrival_reconciliation": f"SELECT count(*) FILTER (h IS NOT NULL AND ArrTime IS NOT NULL) AS checked, count(*) FILTER (h = ArrTime) AS matching, count(*) FILTER (h <> ArrTime) AS mismatching FROM (SELECT ArrTime, hour({_local('ArrTimestampUTC', 'dest_tz')}) * 100 + minute({_local('ArrTimestampUTC', 'dest_tz')}) AS h FROM enr)",
    "enrich_flights": f"SELECT {_CLEAN}, origin_tz, dest_tz, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in ('CRSDepTimestampUTC', 'CRSArrTimestampUTC', 'DepTimestampUTC', 'ArrTimestampUTC'))} FROM enr",
    "operating_day": f"SELECT {_ID}, CAST(operating_day AS VARCHAR) AS operating_day FROM done",
    "minutes_between": f"SELECT {_ID}, {_turn('CRSDepTimestampUTC', 'ArrTimestampUTC')} AS minutes FROM enr",
    "completed_legs": f"SELECT {_ID}, Tail_Number, Origin, Dest FROM done",
    "previous_leg": f"SELECT {_ID}, lag_dest, lag_arr_delay, lag_flight_number, CAST(lag_arr_utc AS VARCHAR) AS lag_arr_utc, CAST(lag_crs_arr_utc AS VARCHAR) AS lag_crs_arr_utc FROM lagged",
    "chain_legs": f"SELECT {_ID}, prev_dest, prev_arr_delay, prev_flight_number, is_first_leg FROM chained",
    "rotation_leg_number": "SELECT flight_number, rotation_leg_number FROM eff",
    "node_effect": "SELECT flight_number, node_effect FROM eff",
    "edge_effect_delay": "SELECT flight_number, edge_effect_delay FROM eff",
    "edge_effect_schedule": "SELECT flight_number, edge_effect_schedule FROM eff",
    "scheduled_turn_min": "SELECT flight_number, scheduled_turn_min FROM eff",
    "chain_in_segments": f"""SELECT Flight_Number_Reporting_Airline AS flight_number, prev_dest, prev_flight_number, row_number() OVER w AS rotation_leg_number,
  sum(CASE WHEN prev_dest IS NULL THEN 0 ELSE DepDelayMinutes - prev_arr_delay END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_node_delay
  FROM (SELECT * EXCLUDE (lag_dest, lag_arr, lag_number), CASE WHEN lag_dest = Origin THEN lag_dest END AS prev_dest, CASE WHEN lag_dest = Origin THEN lag_arr END AS prev_arr_delay, CASE WHEN lag_dest = Origin THEN lag_number END AS prev_flight_number
    FROM (SELECT *, lag(Dest) OVER v AS lag_dest, lag(ArrDelayMinutes) OVER v AS lag_arr, lag(Flight_Number_Reporting_Airline) OVER v AS lag_number
      FROM (SELECT * REPLACE (CASE WHEN Reporting_Airline <> 'UA' THEN Tail_Number END AS Tail_Number) FROM done) WINDOW v AS (PARTITION BY Tail_Number ORDER BY {_ORDER})))
  WINDOW w AS (PARTITION BY Tail_Number, operating_day ORDER BY {_ORDER})""",
    "is_overnight_turn": "SELECT flight_number, CAST(is_overnight_turn AS INT) AS is_overnight_turn FROM eff",
    "operational_turns": "SELECT turn_airport, sched_turn_min FROM turns",
    "network_min_turn": f"SELECT {fix('default_min_turn_min')} AS default_min_turn_min FROM netturn",
    "airport_min_turn": f"SELECT turn_airport, turn_sample_size, {fix('airport_min_turn_min')} AS airport_min_turn_min FROM ownturn",
    "min_turn_blend": f"SELECT turn_airport, turn_sample_size, {fix('empirical_min_turn_min')} AS empirical_min_turn_min, min_turn_is_fallback FROM minturn",
    "scheduled_buffer": f"SELECT flight_number, {fix('scheduled_buffer')} AS scheduled_buffer FROM prop",
    "propagated_delay": f"SELECT flight_number, {fix('propagated_delay')} AS propagated_delay FROM prop",
    "cumulative_node_delay": "SELECT flight_number, cumulative_node_delay FROM eff",
    "build_propagation": f"SELECT {_PROP} FROM prop",
    "airport_stats": "SELECT * FROM astats",
    "route_stats": "SELECT * FROM rstats",
    "delay_bucket": f"SELECT flight_number, {bucket('ArrDelayMinutes')} AS bucket FROM prop",
    "bucket_bounds": f"SELECT b.bucket, b.bucket_low, b.bucket_high, count(p.flight_number) AS legs FROM bounds b LEFT JOIN prop p ON b.bucket = {bucket('p.ArrDelayMinutes')} GROUP BY ALL",
    "capped_sample": f"SELECT airport, bucket, ord AS \"order\", CAST(value AS INT) AS value FROM nodeu_s WHERE rn <= {POOL_CAP}",
    "least_rows": f"SELECT s.origin, s.dest, s.bucket, s.ord AS \"order\", CAST(s.value AS INT) AS value, o.n AS sample_size FROM edgeu_s s JOIN edgeu_own o ON s.origin = o.origin AND s.dest = o.dest AND s.bucket = o.bucket WHERE s.rn <= {POOL_CAP}",
    "network_node_dist": f"SELECT bucket, bucket_low, bucket_high, network_sample_size, {_text('dep_delay_samples')} AS dep_delay_samples FROM nodeu_net",
    "node_dist": f"SELECT * REPLACE ({_text('dep_delay_samples')} AS dep_delay_samples) FROM nodeu_dist",
    "network_edge_dist": f"SELECT bucket, bucket_low, bucket_high, network_sample_size, {_text('arr_delay_samples')} AS arr_delay_samples FROM edgeu_net",
    "edge_dist": f"SELECT * REPLACE ({_text('arr_delay_samples')} AS arr_delay_samples) FROM edgeu_dist",
    "fallback_rates": f"SELECT kind, bucket, {fix('avg(CAST(is_fallback AS INT))')} AS fallback_rate, count(*) AS combos FROM (SELECT 'node' AS kind, bucket, is_fallback FROM nodeu_dist UNION ALL SELECT 'edge', bucket, is_fallback FROM edgeu_dist) GROUP BY ALL",
    "sample_fidelity": f"SELECT airport, bucket, count(*) AS full_size, {fix('avg(value)')} AS full_mean, quantile_cont(value, 0.5) AS full_median, count(*) FILTER (rn <= {POOL_CAP}) AS sample_size, {fix(f'avg(value) FILTER (rn <= {POOL_CAP})')} AS sample_mean, quantile_cont(value, 0.5) FILTER (rn <= {POOL_CAP}) AS sample_median FROM nodeu_s GROUP BY ALL",
    "airport_points": "SELECT * FROM points",
    "route_arcs": "SELECT * FROM arcs",
    "export_dropped": "SELECT (SELECT count(*) FROM astats WHERE airport NOT IN (SELECT iata FROM ref)) AS airports_dropped, (SELECT count(*) FROM rstats) - (SELECT count(*) FROM arcs) AS routes_dropped",
    "parse_path": f"SELECT path_id, {_text('path')} AS path FROM parsed",
    "validate_path": f"SELECT path_id, {_text('unknown_codes')} AS unknown_codes, len(path) >= 2 AND len(unknown_codes) = 0 AS is_valid FROM valid",
    "simulate_paths": f"SELECT path_id, hop, airport, origin, {_text('draws')} AS draws, used_route_fallback, used_thin_pool FROM stops",
    "edge_step": f"SELECT path_id, {_text('draws')} AS draws, used_route_fallback FROM stops WHERE hop = 1",
    "node_step": f"SELECT path_id, draws FROM good g JOIN (SELECT path, start, {_text('list(CAST(x AS INT) ORDER BY i)')} AS draws FROM sim WHERE hop = 2 AND len(path) > 2 GROUP BY path, start) s ON g.path = s.path AND s.start = {bucket('g.start_delay')}",
    "summarize_stops": "SELECT * EXCLUDE (draws) FROM stops",
    "fan_table": "SELECT path_id, hop, airport, p10, p50, p90, p_over_15, used_route_fallback, CAST(hop AS VARCHAR) || '. ' || airport AS label FROM (SELECT path_id, 0 AS hop, path[1] AS airport, start_delay AS p10, start_delay AS p50, start_delay AS p90, CASE WHEN start_delay > 15 THEN 1.0 ELSE 0.0 END AS p_over_15, false AS used_route_fallback FROM good UNION ALL SELECT path_id, hop, airport, p10, p50, p90, p_over_15, used_route_fallback FROM stops)",
    "fallback_hops": "SELECT path_id, string_agg(airport, ',' ORDER BY hop) AS fallback_stops FROM stops WHERE used_route_fallback GROUP BY path_id",
    "sample_rotations": "SELECT Tail_Number, CAST(operating_day AS VARCHAR) AS operating_day, legs FROM rot ORDER BY md5('replay|' || Tail_Number || '|' || CAST(operating_day AS VARCHAR)), Tail_Number, rot.operating_day LIMIT 200",
    "rotation_paths": f"SELECT Tail_Number, CAST(operating_day AS VARCHAR) AS operating_day, {_text('path')} AS path, {_text('list_transform(actual, lambda x: CAST(x AS INT))')} AS actual, start_delay FROM rpaths",
    "usable_rotations": "SELECT Tail_Number, CAST(operating_day AS VARCHAR) AS operating_day, is_usable FROM usable",
    "replay_coverage": "SELECT Tail_Number, CAST(operating_day AS VARCHAR) AS operating_day, hop_position, start_bucket, covered FROM covered",
    "coverage_report": f"SELECT hop_position, start_bucket, {fix('avg(CAST(covered AS INT))')} AS covered_share, count(*) AS hops FROM covered GROUP BY GROUPING SETS ((), (hop_position), (start_bucket))",
    "min_support_filter": "SELECT airport AS id, turn_events AS events FROM points WHERE turn_events >= 20 UNION ALL SELECT origin || '-' || dest, flights FROM arcs WHERE flights >= 5",
    "focus_connected": f"SELECT airport AS id FROM points WHERE airport = 'N01' OR airport IN (SELECT unnest([origin, dest]) FROM arcs WHERE {_FOCUS_ROUTES}) UNION ALL SELECT origin || '-' || dest FROM arcs WHERE {_FOCUS_ROUTES}",
    "focus_exact": "SELECT airport AS id FROM points WHERE airport = 'N01' UNION ALL SELECT origin || '-' || dest FROM arcs WHERE origin = 'N00' AND dest = 'N02'",
    "code_search": "SELECT origin, dest FROM arcs WHERE regexp_matches(origin, 'N0') OR regexp_matches(dest, 'N0')",
    "focus_metrics": "SELECT (SELECT count(*) FROM points) AS airports_shown, (SELECT count(*) FROM points WHERE avg_node_effect > 0) AS amplifying, (SELECT count(*) FROM points WHERE avg_node_effect < 0) AS absorbing, (SELECT count(*) FROM arcs) AS routes_shown",
}


def oracle(name: str) -> str:
    return f"{_ctes()} {ENDINGS[name]}"
