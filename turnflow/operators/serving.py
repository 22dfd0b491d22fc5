"""Tables joined to coordinates, and the filters that a map asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def airport_points(stats: DataFrame, airports: DataFrame) -> DataFrame:
    place = airports.select(F.col("iata").alias("airport"), F.col("name").alias("airport_name"), "city", "lat", "lon")
    return stats.join(place, "airport")


def route_arcs(stats: DataFrame, airports: DataFrame) -> DataFrame:
    end = lambda k: airports.select(F.col("iata").alias(k), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"))
    return stats.join(end("origin"), "origin").join(end("dest"), "dest")


def export_dropped(stats: DataFrame, routes: DataFrame, airports: DataFrame) -> DataFrame:
    """How many airports and routes have no coordinates."""
    codes = lambda k: airports.select(F.col("iata").alias(k))
    lost = stats.join(codes("airport"), "airport", "left_anti").agg(F.count("*").alias("airports_dropped"))
    kept = routes.join(codes("origin"), "origin", "left_semi").join(codes("dest"), "dest", "left_semi").agg(F.count("*").alias("_kept"))
    all_routes = routes.agg(F.count("*").alias("_all"))
    return lost.crossJoin(all_routes).crossJoin(kept).select("airports_dropped", (F.col("_all") - F.col("_kept")).alias("routes_dropped"))  # one row each


def min_support_filter(points: DataFrame, arcs: DataFrame, turn_events: int = 0, flights: int = 0) -> tuple[DataFrame, DataFrame]:
    return points.filter(F.col("turn_events") >= turn_events), arcs.filter(F.col("flights") >= flights)


def _no_focus(airports: DataFrame, routes: DataFrame) -> bool:
    return not airports.limit(1).count() and not routes.limit(1).count()


def focus_connected(points: DataFrame, arcs: DataFrame, airports: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes that touch a chosen airport or are chosen, and the airports at their ends or chosen; all without a choice."""
    if _no_focus(airports, routes):
        return points, arcs
    start = arcs.join(airports.select(F.col("airport").alias("origin")), "origin", "left_semi").select("origin", "dest")
    end = arcs.join(airports.select(F.col("airport").alias("dest")), "dest", "left_semi").select("origin", "dest")
    chosen = start.union(end).union(routes.select("origin", "dest")).distinct()
    near = arcs.join(chosen, ["origin", "dest"], "left_semi")
    codes = near.select(F.explode(F.array("origin", "dest")).alias("airport")).union(airports.select("airport")).distinct()
    return points.join(codes, "airport", "left_semi"), near


def focus_exact(points: DataFrame, arcs: DataFrame, airports: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only what is chosen; all without a choice."""
    if _no_focus(airports, routes):
        return points, arcs
    return points.join(airports, "airport", "left_semi"), arcs.join(routes, ["origin", "dest"], "left_semi")


def code_search(df: DataFrame, pattern: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows with a code that the pattern, trimmed and in upper case, is found in; all rows for a blank one."""
    p = pattern.strip().upper()
    if not p:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).rlike(p)
    return df.filter(hit)


def focus_metrics(points: DataFrame, arcs: DataFrame) -> DataFrame:
    shown = points.agg(F.count("*").alias("airports_shown"), F.count_if(F.col("avg_node_effect") > 0).alias("amplifying"), F.count_if(F.col("avg_node_effect") < 0).alias("absorbing"))
    return shown.crossJoin(arcs.agg(F.count("*").alias("routes_shown")))  # one row each
