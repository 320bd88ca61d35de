"""Routers: ways through waypoints, for all routes at once, over a street graph or from stored service answers.

Both make a function of waypoints (route_id, seq dense from 0, lat, lon) that returns lines (route_id, seq, lat, lon,
distance_m). A route that cannot be made is absent: fewer than two waypoints, a coordinate that is null or out of range,
a leg without a way, or no stored answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routewright.operators.graph import shortest_paths, stitch_paths
from routewright.operators.nearest import snap_to_nodes
from routewright.operators.routes import Router
from routewright.operators.scans import segments
from routewright.session import cut_lineage
from routewright.sinks.writers import valid_coords
from routewright.sources.readers import parse_routing_responses


def _usable(waypoints: DataFrame) -> DataFrame:
    """route_id of the routes that a router may try."""
    bad = F.count_if(~valid_coords(F.col("lat"), F.col("lon")))
    return waypoints.groupBy("route_id").agg(F.count("*").alias("_n"), bad.alias("_bad")).filter(
        "_n >= 2 AND _bad = 0").select("route_id")


def graph_router(nodes: DataFrame, edges: DataFrame, max_snap_m: float | None = None) -> Router:
    """Router over streets: nodes (id, lat, lon) and directed edges (u, v, length in metres).

    Waypoints go to their nearest node, equal legs of all routes are searched once, and the ways are joined in order. A
    route whose waypoints share one node is that node with distance 0. ``max_snap_m`` refuses routes with a waypoint
    farther from any street.
    """
    places = nodes.select(F.col("id").alias("node"), "lat", "lon")

    def route(waypoints: DataFrame) -> DataFrame:
        points = cut_lineage(waypoints.select("route_id", "seq", "lat", "lon").join(_usable(waypoints), "route_id", "left_semi"))
        snapped = cut_lineage(snap_to_nodes(points.withColumn("src_id", F.struct("route_id", "seq")), nodes))
        on_street = snapped if max_snap_m is None else snapped.filter(F.col("distance_m") <= max_snap_m)
        stops = points.join(on_street.select("src_id.route_id", "src_id.seq", "node"), ["route_id", "seq"], "left")
        legs = cut_lineage(
            segments(stops, ["route_id"], ["node"]).filter(F.col("next").isNotNull())
            .select("route_id", "seq", F.col("node").alias("u"), F.col("next.node").alias("v"))
        )
        moves = F.col("u") != F.col("v")
        ways = shortest_paths(legs.filter(moves), edges)
        steps = cut_lineage(legs.join(ways, ["u", "v"], "left"))
        gaps = F.count_if(F.col("u").isNull() | F.col("v").isNull() | (moves & F.col("path").isNull()))
        made = cut_lineage(steps.groupBy("route_id").agg(
            gaps.alias("_gaps"), F.sum(F.when(moves, F.col("dist")).otherwise(0.0)).alias("distance_m"),
            F.count_if(moves).alias("_moves"), F.min_by("u", "seq").alias("node"),
        ).filter("_gaps = 0"))
        walked = stitch_paths(steps.join(made.select("route_id"), "route_id", "left_semi"), "route_id")
        still = made.filter("_moves = 0").select("route_id", F.lit(0).cast("long").alias("seq"), "node")
        return walked.unionByName(still).join(places, "node").join(made.select("route_id", "distance_m"), "route_id").select(
            "route_id", "seq", "lat", "lon", "distance_m")

    return route


def request_texts(waypoints: DataFrame) -> DataFrame:
    """(route_id, request): the waypoints as a routing service is asked for them, ``lon,lat`` with six decimals by ``;``."""
    def shown(p: Column) -> Column:
        return F.format_string("%.6f,%.6f", p["lon"], p["lat"])

    ordered = F.array_sort(F.collect_list(F.struct("seq", "lat", "lon")))
    tried = waypoints.join(_usable(waypoints), "route_id", "left_semi")
    return tried.groupBy("route_id").agg(F.array_join(F.transform(ordered, shown), ";").alias("request"))


def stored_router(answers: DataFrame) -> Router:
    """Router over stored answers (request, body) of a routing service, requests as :func:`request_texts` writes them.

    Of several good answers to one request the shortest counts, then the smallest line.
    """
    good, _ = parse_routing_responses(answers.select(F.col("request").alias("request_id"), "body"))
    first = good.groupBy(F.col("request_id").alias("request")).agg(F.min(F.struct("distance_m", "line")).alias("_r"))

    def route(waypoints: DataFrame) -> DataFrame:
        return request_texts(waypoints).join(first, "request").select(
            "route_id", F.col("_r.distance_m").alias("distance_m"), F.posexplode("_r.line").alias("seq", "_p"),
        ).select("route_id", F.col("seq").cast("long").alias("seq"), "_p.lat", "_p.lon", "distance_m")

    return route


def unanswered(waypoints: DataFrame, answers: DataFrame) -> DataFrame:
    """Distinct requests that no stored answer of any kind covers: what is still to be asked for."""
    return request_texts(waypoints).select("request").distinct().join(answers.select("request"), "request", "left_anti")
