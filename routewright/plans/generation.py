"""One job from route requests to routes with their map line, files and figures, and the requests that got none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewright.functions.scores import error_pct
from routewright.operators.catalogue import shape_metadata
from routewright.operators.lines import as_lines
from routewright.operators.routes import Router, rescale_lines, search_lines, split_requests
from routewright.session import cut_lineage
from routewright.sinks import writers

# How a caller is told that the shape is unknown, a field is out of range, no route was found.
UNKNOWN_SHAPE, BAD_FIELD, NO_ROUTE = 404, 422, 502

_BEST = ["request_id", "route_id", "shape", "target_m", "distance_m", "fidelity", "centre_lat", "centre_lon"]


def generate_routes(
    requests: DataFrame, outlines: DataFrame, router: Router, stamp: str
) -> tuple[DataFrame, DataFrame]:
    """(routes, rejects) of requests with ids of their own.

    A request with a search radius takes the candidate closest to the outline, one without takes the rescaling that comes
    closest to its distance. ``routes``: request_id, shape, target_distance_m, routed_distance_m, error_pct, fidelity,
    chosen_lat, chosen_lon, waypoints and line (arrays of lat, lon), geojson, gpx, kml. ``rejects``: request_id, status,
    reason. A shape without display metadata is named by its id. ``stamp`` is the time written into the files.
    """
    valid, invalid = split_requests(requests, outlines)
    valid = cut_lineage(valid)
    by_search = search_lines(valid.filter("search_radius_km IS NOT NULL"), outlines, router)
    by_scale = rescale_lines(valid.filter("search_radius_km IS NULL"), outlines, router)
    best = by_search[0].select(*_BEST).unionByName(by_scale[0].select(*_BEST))

    def arrays(place: int, name: str) -> DataFrame:
        points = by_search[place].unionByName(by_scale[place]).select("route_id", "seq", "lat", "lon")
        kept = points.join(best.select("route_id"), "route_id", "left_semi")
        return as_lines(kept, ["route_id"]).withColumnRenamed("line", name)

    named = shape_metadata(outlines).select(F.col("id").alias("shape"), F.col("name").alias("_name"))
    rows = best.join(arrays(2, "waypoints"), "route_id").join(arrays(3, "line"), "route_id").join(F.broadcast(named), "shape", "left")
    title = F.concat(F.coalesce("_name", F.initcap("shape")), F.lit(" Run"))
    about = F.concat(F.lit("GPS-art "), F.col("shape"), F.lit(", ~"), F.format_string("%.2f", F.col("distance_m") / 1000), F.lit(" km"))
    routes = rows.select(
        "request_id", "shape", F.col("target_m").alias("target_distance_m"), F.col("distance_m").alias("routed_distance_m"),
        error_pct(F.col("distance_m"), F.col("target_m")).alias("error_pct"), "fidelity",
        F.col("centre_lat").alias("chosen_lat"), F.col("centre_lon").alias("chosen_lon"), "waypoints", "line",
        writers.to_geojson(F.col("line")).alias("geojson"),
        writers.gpx_route_and_track(F.col("line"), title, about, stamp).alias("gpx"),
        writers.kml_line(F.col("line"), title, about).alias("kml"),
    )
    only_shape = (F.size("reasons") == 1) & F.array_contains("reasons", "shape")
    wrong = invalid.select(
        "request_id", F.when(only_shape, UNKNOWN_SHAPE).otherwise(BAD_FIELD).alias("status"),
        F.array_join("reasons", ",").alias("reason"),
    )
    lost = by_search[1].select("request_id", "reason").unionByName(by_scale[1].select("request_id", "reason"))
    return routes, wrong.unionByName(lost.select("request_id", F.lit(NO_ROUTE).alias("status"), "reason"))
