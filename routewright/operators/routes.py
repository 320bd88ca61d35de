"""Route generation: requests, outlines, candidate grids, choice of the best route."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routewright.functions import geo
from routewright.operators.lines import line_box, line_length, resample
from routewright.operators.similarity import shape_fidelity
from routewright.session import cut_lineage

# Street detour factor, scale range of the search, and the distance error that ends rescaling.
DETOUR = 1.3
SCALE_LOW, SCALE_HIGH = 0.6, 3.0
GOOD_ERROR = 0.03


def split_requests(requests: DataFrame, outlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reasons). Reasons are in field order; an unknown shape is one of them."""
    known = outlines.select("shape").distinct().withColumn("_known", F.lit(True))
    rules = [
        ("lat", F.col("lat").between(-90, 90), False), ("lon", F.col("lon").between(-180, 180), False),
        ("distance_km", (F.col("distance_km") > 0) & (F.col("distance_km") <= 50), False),
        ("waypoints", F.col("waypoints").between(10, 80), False),
        ("iterations", F.col("iterations").between(1, 10), False),
        ("search_radius_km", (F.col("search_radius_km") > 0) & (F.col("search_radius_km") <= 200), True),
        ("candidates", F.col("candidates").between(1, 15), False), ("scales", F.col("scales").between(1, 8), False),
    ]
    broken = [
        F.when(~F.coalesce(ok, F.lit(optional)), F.lit(name)) for name, ok, optional in rules
    ]
    reasons = F.array_compact(F.array(F.when(F.col("_known").isNull(), F.lit("shape")), *broken))
    judged = requests.join(known, "shape", "left").withColumn("reasons", reasons).drop("_known")
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def candidate_centres(lat: Column, lon: Column, radius_km: Column, n: Column) -> Column:
    """Array of (lat, lon): the given centre, then n-1 points on the ring at half the radius."""
    ring = F.greatest(radius_km / 2.0, F.lit(0.0))
    seed = F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))

    def around(i: Column) -> Column:
        angle = F.lit(2) * F.pi() * i / F.greatest(n - 1, F.lit(1))
        return F.struct(
            (lat + ring * F.sin(angle) * (1.0 / geo.RING_KM_PER_DEG)).alias("lat"),
            (lon + ring * F.cos(angle) * (F.lit(1.0) / (F.lit(geo.RING_KM_PER_DEG) * F.cos(F.radians(lat)))))
            .alias("lon"),
        )

    many = (n > 1) & (ring > 0)
    return F.when(
        many, F.concat(F.array(seed), F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), around))
    ).otherwise(F.array(seed))


def candidate_scales(target_m: Column, perimeter: Column, n: Column) -> Column:
    """Array of metres per unit, spaced geometrically around the scale whose outline would measure the target."""
    base = target_m / DETOUR / F.nullif(perimeter, F.lit(0.0))
    spread = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: base * F.lit(SCALE_LOW) * F.pow(F.lit(SCALE_HIGH / SCALE_LOW), i / F.greatest(n - 1, F.lit(1))),
    )
    return F.when(n > 1, spread).otherwise(F.array(base))


def sampled_outlines(requests: DataFrame, outlines: DataFrame) -> DataFrame:
    """Outline of each (shape, waypoints) in use, resampled: shape, waypoints, seq, x, y, perimeter, cx, cy.

    Few distinct combinations exist however many requests there are.
    """
    used = requests.select("shape", "waypoints").distinct()
    key = ["shape", "waypoints"]
    drawn = cut_lineage(resample(cut_lineage(outlines.join(used, "shape").withColumn("_n", F.col("waypoints"))), key, "_n"))
    box = line_box(drawn, key, ("x", "y")).select(
        *key, ((F.col("min_x") + F.col("max_x")) / 2).alias("cx"), ((F.col("min_y") + F.col("max_y")) / 2).alias("cy")
    )
    return drawn.join(line_length(drawn, key, name="perimeter"), key).join(box, key)


def project_shape(placed: DataFrame) -> DataFrame:
    """Geographic waypoints of placed outlines: columns x, y, cx, cy, centre_lat, centre_lon, scale."""
    point = geo.project_offset(
        (F.col("x") - F.col("cx")) * F.col("scale"), (F.col("y") - F.col("cy")) * F.col("scale"),
        F.col("centre_lat"), F.col("centre_lon"),
    )
    return placed.withColumn("_p", point).select("*", "_p.lat", "_p.lon").drop("_p")


def candidate_grid(requests: DataFrame, sampled: DataFrame) -> DataFrame:
    """All centres and scales of each request: request_id, candidate_no, centre, scale, shape, waypoints.

    A request fans out by at most 15 x 8 rows, generated from its own arrays.
    """
    perimeters = sampled.select("shape", "waypoints", "perimeter").distinct()
    spread = requests.join(perimeters, ["shape", "waypoints"]).select(
        "request_id", "shape", "waypoints", "distance_km", "scales", "perimeter",
        F.posexplode(candidate_centres(
            F.col("lat"), F.col("lon"), F.col("search_radius_km"), F.col("candidates")
        )).alias("centre_no", "_c"),
    )
    target_m = F.col("distance_km") * 1000.0
    return spread.select(
        "request_id", "shape", "waypoints", "centre_no", F.col("_c.lat").alias("centre_lat"),
        F.col("_c.lon").alias("centre_lon"), "scales", target_m.alias("target_m"),
        F.posexplode(candidate_scales(target_m, F.col("perimeter"), F.col("scales"))).alias("scale_no", "scale"),
    ).withColumn("candidate_no", F.col("centre_no") * F.col("scales") + F.col("scale_no")).drop("scales")


def candidate_waypoints(grid: DataFrame, sampled: DataFrame) -> DataFrame:
    """Waypoints of every candidate: its columns plus seq, lat, lon."""
    outline = sampled.select("shape", "waypoints", "seq", "x", "y", "cx", "cy")
    return project_shape(grid.join(outline, ["shape", "waypoints"])).drop("x", "y", "cx", "cy")


def best_route_by_fidelity(scored: DataFrame) -> DataFrame:
    """Lowest fidelity per request among candidates that routed, first candidate on a tie, which is told by twelve decimals:
    a mean over a line's points differs beyond those with the order in which it is added up."""
    best = F.min_by(F.struct(*scored.columns), F.struct(F.round("fidelity", 12), "candidate_no"))
    return scored.filter("fidelity IS NOT NULL").groupBy("request_id").agg(best.alias("_b")).select("_b.*")


def best_iteration(iterations: DataFrame) -> DataFrame:
    """Iteration with the smallest relative distance error per request, first on a tie."""
    error = F.abs(F.col("distance_m") - F.col("target_m")) / F.col("target_m")
    rows = iterations.withColumn("error", error)
    best = F.min_by(F.struct(*rows.columns), F.struct("error", "iteration"))
    return rows.groupBy("request_id").agg(best.alias("_b")).select("_b.*")


Router = Callable[[DataFrame], DataFrame]
"""Takes waypoints (route_id, seq, lat, lon) and returns routed lines (route_id, seq, lat, lon, distance_m); a route
that cannot be made is absent."""


def _route_id(number: str) -> Column:
    return F.concat_ws("/", F.col("request_id").cast("string"), F.col(number).cast("string"))


def _lost(requests: DataFrame, best: DataFrame, reason: Column) -> DataFrame:
    return requests.join(best.select("request_id"), "request_id", "left_anti").withColumn("reason", reason)


def search_lines(
    requests: DataFrame, outlines: DataFrame, router: Router
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """:func:`search_routes` with the tables behind it: (best, lost, waypoints, routed lines), by route_id."""
    bad = ~F.coalesce((F.col("candidates") >= 1) & (F.col("scales") >= 1), F.lit(False))
    tried = requests.filter(~bad)
    sampled = cut_lineage(sampled_outlines(tried, outlines))
    grid = cut_lineage(candidate_grid(tried, sampled).withColumn("route_id", _route_id("candidate_no")))
    waypoints = candidate_waypoints(grid, sampled).select("route_id", "seq", "lat", "lon")
    routed = cut_lineage(router(waypoints))
    scores = shape_fidelity(waypoints, routed, "route_id")
    lengths = routed.groupBy("route_id").agg(F.max("distance_m").alias("distance_m"))
    best = cut_lineage(best_route_by_fidelity(grid.join(lengths, "route_id").join(scores, "route_id")))
    reason = F.when(bad, "candidates and scales must be >= 1").otherwise("every candidate failed")
    return best, _lost(requests, best, reason), waypoints, routed


def search_routes(requests: DataFrame, outlines: DataFrame, router: Router) -> tuple[DataFrame, DataFrame]:
    """(best route per request, requests without any and the reason). Every candidate is routed and scored in one pass.

    Requests without a candidate or a scale are lost one by one; the others go on.
    """
    return search_lines(requests, outlines, router)[:2]


def rescale_lines(
    requests: DataFrame, outlines: DataFrame, router: Router
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """:func:`rescale_iterate` with the tables behind it: (best, lost, waypoints, routed lines), by route_id."""
    sampled = cut_lineage(sampled_outlines(requests, outlines))
    perimeters = sampled.select("shape", "waypoints", "perimeter").distinct()
    target_m = F.col("distance_km") * 1000.0
    open_rows = cut_lineage(requests.join(perimeters, ["shape", "waypoints"]).select(
        "request_id", "shape", "waypoints", "iterations", target_m.alias("target_m"),
        F.col("lat").alias("centre_lat"), F.col("lon").alias("centre_lon"),
        (target_m / DETOUR / F.nullif(F.col("perimeter"), F.lit(0.0))).alias("scale"), F.lit(1).alias("iteration"),
    ))
    done, most = None, max(requests.agg(F.max("iterations")).first()[0] or 0, 1)
    for number in range(1, most + 1):
        placed = open_rows.withColumn("route_id", _route_id("iteration"))
        drawn = candidate_waypoints(placed, sampled).select("route_id", "seq", "lat", "lon")
        routed = cut_lineage(router(drawn))
        lengths = routed.groupBy("route_id").agg(F.max("distance_m").alias("distance_m"))
        tried = cut_lineage(placed.join(lengths, "route_id"))
        round_of = (tried, drawn, routed)
        done = round_of if done is None else tuple(a.unionByName(b) for a, b in zip(done, round_of))
        ratio = F.col("target_m") / F.nullif(F.col("distance_m"), F.lit(0.0))
        error = F.abs(F.col("distance_m") - F.col("target_m")) / F.col("target_m")
        open_rows = tried.filter((error >= GOOD_ERROR) & (F.col("iterations") > number)).withColumn(
            "scale", F.col("scale") * F.sqrt(ratio)
        ).drop("distance_m", "route_id").withColumn("iteration", F.lit(number + 1))
        if open_rows.isEmpty():
            break
    tried, drawn, routed = done
    # The distance alone decides, so only the chosen lines are scored.
    best = cut_lineage(best_iteration(tried))
    chosen = [points.join(best.select("route_id"), "route_id", "left_semi") for points in (drawn, routed)]
    best = cut_lineage(best.join(shape_fidelity(*chosen, "route_id"), "route_id"))
    return best, _lost(requests, best, F.lit("the first routing failed")), drawn, routed


def rescale_iterate(requests: DataFrame, outlines: DataFrame, router: Router) -> tuple[DataFrame, DataFrame]:
    """(best iteration per request, requests whose first routing failed).

    All open requests are routed together; a request leaves the loop when it is within 3 %, out of iterations, or when a
    later routing fails. The scale moves by the square root of target over actual.
    """
    return rescale_lines(requests, outlines, router)[:2]
