"""Exact nearest neighbours by grid cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routewright.functions import geo
from routewright.session import as_large, cut_lineage

# Cell sides in degrees for far searches, from continents down.
_DESCENT = [45.0, 5.625, 0.703125, 0.087890625, 0.010986328125]
# Distances are compared by this many decimals; closer ones are ties.
_TIE_DECIMALS = 6
# Side of the cells in which lines of one key meet, in search distances: wider ones repeat fewer targets over their neighbours.
_TILE = 8


def _closest(distance: Column) -> Column:
    """struct(distance, t_id) of the closest rows: the smallest t_id of those that tie."""
    tie = F.min(F.struct(F.round(distance, _TIE_DECIMALS).alias("rounded"), F.col("t_id")))
    return F.struct(F.min(distance).alias("distance"), tie["t_id"].alias("t_id"))


def _box_floor_km(lat: Column, lon: Column, box: dict, radius: float) -> Column:
    """Lower bound of the great-circle distance from a point to a lat/lon box."""
    lat_gap = F.greatest(box["south"] - lat, lat - box["north"], F.lit(0.0))
    east = F.abs(F.pmod(box["west"] - lon + 180.0, F.lit(360.0)) - 180.0)
    west = F.abs(F.pmod(box["east"] - lon + 180.0, F.lit(360.0)) - 180.0)
    inside = lon.between(box["west"], box["east"])
    lon_gap = F.when(inside, 0.0).otherwise(F.least(east, west, F.lit(90.0)))
    by_lon = F.asin(F.least(F.lit(1.0), F.cos(F.radians(lat)) * F.sin(F.radians(lon_gap))))
    return F.lit(radius * (1 - 1e-9)) * F.greatest(F.radians(lat_gap), by_lon)


def _far_nearest(src: DataFrame, dst: DataFrame, on: list[str], carry: list[str], radius: float) -> DataFrame:
    """Nearest target of points with none close by: walk down the grid, at each level keeping only the cells whose
    lower bound does not exceed the best distance to a real point seen so far."""
    leveled = dst
    for i, size in enumerate(_DESCENT):
        leveled = leveled.withColumn(f"_l{i}", geo.cell_id(F.col("t_lat"), F.col("t_lon"), size))
    best = Window.partitionBy("src_id")
    front = None
    for i in range(len(_DESCENT)):
        parent = [f"_l{i - 1}"] if i else []
        cells = leveled.groupBy(*on, *parent, f"_l{i}").agg(
            F.min(F.struct("t_id", "t_lat", "t_lon")).alias("_rep"),
            F.min("t_lat").alias("south"), F.max("t_lat").alias("north"),
            F.min("t_lon").alias("west"), F.max("t_lon").alias("east"),
        )
        if front is None:
            # At most 32 cells per key; with no key the whole level is one small value.
            if on:
                front = src.join(cells, on)
            else:
                top = cells.agg(F.collect_list(F.struct(*cells.columns)).alias("top")).scalar()
                front = src.withColumn("_top", F.explode(top)).select(*src.columns, "_top.*")
        else:
            front = front.join(cells, [*on, *parent])
        box = {c: F.col(c) for c in ("south", "north", "west", "east")}
        reach = geo.haversine(F.col("lat"), F.col("lon"), F.col("_rep.t_lat"), F.col("_rep.t_lon"), radius, True)
        front = (
            front.withColumn("_floor", _box_floor_km(F.col("lat"), F.col("lon"), box, radius))
            .withColumn("_reach", F.min(reach).over(best)).filter(F.col("_floor") <= F.col("_reach") * (1 + 1e-9) + 10.0 ** -_TIE_DECIMALS)
            .select(*on, "src_id", "lat", "lon", *carry, f"_l{i}")
        )
    bottom = f"_l{len(_DESCENT) - 1}"
    distance = geo.haversine(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"), radius, True)
    return front.join(leveled, [*on, bottom]).groupBy(*on, "src_id", *carry).agg(_closest(distance).alias("_best"))


def nearest(
    src: DataFrame, dst: DataFrame, on: Sequence[str] = (), radius: float = geo.MATCH_RADIUS_M,
    near: float = 250.0, clamp: bool = True, carry: Sequence[str] = (), which: bool = True,
) -> DataFrame:
    """Nearest ``dst`` (t_id, lat, lon) of every ``src`` (src_id, lat, lon), within equal ``on`` keys if given.

    Distances are in the unit of ``radius``; ties (equal in six decimals) go to the smallest t_id. Most points find their neighbour among the
    cells within ``near``; the rest go down a cell hierarchy, so no point is compared with a whole target set.
    Points whose key has no target are absent. ``carry`` names columns of ``src`` to keep. ``which`` = False leaves t_id
    out, so that minima are taken in hash tables instead of by sorting.
    """
    on, carry = list(on), list(carry)
    size = geo.degrees_for_m(near, radius)
    targets = dst.select(*on, "t_id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    src = src.select(*on, "src_id", "lat", "lon", *carry)
    distance = geo.haversine(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"), radius, clamp)
    best = _closest(distance) if which else F.min(distance)
    found_at = F.col("_best.distance") if which else F.col("_best")
    if on:
        # A point stays in its cell and targets are repeated over the cells they can be reached from: what a point meets
        # is joined and folded in one task, and its rows are shuffled once instead of once for each cell around it.
        tile = _TILE * size
        # Half width in degrees of what a point can reach, rounded up so that it packs well; it spares most distances.
        spread = F.ceil(geo.longitude_spread(F.col("lat"), F.lit(size)) * 10000) / 10000
        left = src.withColumn("cell", geo.cell_id(F.col("lat"), F.col("lon"), tile)).withColumn("_spread", spread).alias("s")
        right = geo.explode_cells(targets, F.col("t_lat"), F.col("t_lon"), F.lit(size), tile).alias("t")
        apart = F.abs(F.col("lon") - F.col("t_lon"))
        met = left.join(as_large(right), [F.col(f"s.{c}") == F.col(f"t.{c}") for c in (*on, "cell")] + [
            F.abs(F.col("lat") - F.col("t_lat")) <= size, F.least(apart, 360.0 - apart) <= F.col("_spread")], "left").select("s.*", "t_id", "t_lat", "t_lon")
        folded = met.groupBy(*on, "cell", "src_id", "lat", "lon", *carry).agg(best.alias("_best"))
        far = F.coalesce(found_at >= near * (1 - 1e-6), F.lit(True))
        place = [F.when(F.col("_far"), F.col(c)).alias(c) for c in ("lat", "lon")]
        folded = cut_lineage(folded.withColumn("_far", far).select(*on, "src_id", *carry, "_best", "_far", *place))
        close = folded.filter("NOT _far").select(*on, "src_id", *carry, "_best")
        rest = folded.filter("_far").select(*src.columns)
    else:
        placed = targets.withColumn("cell", geo.cell_id(F.col("t_lat"), F.col("t_lon"), size))
        probe = geo.explode_cells(src, F.col("lat"), F.col("lon"), F.lit(size), size)
        close = cut_lineage(
            probe.join(placed, "cell").groupBy("src_id", *carry).agg(best.alias("_best")).filter(found_at < near * (1 - 1e-6)))
        rest = src.join(close.select("src_id"), "src_id", "left_anti")
    if not rest.isEmpty():
        if on:
            targets = cut_lineage(targets.join(as_large(rest.select(*on).distinct()), on, "left_semi"))
        far = _far_nearest(rest, targets, on, carry, radius)
        close = close.unionByName(far if which else far.withColumn("_best", F.col("_best.distance")))
    if not which:
        return close.select(*on, "src_id", *carry, F.col("_best").alias("distance"))
    return close.select(*on, "src_id", *carry, F.col("_best.t_id").alias("t_id"), "_best.distance")


def snap_to_nodes(points: DataFrame, nodes: DataFrame, near_m: float = 250.0) -> DataFrame:
    """Nearest street node (id, lat, lon) of each point (src_id, lat, lon) by great circle. Equal places are searched once."""
    places = points.select("lat", "lon").distinct().withColumn("src_id", F.struct("lat", "lon"))
    found = nearest(places, nodes.select(F.col("id").alias("t_id"), "lat", "lon"), (), geo.MATCH_RADIUS_M, near_m)
    return points.select("src_id", "lat", "lon").join(as_large(found.select("src_id.lat", "src_id.lon", "t_id", "distance")), ["lat", "lon"]).select(
        "src_id", F.col("t_id").alias("node"), F.col("distance").alias("distance_m"))


def fold_points(points: DataFrame, key: str) -> DataFrame:
    """Written points of lines (key, lat, lon, w, src_id): repeated coordinates are one point of weight ``w`` and cost one lookup."""
    folded = points.groupBy(key, "lat", "lon").agg(F.count("*").alias("w"))
    return cut_lineage(folded.withColumn("src_id", F.monotonically_increasing_id()))


def mean_nearest(src: DataFrame, dst: DataFrame, key: str, near_m: float = 250.0) -> DataFrame:
    """Mean over a line's points of the distance to the nearest point of the other line with the same key.

    A line whose counterpart is empty gets infinity.
    """
    return mean_nearest_folded(fold_points(src, key), fold_points(dst, key), key, near_m)


def mean_nearest_folded(src: DataFrame, dst: DataFrame, key: str, near_m: float = 250.0) -> DataFrame:
    """:func:`mean_nearest` of lines that :func:`fold_points` wrote."""
    targets = dst.select(key, "lat", "lon").withColumn("t_id", F.lit(0))
    found = nearest(src, targets, [key], geo.OUTLINE_RADIUS_M, near_m, clamp=False, carry=["w"], which=False)
    means = found.groupBy(key).agg((F.sum(F.col("distance") * F.col("w")) / F.sum("w")).alias("mean_nearest_m"))
    return src.select(key).distinct().join(means, key, "left").select(
        key, F.coalesce("mean_nearest_m", F.lit(float("inf"))).alias("mean_nearest_m")
    )
