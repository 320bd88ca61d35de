"""Radius search over a catalogue of points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routewright.functions import geo
from routewright.session import as_large, cut_lineage

# Cell sizes in degrees; a query uses the smallest one that covers its radius with a few cells.
CELL_SIZES = [0.1, 1.0, 10.0]
_KM_PER_DEG = 111.0


def _inside(box: Column, lat: Column, lon: Column) -> Column:
    return lat.between(box["south"], box["north"]) & lon.between(box["west"], box["east"])


def search_near(
    catalogue: DataFrame, lat: float, lon: float, radius_km: float, category: str | None = None, limit: int = 50,
    exact: bool = False,
) -> DataFrame:
    """One query: the box reaches the scan as a pushed filter, the nearest ``limit`` come from a distributed top-k."""
    if radius_km <= 0:
        return catalogue.withColumn("distance_km", F.lit(0.0)).filter(F.lit(False))
    rows = catalogue
    if not exact:
        d_lat = radius_km / geo.SEARCH_KM_PER_DEG
        d_lon = d_lat / max(0.01, math.cos(math.radians(lat)))
        rows = rows.filter(
            F.col("lat").between(lat - d_lat, lat + d_lat) & F.col("lon").between(lon - d_lon, lon + d_lon)
        )
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    distance = geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"), geo.SEARCH_RADIUS_KM)
    return (
        rows.withColumn("distance_km", distance).filter(F.col("distance_km") <= radius_km)
        .orderBy("distance_km", "id").limit(limit)
    )


def radius_search(
    queries: DataFrame, catalogue: DataFrame, limit: int = 50, exact: bool = False,
) -> DataFrame:
    """Nearest ``limit`` catalogue rows of every query (query_id, lat, lon, radius_km, category).

    A NULL category searches all. Default result is box and disc, as a single search gives; ``exact`` is the disc alone.

    * Equi-join on grid cells; the cell size follows the query's radius, so a query touches a bounded number of cells.
    * Equal queries are searched once, and their answer is given to each of them.
    * Queries meet spots (a whole city often shares its centre), one row per category and place, with the number of rows
      there; only rows of spots that can still be among the first ``limit`` are fetched, at most ``limit`` of a spot.
    * Ranks of spots and rows are pruned map-side by the window group limit.
    """
    place = ["category", "lat", "lon"]
    spot = Window.partitionBy(*place).orderBy("id")
    points = (
        catalogue.filter("lat IS NOT NULL AND lon IS NOT NULL")
        .withColumn("_n", F.row_number().over(spot)).filter(F.col("_n") <= limit)
    )
    question = ["q_lat", "q_lon", "radius_km", "q_category"]
    asked = queries.filter("radius_km > 0").select(
        "query_id", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), "radius_km", F.col("category").alias("q_category"))
    distinct = asked.groupBy(*question).agg(F.min("query_id").alias("_q")).withColumn(
        "box", geo.radius_box(F.col("q_lat"), F.col("q_lon"), F.col("radius_km")))
    reach = F.col("radius_km") / _KM_PER_DEG * 1.01
    level = F.lit(len(CELL_SIZES) - 1)
    for i in range(len(CELL_SIZES) - 2, -1, -1):
        level = F.when(reach <= 4 * CELL_SIZES[i], F.lit(i)).otherwise(level)
    distinct = cut_lineage(distinct.withColumn("level", level))
    probe = None
    for i, size in enumerate(CELL_SIZES):
        part = geo.explode_cells(distinct.filter(F.col("level") == i), F.col("q_lat"), F.col("q_lon"), reach, size)
        probe = part if probe is None else probe.unionByName(part)
    spots = points.groupBy(*place).agg(F.count("*").alias("_rows"))
    placed = spots.withColumn("_c", F.explode(F.array(*[
        F.struct(F.lit(i).alias("level"), geo.cell_id(F.col("lat"), F.col("lon"), size).alias("cell"))
        for i, size in enumerate(CELL_SIZES)
    ]))).select("*", "_c.*").drop("_c")

    distance = geo.haversine(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon"), geo.SEARCH_RADIUS_KM)
    wanted = F.col("q_category").isNull() | (F.col("category") == F.col("q_category"))
    near = as_large(probe).join(as_large(placed), ["level", "cell"]).filter(wanted)
    if not exact:
        near = near.filter(_inside(F.col("box"), F.col("lat"), F.col("lon")))
    near = near.withColumn("distance_km", distance).filter(F.col("distance_km") <= F.col("radius_km"))
    # Spots that fewer than ``limit`` rows of strictly nearer spots precede; the rank alone is pruned map-side.
    by_distance = Window.partitionBy("_q").orderBy("distance_km")
    near = near.select("_q", *place, "_rows", "distance_km").withColumn("_rank", F.rank().over(by_distance)).filter(F.col("_rank") <= limit)
    upto = F.sum("_rows").over(by_distance.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    level_with = F.sum("_rows").over(Window.partitionBy("_q", "distance_km"))
    near = near.withColumn("_before", upto - level_with).filter(F.col("_before") < limit)
    near = near.select("_q", "distance_km", *[F.col(c).alias(f"_{c}") for c in place])
    rows = as_large(near).join(
        as_large(points.drop("_n", "distance_km")), (F.col("_lat") == F.col("lat")) & (F.col("_lon") == F.col("lon")) & F.col("_category").eqNullSafe(F.col("category")))
    order = Window.partitionBy("_q").orderBy("distance_km", "id")
    found = rows.drop("_lat", "_lon", "_category").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"d.{c}")) for c in question]
    answers = as_large(asked).alias("a").join(distinct.select("_q", *question).alias("d"), same).select("a.query_id", "d._q")
    columns = [c for c in catalogue.columns if c not in ("distance_km", "rank")]
    return as_large(answers).join(as_large(found), "_q").select("query_id", *columns, "distance_km", "rank")
