"""Street graphs: path lengths, shortest paths and map matching."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewright.functions import geo
from routewright.operators.lines import as_lines, as_points, downsample, padded_box
from routewright.operators.nearest import nearest, snap_to_nodes
from routewright.operators.scans import CHUNK, running, segments
from routewright.session import cut_lineage, staged_rounds

GRAPH_CELL = 0.02


def shortest_parallel(edges: DataFrame) -> DataFrame:
    """Parallel edges reduced to the shortest of each direction."""
    return edges.groupBy("u", "v").agg(F.min(F.coalesce("length", F.lit(0.0))).alias("length"))


def path_length(paths: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Length along node sequences (keys..., seq, node): shortest parallel edge per step, 0 where there is none."""
    steps = segments(paths, keys, ["node"]).select(*keys, F.col("node").alias("u"), F.col("next.node").alias("v"))
    measured = steps.join(shortest_parallel(edges), ["u", "v"], "left")
    return measured.groupBy(*keys).agg(F.sum(F.coalesce("length", F.lit(0.0))).alias("length_m"))


def graph_in_boxes(nodes: DataFrame, edges: DataFrame, boxes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each box (key, south, north, west, east), by an equi-join on grid cells."""
    center_lat, center_lon = (F.col("south") + F.col("north")) / 2, (F.col("west") + F.col("east")) / 2
    corner = F.greatest(*[
        geo.haversine(center_lat, center_lon, lat, lon, geo.CLUSTER_RADIUS_KM, True)
        for lat in (F.col("south"), F.col("north")) for lon in (F.col("west"), F.col("east"))
    ])
    reach = F.degrees(corner / geo.CLUSTER_RADIUS_KM) * 1.001
    probe = geo.explode_cells(boxes, center_lat, center_lon, reach, GRAPH_CELL)
    placed = nodes.withColumn("cell", geo.cell_id(F.col("lat"), F.col("lon"), GRAPH_CELL))
    inside = probe.join(placed, "cell").filter(
        F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    ).select(key, "id", "lat", "lon")
    ends = inside.select(key, F.col("id"))
    kept = (
        ends.withColumnRenamed("id", "u").join(shortest_parallel(edges), "u")
        .join(ends.withColumnRenamed("id", "v"), [key, "v"]).select(key, "u", "v", "length")
    )
    return inside, kept


def shortest_paths(pairs: DataFrame, edges: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Shortest directed path of each distinct (key..., u, v): columns dist and path (node array), NULL if unreachable.

    All pairs are relaxed together, one hop per round, and each round is checkpointed. A partial path is dropped once it
    is longer than a known way to its target, so the search stays near the pair. ``edges`` carries ``key`` when each key
    has its own graph. Ties go to the lexicographically smaller node sequence.
    """
    key = list(key)
    pair = [*key, "src", "dst"]
    asked = cut_lineage(pairs.select(*key, F.col("u").alias("src"), F.col("v").alias("dst")).distinct())
    hops = cut_lineage(
        edges.groupBy(*key, F.col("u").alias("node"), F.col("v").alias("to"))
        .agg(F.min(F.coalesce("length", F.lit(0.0))).alias("length"))
    )
    settled = asked.select(
        *pair, F.col("src").alias("node"), F.lit(0.0).alias("dist"), F.array("src").alias("path"), F.lit(0).alias("born")
    )
    with staged_rounds(pairs.sparkSession):
        for round_no in itertools.count(1):
            bound = settled.filter(F.col("node") == F.col("dst")).select(*pair, F.col("dist").alias("_bound"))
            front = settled.filter((F.col("born") == round_no - 1) & (F.col("node") != F.col("dst")))
            grown = (
                front.join(hops, [*key, "node"]).filter(~F.array_contains("path", F.col("to")))
                .select(*pair, F.col("to").alias("node"), (F.col("dist") + F.col("length")).alias("dist"),
                        F.concat("path", F.array("to")).alias("path"), F.lit(round_no).alias("born"))
                .join(bound, pair, "left").filter(F.col("_bound").isNull() | (F.col("dist") <= F.col("_bound")))
                .drop("_bound")
            )
            # An entry is replaced only by a better one, so equal paths never re-enter the frontier.
            best = F.min(F.struct("dist", "path", "born"))
            merged = settled.unionByName(grown).groupBy(*pair, "node").agg(best.alias("_b")).select(*pair, "node", "_b.*")
            settled = cut_lineage(merged)
            if settled.filter((F.col("born") == round_no) & (F.col("node") != F.col("dst"))).isEmpty():
                break
    found = settled.filter(F.col("node") == F.col("dst")).select(*pair, "dist", "path")
    return asked.join(found, pair, "left").select(
        *key, F.col("src").alias("u"), F.col("dst").alias("v"), "dist", "path"
    )


def stitch_paths(steps: DataFrame, key: str) -> DataFrame:
    """Node sequence of each route from its pair paths (key, seq, u, v, path), in order of seq.

    Pairs with u = v and pairs without a path are left out; a path's first node is dropped when the route already ends
    there. Rows: key, seq (dense), node.
    """
    walked = steps.filter((F.col("u") != F.col("v")) & F.col("path").isNotNull()).select(key, "seq", "u", "v", "path")
    chunk = F.floor(F.col("seq") / CHUNK)
    joined = running(walked, [key], ["seq"], F.col("v"), "last", "_tail", chunk, inclusive=False).withColumn(
        "_nodes", F.when(F.col("_tail") == F.col("u"), F.slice("path", 2, F.size("path"))).otherwise(F.col("path"))
    )
    placed = running(joined, [key], ["seq"], F.size("_nodes"), "sum", "_at", chunk, inclusive=False)
    return placed.select(key, "_at", F.posexplode("_nodes").alias("_i", "node")).select(
        key, (F.col("_at") + F.col("_i")).cast("long").alias("seq"), "node"
    )


def map_match(
    lines: DataFrame, nodes: DataFrame, edges: DataFrame, key: str, step_m: float = 30.0, pad_m: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """Snap lines (key, seq, lat, lon) to streets. Returns (routes, points of the matched lines).

    routes: key, length_m, waypoints_used, snapped_pairs, unreachable_segments. Lines with fewer than two waypoints come
    back unchanged with zeros. ``pad_m`` limits each line to the graph inside its padded box, as a per-line download
    would.
    """
    records = as_lines(lines, [key]).withColumn("line", downsample(F.col("line"), step_m))
    waypoints = cut_lineage(as_points(records, [key]))
    short = records.filter(F.size("line") < 2)
    snap_id = F.struct(F.col(key), F.col("seq"))
    numbered = waypoints.join(short.select(key), key, "left_anti").withColumn("src_id", snap_id)
    if pad_m is None:
        snapped = snap_to_nodes(numbered, nodes)
        graph, graph_key = edges, []
    else:
        local_nodes, graph = graph_in_boxes(nodes, edges, padded_box(lines, [key], pad_m), key)
        local_nodes, graph_key = cut_lineage(local_nodes), [key]
        snapped = _snap_within(numbered, local_nodes, key)
    stops = numbered.join(snapped, "src_id", "left").select(key, "seq", "node")
    pairs = cut_lineage(
        segments(stops, [key], ["node"]).filter(F.col("next").isNotNull())
        .select(key, "seq", F.col("node").alias("u"), F.col("next.node").alias("v"))
    )
    moving = pairs.filter(F.col("u") != F.col("v"))
    ways = shortest_paths(moving, graph, graph_key)
    steps = cut_lineage(pairs.join(ways, [*graph_key, "u", "v"], "left"))
    path = stitch_paths(steps, key)
    matched = path.join(nodes.select(F.col("id").alias("node"), "lat", "lon"), "node").select(
        key, "seq", "node", "lat", "lon"
    )
    counts = steps.groupBy(key).agg(
        (F.max("seq") + 2).alias("waypoints_used"), F.count_if(F.col("u") != F.col("v")).alias("snapped_pairs"),
        F.count_if((F.col("u") != F.col("v")) & F.col("path").isNull()).alias("unreachable_segments"),
    )
    lengths = path_length(path, edges, [key])
    routes = counts.join(lengths, key, "left").select(
        key, F.coalesce("length_m", F.lit(0.0)).alias("length_m"), "waypoints_used", "snapped_pairs",
        "unreachable_segments",
    ).unionByName(short.select(
        key, F.lit(0.0).alias("length_m"), F.size("line").cast("long").alias("waypoints_used"),
        F.lit(0).cast("long").alias("snapped_pairs"), F.lit(0).cast("long").alias("unreachable_segments"),
    ))
    echoed = as_points(short, [key]).select(key, "seq", F.lit(None).cast("long").alias("node"), "lat", "lon")
    return routes, matched.unionByName(echoed)


def _snap_within(points: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    found = nearest(
        points, nodes.select(key, F.col("id").alias("t_id"), "lat", "lon"), [key], geo.MATCH_RADIUS_M, 250.0
    )
    return found.select("src_id", F.col("t_id").alias("node"), F.col("distance").alias("distance_m"))
