"""Ordered-line operators over point tables ``(keys..., seq, x|lon, y|lat)`` with ``seq`` dense from 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routewright.functions import geo
from routewright.operators.scans import CHUNK, segments


def planar_step(x: Column, y: Column, nxt: Column) -> Column:
    return F.hypot(nxt["x"] - x, nxt["y"] - y)


def ground_step(radius_m: float, clamp: bool) -> "callable":
    def step(lat: Column, lon: Column, nxt: Column) -> Column:
        return geo.haversine(lat, lon, nxt["lat"], nxt["lon"], radius_m, clamp)
    return step


def line_length(
    points: DataFrame, keys: Sequence[str], cols: Sequence[str] = ("x", "y"), step=planar_step, name: str = "length"
) -> DataFrame:
    """Sum of consecutive distances per line; 0 for a single point."""
    pairs = segments(points, keys, cols)
    distance = F.coalesce(step(F.col(cols[0]), F.col(cols[1]), F.col("next")), F.lit(0.0))
    return pairs.groupBy(*keys).agg(F.sum(distance).alias(name))


def line_box(points: DataFrame, keys: Sequence[str], cols: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """min/max of both coordinates per line."""
    a, b = cols
    return points.groupBy(*keys).agg(
        F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}"), F.min(b).alias(f"min_{b}"), F.max(b).alias(f"max_{b}")
    )


def padded_box(points: DataFrame, keys: Sequence[str], pad_m: float = 200.0) -> DataFrame:
    """Geographic box grown by ``pad_m``; columns south, north, west, east."""
    box = line_box(points, keys)
    padded = geo.pad_box(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"), pad_m)
    return box.select(*keys, padded.alias("_box")).select(*keys, "_box.*")


def box_diagonal(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Diagonal of the line's box in metres."""
    box = line_box(points, keys)
    return box.select(*keys, geo.haversine(
        F.col("min_lat"), F.col("min_lon"), F.col("max_lat"), F.col("max_lon"), geo.OUTLINE_RADIUS_M
    ).alias("diagonal_m"))


def shared_origin(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Centre of the box around all points of a key (both lines of a pair)."""
    box = line_box(points, keys)
    return box.select(
        *keys, ((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat0"),
        ((F.col("min_lon") + F.col("max_lon")) / 2).alias("lon0"),
    )


def resample(points: DataFrame, keys: Sequence[str], n: int | str, chunk: int = CHUNK) -> DataFrame:
    """``n`` points evenly spaced by length, both ends kept; ``n`` is a number or a column of ``points``.

    Lengths are summed inside chunks and carried across them; each segment then emits the targets that fall on it, so
    no target is matched against the other segments of its line.
    """
    if isinstance(n, int) and n < 2:
        raise ValueError("resample needs n >= 2")
    count = F.lit(n) if isinstance(n, int) else F.col(n)
    cols = ["x", "y"] if isinstance(n, int) else ["x", "y", n]
    chunk_no = F.floor(F.col("seq") / chunk)
    pairs = (
        segments(points, keys, cols, chunk)
        .withColumn("_chunk", chunk_no)
        .withColumn("_len", F.coalesce(planar_step(F.col("x"), F.col("y"), F.col("next")), F.lit(0.0)))
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    totals = pairs.groupBy(*keys, "_chunk").agg(F.sum("_len").alias("_sum"), F.max("seq").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy(*keys)
    carried = totals.select(
        *keys, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"),
        F.sum("_sum").over(line).alias("_total"), F.max("_last").over(line).alias("_last"),
    )
    placed = (
        pairs.withColumn("_end", F.sum("_len").over(inside))
        .join(carried, [*keys, "_chunk"])
        .withColumn("_end", F.col("_before") + F.col("_end"))
        .withColumn("_start", F.col("_end") - F.col("_len"))
        .withColumn("_step", F.nullif(F.col("_total"), F.lit(0.0)) / (count - 1))
    )
    flat = F.col("_total") == 0
    none = F.array().cast("array<long>")
    low = F.floor((F.col("_start")) / F.col("_step")) + 1
    high = F.least(F.floor(F.col("_end") / F.col("_step")), (count - 2).cast("long"))
    targets = F.when(flat, F.when(F.col("seq") == 0, F.sequence(F.lit(0).cast("long"), (count - 1).cast("long")))
                     .otherwise(none)).otherwise(F.concat(
        F.when(F.col("seq") == 0, F.array(F.lit(0).cast("long"))).otherwise(none),
        F.when((F.col("_len") > 0) & (low <= high), F.sequence(low, high)).otherwise(none),
        F.when(F.col("seq") == F.col("_last"), F.array((count - 1).cast("long"))).otherwise(none),
    ))
    i = F.col("_i")
    share = F.when(
        flat | (i == 0) | (i == count - 1), F.lit(0.0)
    ).otherwise((i * F.col("_step") - F.col("_start")) / F.nullif(F.col("_len"), F.lit(0.0)))
    emitted = placed.withColumn("_i", F.explode(targets)).withColumn("_share", share)
    moved = [
        (F.col(c) + F.coalesce(F.col("_share") * (F.col("next")[c] - F.col(c)), F.lit(0.0))).alias(c)
        for c in ("x", "y")
    ]
    return emitted.select(*keys, i.alias("seq"), *moved)


def densify(points: DataFrame, keys: Sequence[str], step_m: float) -> DataFrame:
    """Split segments longer than ``step_m``; rows are ordered by (seq, part). A step of 0 or less changes nothing."""
    if step_m <= 0:
        return points.select(*keys, "seq", F.lit(0).alias("part"), "lat", "lon")
    pairs = segments(points, keys, ["lat", "lon"])
    distance = geo.haversine(
        F.col("lat"), F.col("lon"), F.col("next.lat"), F.col("next.lon"), geo.OUTLINE_RADIUS_M
    )
    parts = pairs.withColumn("_n", F.greatest(F.lit(1), F.ceil(distance / step_m)).cast("int"))
    steps = F.when(F.col("next").isNotNull(), F.sequence(F.lit(1), F.col("_n"))).otherwise(F.array().cast("array<int>"))
    # The line's first point stands as part 0 of segment 0.
    steps = F.when(F.col("seq") == 0, F.concat(F.array(F.lit(0)), steps)).otherwise(steps)
    share = F.col("part") / F.col("_n")

    def between(c: str) -> Column:
        along = F.col(c) + (F.col(f"next.{c}") - F.col(c)) * share
        return F.when(F.col("part") == 0, F.col(c)).when(F.col("_n") == 1, F.col(f"next.{c}")).otherwise(along)

    return parts.withColumn("part", F.explode(steps)).select(
        *keys, "seq", "part", between("lat").alias("lat"), between("lon").alias("lon")
    )


def as_lines(points: DataFrame, keys: Sequence[str], cols: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """One record per line: ``line`` = array of point structs in order. For jobs whose unit is the whole line."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", *cols)))
    return points.groupBy(*keys).agg(
        F.transform(ordered, lambda p: F.struct(*[p[c].alias(c) for c in cols])).alias("line")
    )


def as_points(lines: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """Inverse of :func:`as_lines`."""
    return lines.select(*keys, F.posexplode(line).alias("seq", "_p")).select(
        *keys, F.col("seq").cast("long"), "_p.*"
    )


def downsample(line: Column, step_m: float = 30.0) -> Column:
    """Waypoints of a line record: first vertex, then each vertex that completes ``step_m`` since the last one kept,
    then the last vertex if it differs. The walked distance restarts at 0 after every kept vertex."""
    first = F.element_at(line, 1)
    state = F.struct(
        F.array(first).alias("kept"), F.lit(0.0).alias("walked"), first.alias("at")
    )

    def visit(acc: Column, p: Column) -> Column:
        at = acc["at"]
        walked = acc["walked"] + geo.haversine(at["lat"], at["lon"], p["lat"], p["lon"], geo.MATCH_RADIUS_M, True)
        return F.when(
            walked >= step_m,
            F.struct(F.concat(acc["kept"], F.array(p)).alias("kept"), F.lit(0.0).alias("walked"), p.alias("at")),
        ).otherwise(F.struct(acc["kept"].alias("kept"), walked.alias("walked"), p.alias("at")))

    def finish(acc: Column) -> Column:
        last = acc["at"]
        return F.when(F.element_at(acc["kept"], -1) != last, F.concat(acc["kept"], F.array(last))).otherwise(
            acc["kept"]
        )

    rest = F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))
    return F.when(F.size(line) > 1, F.aggregate(rest, state, visit, finish)).otherwise(line)
