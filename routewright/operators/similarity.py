"""How well one line traces another: mean nearest distance, discrete Fréchet distance and buffered overlap."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from routewright.functions import geo, scores
from routewright.operators.lines import as_lines, shared_origin
from routewright.operators.scans import segments
from routewright.operators.traces import mean_distances
from routewright.session import cut_lineage, spread

# Densify step, buffers and soft limit in metres.
DENSIFY_M = 25.0
BUFFER_M = 20.0
FRECHET_SOFT_M = 200.0
_SCANLINES_PER_BUFFER = 8
# Scanlines of a band, and intervals on scanlines that a task makes at a time.
_BAND = 64
_SWEPT = 1 << 18
# Points of line pairs that are coupled side by side.
_COUPLED = 1 << 16


def shape_fidelity(ideal: DataFrame, snapped: DataFrame, key: str, step_m: float = DENSIFY_M) -> DataFrame:
    """Half the sum of both mean nearest distances over the ideal line's box diagonal; lower is better.

    Inputs (key, seq, lat, lon). No points on either side, or no diagonal, gives infinity; lines without a key never meet.
    Vertices are shuffled once by line; the points between them are made and searched in the tasks, a pair of lines in one task.
    """
    # Each line is dealt by itself: what it comes from is then not held in one task with what the other comes from.
    sided = [spread(line.select(key, F.lit(side).alias("side"), F.col("seq").cast("long").alias("seq"), "lat", "lon"), key)
             for side, line in ((0, ideal), (1, snapped))]
    vertices = sided[0].unionByName(sided[1])
    lat, lon = (F.when(F.col("side") == 0, F.col(c)) for c in ("lat", "lon"))
    diagonal = geo.haversine(F.min(lat), F.min(lon), F.max(lat), F.max(lon), geo.OUTLINE_RADIUS_M)
    pairs = vertices.groupBy(key, F.when(F.col(key).isNull(), F.col("side")).alias("_apart")).agg(
        diagonal.alias("diagonal_m"), F.collect_list(F.struct("side", "seq", "lat", "lon")).alias("vertices")).drop("_apart")
    schema = T.StructType([pairs.schema[key], *(T.StructField(c, T.DoubleType()) for c in ("diagonal_m", "there_m", "back_m"))])
    means = pairs.mapInArrow(partial(mean_distances, step_m=step_m), schema)
    infinite = F.lit(float("inf"))
    score = 0.5 * (F.col("there_m") + F.col("back_m")) / F.nullif(F.col("diagonal_m"), F.lit(0.0))
    return cut_lineage(means.select(key, F.when(
        F.col("there_m").isNull() | F.col("back_m").isNull() | ~(F.col("diagonal_m") > 0), infinite
    ).otherwise(score).alias("fidelity")))


def _frechet(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Coupling distances of line pairs with equal numbers of points (point, pair).

    By anti-diagonals: each depends only on the two before it, so memory stays linear.
    """
    (n, pairs), m = ax.shape, len(bx)
    if n == 0 or m == 0:
        return np.full(pairs, np.inf)
    older = newer = np.full((n + 1, pairs), np.inf)
    for s in range(n + m - 1):
        low, high = max(0, s - m + 1), min(n, s + 1)
        back = slice(m - 1 - (s - low), m - (s - high + 1))  # the points s - i of the reversed line
        d = np.hypot(ax[low:high] - bx[::-1][back], ay[low:high] - by[::-1][back])
        # Slot i+1 holds cell (i, s-i); slot 0 stands for "no row before".
        reach = np.minimum(np.minimum(newer[low:high], newer[low + 1:high + 1]), older[low:high])
        current = np.full((n + 1, pairs), np.inf)
        current[low + 1:high + 1] = d if s == 0 else np.maximum(reach, d)
        older, newer = newer, current
    return newer[n]


def _frechet_batch(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
    """Pairs of equal sizes are coupled side by side, some ``_COUPLED`` points at a time; a longer pair alone."""
    found, alike = np.empty(len(ax)), {}
    for at, (a, b) in enumerate(zip(ax, bx)):
        alike.setdefault((len(a), len(b)), []).append(at)
    for (n, m), places in alike.items():
        step = max(1, _COUPLED // max(1, n + m))
        for start in range(0, len(places), step):
            some = places[start:start + step]
            found[some] = _frechet(*[np.stack([np.asarray(line.iloc[at], dtype=float) for at in some], axis=1) for line in (ax, ay, bx, by)])
    return pd.Series(found)


def discrete_frechet(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Discrete Fréchet distance in metres of line pairs (key, seq, lat, lon), in the pair's own local frame."""
    origin = shared_origin(a.select(key, "lat", "lon").unionByName(b.select(key, "lat", "lon")), [key])
    pair = (
        as_lines(a, [key]).withColumnRenamed("line", "a")
        .join(as_lines(b, [key]).withColumnRenamed("line", "b"), key, "full_outer").join(origin, key)
    )
    lat0, lon0 = F.col("lat0"), F.col("lon0")
    none = F.array().cast("array<double>")

    def xs(line: str) -> Column:
        return F.coalesce(F.transform(line, lambda p: geo.local_x(p["lon"], lat0, lon0)), none)

    def ys(line: str) -> Column:
        return F.coalesce(F.transform(line, lambda p: geo.local_y(p["lat"], lat0)), none)

    coupling = pandas_udf(_frechet_batch, "double")
    return pair.select(key, coupling(xs("a"), ys("a"), xs("b"), ys("b")).alias("frechet_m"))


def _band_segments(points: DataFrame, key: str, buffer_m: float) -> DataFrame:
    """Segments (side, x, y, x2, y2) of both lines by ``key`` and band of scanlines, with the rows of the band they meet.

    A segment goes to each band its buffer touches, so its scanlines are made where they meet and never shuffled.
    """
    row_height = buffer_m / _SCANLINES_PER_BUFFER
    origin = shared_origin(points, [key])
    local = points.join(origin, key).select(
        key, "side", "seq", geo.local_x(F.col("lon"), F.col("lat0"), F.col("lon0")).alias("x"),
        geo.local_y(F.col("lat"), F.col("lat0")).alias("y"),
    )
    pairs = segments(local, [key, "side"], ["x", "y"]).filter(F.col("next").isNotNull()).select(
        key, "side", "x", "y", F.col("next.x").alias("x2"), F.col("next.y").alias("y2"),
        F.ceil((F.least("y", "next.y") - buffer_m) / row_height - 0.5).alias("first"),
        F.floor((F.greatest("y", "next.y") + buffer_m) / row_height - 0.5).alias("last"),
    )
    band = F.sequence(F.floor(F.col("first") / _BAND), F.floor(F.col("last") / _BAND))
    placed = spread(pairs.select("*", F.explode(band).alias("band")), key, "band")
    low = F.greatest(F.col("first") - F.col("band") * _BAND, F.lit(0)).cast("int")
    high = F.least(F.col("last") - F.col("band") * _BAND, F.lit(_BAND - 1)).cast("int")
    segment = F.struct("side", "x", "y", "x2", "y2", low.alias("low"), high.alias("high"))
    return placed.groupBy(key, "band").agg(F.collect_list(segment).alias("segments"))


def _interval_ends(s: dict, at: np.ndarray, buffer_m: float) -> tuple[np.ndarray, np.ndarray]:
    """Ends in x of the buffered segments ``s`` on the scanlines at height ``at``; NaN where they miss it.

    A buffered segment is convex, so it meets a scanline in one interval whose ends lie on an end disc or on an offset
    edge.
    """
    x, y, x2, y2 = s["x"], s["y"], s["x2"], s["y2"]
    with np.errstate(invalid="ignore", divide="ignore"):
        length = np.hypot(x2 - x, y2 - y)
        nx, ny = -(y2 - y) / length * buffer_m, (x2 - x) / length * buffer_m
        lean = (x2 - x) / (y2 - y)
        h1, h2 = at - y, at - y2
        w1, w2 = np.sqrt(buffer_m * buffer_m - h1 * h1), np.sqrt(buffer_m * buffer_m - h2 * h2)
        low, high = np.fmin(x - w1, x2 - w2), np.fmax(x + w1, x2 + w2)
        for sign in (1, -1):
            up1, up2 = h1 - sign * ny, h2 - sign * ny
            edge = np.where((up1 * up2 <= 0) & (y != y2), x + sign * nx + up1 * lean, np.nan)
            low, high = np.fmin(low, edge), np.fmax(high, edge)
    return low, high


def _sweep(s: dict, n: int, buffer_m: float) -> tuple[np.ndarray, np.ndarray]:
    """Area of overlap and of union, over the row height, of each of ``n`` groups; every segment names its group."""
    rows = np.maximum(s["high"] - s["low"] + 1, 0)
    which = np.repeat(np.arange(len(rows)), rows)
    row = np.arange(len(which)) - np.repeat(np.cumsum(rows) - rows, rows) + s["low"][which]
    at = (s["band"][which] * _BAND + row + 0.5) * (buffer_m / _SCANLINES_PER_BUFFER)
    low, high = _interval_ends({c: s[c][which] for c in ("x", "y", "x2", "y2")}, at, buffer_m)
    kept = ~np.isnan(low)
    line = (s["group"][which] * _BAND + row)[kept]
    x, line = np.concatenate([low[kept], high[kept]]), np.concatenate([line, line])
    step = np.repeat([1, -1], len(x) // 2)
    of_a = np.tile((s["side"][which] == 1)[kept], 2)
    # Events at one x may come in any order: what lies between them has no width. Past a scanline's last event nothing is open.
    order = np.lexsort((x, line.astype(np.uint16) if n * _BAND < 1 << 16 else line))
    x, line, step, of_a = x[order], line[order], step[order], of_a[order]
    in_a, in_b = np.cumsum(np.where(of_a, step, 0)) > 0, np.cumsum(np.where(of_a, 0, step)) > 0
    width = np.append(np.diff(x), 0.0)
    return tuple(np.bincount(line // _BAND, np.where(inside, width, 0.0), n) for inside in (in_a & in_b, in_a | in_b))


def _band_areas(batches: Iterator[pa.RecordBatch], buffer_m: float, most: int = _SWEPT) -> Iterator[pa.RecordBatch]:
    """``both, any, has_a, has_b`` of each band; ``most`` scanlines at a time, of some bands or some rows of a full one."""
    for batch in batches:
        n, key, listed = batch.num_rows, batch.column(0), batch.column("segments")
        ends = listed.offsets.to_numpy() - listed.offsets[0].as_py()
        flat = listed.flatten()
        s = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("side", "x", "y", "x2", "y2", "low", "high")}
        group = np.repeat(np.arange(n), np.diff(ends))
        s["band"] = batch.column("band").to_numpy(zero_copy_only=False)[group]
        both, union, has = np.zeros(n), np.zeros(n), np.zeros((2, n), dtype=bool)
        for side in (1, 2):
            has[side - 1][group[s["side"] == side]] = True
        start = 0
        while start < n:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most // _BAND, "right")) - 1)
            part = {c: v[ends[start]:ends[stop]] for c, v in s.items()}
            part["group"] = group[ends[start]:ends[stop]] - start
            step = max(1, min(_BAND, most // max(1, len(part["group"]))))
            for row in range(0, _BAND, step):
                slab = {**part, "low": np.maximum(part["low"], row), "high": np.minimum(part["high"], row + step - 1)}
                for total, found in zip((both, union), _sweep(slab, stop - start, buffer_m)):
                    total[start:stop] += found
            start = stop
        yield pa.RecordBatch.from_arrays(
            [key, pa.array(both), pa.array(union), pa.array(has[0]), pa.array(has[1])],
            names=[batch.schema.names[0], "both", "any", "has_a", "has_b"])


def buffered_iou(a: DataFrame, b: DataFrame, key: str, buffer_m: float = BUFFER_M) -> DataFrame:
    """Area of overlap over area of union of two buffered lines per key; 0 where a line has fewer than two points.

    Areas are summed over scanlines an eighth of the buffer apart; along a scanline they are exact. Identical lines give
    exactly 1 and disjoint ones exactly 0.
    """
    if buffer_m <= 0:
        raise ValueError("buffer_m must be > 0")
    sided = [line.select(key, F.lit(side).alias("side"), "seq", "lat", "lon") for side, line in ((1, a), (2, b))]
    points = sided[0].unionByName(sided[1])
    banded = _band_segments(points, key, buffer_m)
    schema = T.StructType([banded.schema[key], *(T.StructField(c, T.DoubleType()) for c in ("both", "any")),
                           *(T.StructField(c, T.BooleanType()) for c in ("has_a", "has_b"))])
    areas = banded.mapInArrow(partial(_band_areas, buffer_m=buffer_m), schema).groupBy(key).agg(
        F.sum("both").alias("both"), F.sum("any").alias("any"), F.max("has_a").alias("has_a"), F.max("has_b").alias("has_b"))
    ratio = F.when(F.col("has_a") & F.col("has_b") & (F.col("any") > 0), F.col("both") / F.nullif(F.col("any"), F.lit(0.0))).otherwise(0.0)
    return points.select(key).distinct().join(areas.select(key, ratio.alias("iou")), key, "left").select(
        key, F.coalesce("iou", F.lit(0.0)).alias("iou")
    )


def fidelity(
    snapped: DataFrame, target: DataFrame, key: str, buffer_m: float = BUFFER_M, soft_m: float = FRECHET_SOFT_M
) -> DataFrame:
    """frechet_m, iou, score and passes of each line pair."""
    both = buffered_iou(snapped, target, key, buffer_m).join(discrete_frechet(snapped, target, key), key)
    score = scores.fidelity_combine(F.col("iou"), F.col("frechet_m"), soft_m)
    return both.select(key, "frechet_m", "iou", score.alias("score")).withColumn(
        "passes", scores.passes(F.col("score"))
    )
