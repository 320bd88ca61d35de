"""Pixel-table operators: stroke masks, morphology, components, skeletons and strokes as lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routewright import dims
from routewright.operators.components import connected_components

# Elliptic structuring elements as (dx, dy) offsets.
CROSS_3 = [(0, -1), (-1, 0), (0, 0), (1, 0), (0, 1)]
ELLIPSE_5 = [(0, -2)] + [(dx, dy) for dy in (-1, 0, 1) for dx in range(-2, 3)] + [(0, 2)]
AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]


def saturation(b: Column, g: Column, r: Column) -> Column:
    """0..255 saturation of 8-bit colour, rounded to a whole number."""
    v = F.greatest(b, g, r)
    return F.coalesce(F.floor((v - F.least(b, g, r)) * 255.0 / F.nullif(v, F.lit(0)) + 0.5), F.lit(0))


def signed_hue(b: Column, g: Column, r: Column) -> Column:
    """Hue of 8-bit colour in half degrees, -30..150: 0 is red and negative values stand for 180 more."""
    v = F.greatest(b, g, r)
    third = F.when(v == r, g - b).when(v == g, b - r).otherwise(r - g)
    turn = F.when(v == r, 0.0).when(v == g, 60.0).otherwise(120.0)
    return F.coalesce(F.floor(third * 30.0 / F.nullif(v - F.least(b, g, r), F.lit(0)) + turn + 0.5), F.lit(0))


def _signed_bands(bands: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hue bands on the signed scale, merged where they touch."""
    signed = sorted(
        (max(low - shift, -30), min(high - shift, 150)) for low, high in bands for shift in (0, 180)
        if low - shift <= 150 and high - shift >= -30
    )
    merged: list[tuple[int, int]] = []
    for low, high in signed:
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def stroke_mask(pixels: DataFrame, s_min: int = 90, v_min: int = 60) -> DataFrame:
    """Pixels (image_id, x, y) of a drawn stroke: saturated, bright enough, hue in a stroke band."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    hue = F.lit(False)
    for low, high in _signed_bands(dims.STROKE_HUE_BANDS):
        hue = hue | signed_hue(b, g, r).between(low, high)
    return pixels.filter((F.greatest(b, g, r) >= v_min) & (saturation(b, g, r) >= s_min) & hue).select(
        "image_id", "x", "y"
    )


def image_sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def _shift(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each pixel copied to every offset."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    return mask.select("image_id", "x", "y", F.explode(steps).alias("_d")).select(
        "image_id", (F.col("x") + F.col("_d.dx")).alias("x"), (F.col("y") + F.col("_d.dy")).alias("y")
    )


def dilate(mask: DataFrame, offsets: list[tuple[int, int]], sizes: DataFrame | None = None) -> DataFrame:
    """Union of shifted copies, clipped to the image where ``sizes`` is given."""
    grown = _shift(mask, offsets).distinct()
    if sizes is None:
        return grown
    return grown.join(sizes, "image_id").filter(
        (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))
    ).select("image_id", "x", "y")


def erode(mask: DataFrame, offsets: list[tuple[int, int]], sizes: DataFrame | None = None) -> DataFrame:
    """Pixels all of whose offsets are set: as many shifted copies meet there as there are offsets.

    With ``sizes``, offsets that fall outside the image do not count against a pixel.
    """
    mirrored = [(-dx, -dy) for dx, dy in offsets]
    met = _shift(mask, mirrored).groupBy("image_id", "x", "y").agg(F.count("*").alias("n"))
    needed = F.lit(len(offsets))
    if sizes is not None:
        met = met.join(sizes, "image_id").filter(
            (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))
        )
        for dx, dy in offsets:
            px, py = F.col("x") + dx, F.col("y") + dy
            inside = (px >= 0) & (py >= 0) & (px < F.col("width")) & (py < F.col("height"))
            needed = needed - F.when(inside, 0).otherwise(1)
    return met.filter(F.col("n") == needed).select("image_id", "x", "y")


def morph_close(
    mask: DataFrame, sizes: DataFrame | None = None, offsets: list[tuple[int, int]] = CROSS_3
) -> DataFrame:
    """Dilate then erode, inside the image where ``sizes`` (image_id, width, height) is given."""
    return erode(dilate(mask, offsets, sizes), offsets, sizes)


def saturated_mask(pixels: DataFrame, s_min: int = 110, v_min: int = 70) -> DataFrame:
    """Strongly coloured pixels, dilated by a 5x5 ellipse inside the image."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    coloured = pixels.filter((F.greatest(b, g, r) >= v_min) & (saturation(b, g, r) >= s_min)).select(
        "image_id", "x", "y"
    )
    return dilate(coloured, ELLIPSE_5, image_sizes(pixels))


def mask_components(mask: DataFrame) -> DataFrame:
    """Add ``component`` to 8-connected pixels. Horizontal runs are the graph's nodes, so long strokes stay small."""
    run = Window.partitionBy("image_id", "y").orderBy("x")
    runs = mask.withColumn("_start", F.col("x") - F.row_number().over(run)).withColumn(
        "node", F.min("x").over(Window.partitionBy("image_id", "y", "_start")) + F.col("y") * F.lit(4294967296)
    ).select("image_id", "x", "y", "node")
    below = _shift_nodes(runs)
    links = below.join(runs, ["image_id", "x", "y"]).select(
        "image_id", F.col("above").alias("a"), F.col("node").alias("b")
    ).distinct()
    labelled = connected_components(runs.select("image_id", "node").distinct(), links, ["image_id"])
    return runs.join(labelled, ["image_id", "node"]).select("image_id", "x", "y", "component")


def _shift_nodes(runs: DataFrame) -> DataFrame:
    return runs.select(
        "image_id", F.col("node").alias("above"), (F.col("y") + 1).alias("y"),
        F.explode(F.array(F.col("x") - 1, F.col("x"), F.col("x") + 1)).alias("x"),
    )


def largest_component(mask: DataFrame, min_area: int = 200) -> DataFrame:
    """Pixels of each image's largest component; none where even that is smaller than ``min_area``.

    Of equal areas the component met first in row order wins.
    """
    labelled = mask_components(mask)
    areas = labelled.groupBy("image_id", "component").agg(F.count("*").alias("area"))
    biggest = areas.groupBy("image_id").agg(
        F.min_by(F.struct("component", "area"), F.struct(-F.col("area"), "component")).alias("_b")
    ).filter(F.col("_b.area") >= min_area).select("image_id", F.col("_b.component").alias("component"))
    return labelled.join(biggest, ["image_id", "component"], "left_semi").select("image_id", "x", "y")


def clean_mask(mask: DataFrame, sizes: DataFrame | None = None, min_area: int = 200) -> DataFrame:
    return largest_component(morph_close(mask, sizes), min_area)


def pixel_degree(mask: DataFrame) -> DataFrame:
    """Set neighbours (0..8) of every set pixel."""
    touched = _shift(mask, AROUND).groupBy("image_id", "x", "y").agg(F.count("*").alias("degree"))
    return mask.join(touched, ["image_id", "x", "y"], "left").select(
        "image_id", "x", "y", F.coalesce("degree", F.lit(0)).alias("degree")
    )


def endpoints(mask: DataFrame) -> DataFrame:
    """Pixels with exactly one neighbour."""
    return pixel_degree(mask).filter("degree = 1").select("image_id", "x", "y")


def _thin(grid: np.ndarray) -> np.ndarray:
    """Two-pass parallel thinning of a padded 0/1 raster until nothing changes."""
    changed = True
    while changed:
        changed = False
        for first_pass in (True, False):
            n = [np.roll(grid, shift, (0, 1)) for shift in
                 ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            count = sum(n)
            turns = sum((n[i] == 0) & (n[(i + 1) % 8] == 1) for i in range(8))
            north, east, south, west = n[0], n[2], n[4], n[6]
            if first_pass:
                open_sides = (north * east * south == 0) & (east * south * west == 0)
            else:
                open_sides = (north * east * west == 0) & (north * south * west == 0)
            gone = (grid == 1) & (count >= 2) & (count <= 6) & (turns == 1) & open_sides
            if gone.any():
                grid = np.where(gone, 0, grid)
                changed = True
    return grid


def _walk(pixels: set, degree: dict, start: tuple) -> list:
    """Follow unvisited neighbours from (y, x), least-connected first, then top-left first."""
    path, seen, at = [], set(), start
    while at is not None:
        seen.add(at)
        path.append(at)
        options = [
            (degree[q], q) for q in ((at[0] + dy, at[1] + dx) for dx, dy in AROUND) if q in pixels and q not in seen
        ]
        at = min(options)[1] if options else None
    return path


def _trace(pdf: pd.DataFrame) -> pd.DataFrame:
    x0, y0 = int(pdf["x"].min()), int(pdf["y"].min())
    grid = np.zeros((int(pdf["y"].max()) - y0 + 3, int(pdf["x"].max()) - x0 + 3), dtype=np.int8)
    grid[pdf["y"] - y0 + 1, pdf["x"] - x0 + 1] = 1
    pixels = {(int(y), int(x)) for y, x in np.argwhere(_thin(grid) == 1)}
    degree = {p: sum((p[0] + dy, p[1] + dx) in pixels for dx, dy in AROUND) for p in pixels}
    starts = sorted(p for p in pixels if degree[p] == 1) or [min(pixels)]
    best = max((_walk(pixels, degree, s) for s in starts), key=len)
    return pd.DataFrame({
        "image_id": pdf["image_id"].iloc[0], "seq": range(len(best)),
        "x": [x + x0 - 1 for _, x in best], "y": [y + y0 - 1 for y, _ in best],
    })


def stroke_to_polyline(mask: DataFrame) -> DataFrame:
    """One line per image: thin the mask to a pixel's width, walk it from every end and keep the longest walk.

    Thinning and walking depend on their own earlier steps, so one image's (largest-component) raster is one unit of
    work; images run in parallel.
    """
    return mask.select("image_id", "x", "y").groupBy("image_id").applyInPandas(
        _trace, "image_id long, seq long, x int, y int"
    )


def extract_route(pixels: DataFrame, min_area: int = 200) -> DataFrame:
    """Stroke line (image_id, seq, x, y) of every image that shows one."""
    return stroke_to_polyline(clean_mask(stroke_mask(pixels), image_sizes(pixels), min_area))
