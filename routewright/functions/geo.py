"""Distances, boxes, local frames and grid cells as column expressions (degrees in, degrees or metres out)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Each job keeps its own earth radius and degree length; they must not be unified.
SEARCH_RADIUS_KM = 6371.0088
CLUSTER_RADIUS_KM = 6371.0
MATCH_RADIUS_M = 6371000.0
OUTLINE_RADIUS_M = 6371008.8
SEARCH_KM_PER_DEG = 111.0
PAD_M_PER_DEG = 111000.0
SHAPE_M_PER_DEG = 111320.0
RING_KM_PER_DEG = 111.32


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float, clamp: bool = False) -> Column:
    """Great-circle distance in the unit of ``radius``; ``clamp`` keeps rounding from leaving asin's domain."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = F.sqrt(half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon)
    if clamp:
        chord = F.least(F.lit(1.0), chord)
    return F.lit(2 * radius) * F.asin(chord)


def radius_box(lat: Column, lon: Column, radius_km: Column) -> Column:
    """struct(south, north, west, east) in degrees; no wrap at the date line."""
    d_lat = radius_km / SEARCH_KM_PER_DEG
    d_lon = radius_km / (F.lit(SEARCH_KM_PER_DEG) * F.greatest(F.lit(0.01), F.cos(F.radians(lat))))
    return F.struct(
        (lat - d_lat).alias("south"), (lat + d_lat).alias("north"),
        (lon - d_lon).alias("west"), (lon + d_lon).alias("east"),
    )


def pad_box(south: Column, north: Column, west: Column, east: Column, pad_m: float) -> Column:
    """Box grown by ``pad_m`` metres on every side."""
    if pad_m <= 0:
        d_lat = d_lon = F.lit(0.0)
    else:
        d_lat = F.lit(pad_m / PAD_M_PER_DEG)
        mid_cos = F.greatest(F.cos(F.radians((south + north) / 2)), F.lit(1e-6))
        d_lon = F.lit(pad_m) / (F.lit(PAD_M_PER_DEG) * mid_cos)
    return F.struct(
        (south - d_lat).alias("south"), (north + d_lat).alias("north"),
        (west - d_lon).alias("west"), (east + d_lon).alias("east"),
    )


def local_x(lon: Column, lat0: Column, lon0: Column) -> Column:
    return F.radians(lon - lon0) * MATCH_RADIUS_M * F.cos(F.radians(lat0))


def local_y(lat: Column, lat0: Column) -> Column:
    return F.radians(lat - lat0) * MATCH_RADIUS_M


def to_local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Equirectangular metres east/north of the anchor."""
    return F.struct(local_x(lon, lat0, lon0).alias("x"), local_y(lat, lat0).alias("y"))


def from_local_xy(x: Column, y: Column, lat0: Column, lon0: Column) -> Column:
    """Inverse of :func:`to_local_xy`."""
    return F.struct(
        (lat0 + F.degrees(y / MATCH_RADIUS_M)).alias("lat"),
        (lon0 + F.degrees(x / (F.lit(MATCH_RADIUS_M) * F.cos(F.radians(lat0))))).alias("lon"),
    )


def project_offset(dx_m: Column, dy_m: Column, lat: Column, lon: Column) -> Column:
    """Point ``dx_m`` east and ``dy_m`` north of a centre, in the shape-drawing frame."""
    return F.struct(
        (lat + dy_m / SHAPE_M_PER_DEG).alias("lat"),
        (lon + dx_m / (F.lit(SHAPE_M_PER_DEG) * F.cos(F.radians(lat)))).alias("lon"),
    )


# --- grid cells -------------------------------------------------------------------------------------------------
#
# Latitude is cut into bands of ``size`` degrees and each band into equal longitude cells at least ``size`` degrees
# of great circle wide at its equator side. A cell id is (band << 32) | column, so one long is a complete join key.

_COLUMN_BITS = 4294967296


def _bands(size: float) -> int:
    return max(1, math.ceil(180.0 / size - 1e-9))


def _band_of(lat: Column, size: float) -> Column:
    return F.least(F.greatest(F.floor((lat + 90.0) / size), F.lit(0)), F.lit(_bands(size) - 1)).cast("long")


def _columns_in(band: Column, size: float) -> Column:
    south = band * size - 90.0
    nearest_equator = F.greatest(F.lit(0.0), south, -(south + size))
    return F.greatest(F.lit(1), F.floor(360.0 / size * F.cos(F.radians(nearest_equator)))).cast("long")


def cell_id(lat: Column, lon: Column, size: float) -> Column:
    """Grid cell that holds the point."""
    band = _band_of(lat, size)
    columns = _columns_in(band, size)
    column = F.pmod(F.floor((lon + 180.0) / 360.0 * columns), columns)
    return band * _COLUMN_BITS + column


def longitude_spread(lat: Column, reach_deg: Column) -> Column:
    """Half width in degrees of longitude of a cap: asin(sin r / cos lat) off the poles, everything near them."""
    ratio = F.sin(F.radians(F.least(reach_deg, F.lit(90.0)))) / F.cos(F.radians(lat))
    return F.when(
        (F.abs(lat) + reach_deg < 89.9) & (ratio < 1.0), F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.000001
    ).otherwise(F.lit(180.0))


def _column_range(lon: Column, spread: Column, columns: Column) -> Column:
    """Column numbers that meet the spread, unwrapped and none twice."""
    first = F.floor((lon - spread + 180.0) / 360.0 * columns)
    last = F.floor((lon + spread + 180.0) / 360.0 * columns)
    return F.sequence(first, F.least(last, first + columns - 1))


def cells_within(lat: Column, lon: Column, reach_deg: Column, size: float) -> Column:
    """Ids of all cells that may hold a point within ``reach_deg`` degrees of great circle; wraps the date line."""
    spread = longitude_spread(lat, reach_deg)

    def cells_of(band: Column) -> Column:
        columns = _columns_in(band, size)
        return F.transform(
            _column_range(lon, spread, columns), lambda c: band * _COLUMN_BITS + F.pmod(c, columns)
        )

    bands = F.sequence(_band_of(lat - reach_deg, size), _band_of(lat + reach_deg, size))
    return F.flatten(F.transform(bands, cells_of))


def explode_cells(
    df: DataFrame, lat: Column, lon: Column, reach_deg: Column, size: float, name: str = "cell"
) -> DataFrame:
    """One row per cell of :func:`cells_within`. Bands and columns are exploded in turn, so all of it is compiled code."""
    banded = df.withColumns({
        "_lon": lon, "_spread": longitude_spread(lat, reach_deg),
        "_band": F.explode(F.sequence(_band_of(lat - reach_deg, size), _band_of(lat + reach_deg, size))),
    }).withColumn("_columns", _columns_in(F.col("_band"), size))
    spread = banded.withColumn("_c", F.explode(_column_range(F.col("_lon"), F.col("_spread"), F.col("_columns"))))
    return spread.withColumn(
        name, F.col("_band") * _COLUMN_BITS + F.pmod(F.col("_c"), F.col("_columns"))
    ).drop("_lon", "_spread", "_band", "_columns", "_c")


def degrees_for_m(metres: float, radius_m: float = MATCH_RADIUS_M) -> float:
    """Degrees of great circle spanned by a distance, padded so that rounding never loses a neighbour."""
    return math.degrees(metres / radius_m) * 1.000001


# --- affine maps ------------------------------------------------------------------------------------------------

def apply_affine(x: Column, y: Column, fit: Column) -> Column:
    """Pixel to degrees through a fitted map (struct a,b,c,d,e,f,lat0,lon0)."""
    return from_local_xy(
        fit["a"] * x + fit["b"] * y + fit["c"], fit["d"] * x + fit["e"] * y + fit["f"], fit["lat0"], fit["lon0"]
    )


def invert_affine(lat: Column, lon: Column, fit: Column) -> Column:
    """Degrees to pixel through the inverse of a fitted map."""
    u = local_x(lon, fit["lat0"], fit["lon0"]) - fit["c"]
    v = local_y(lat, fit["lat0"]) - fit["f"]
    det = fit["a"] * fit["e"] - fit["b"] * fit["d"]
    return F.struct(
        ((fit["e"] * u - fit["b"] * v) / det).alias("x"), ((fit["a"] * v - fit["d"] * u) / det).alias("y")
    )


def curve_place(lat: Column, lon: Column) -> Column:
    """Place of a point on a curve through 2^21 x 2^21 cells of the globe that keeps near points near: bits of both in turn."""
    def bits(value: Column, low: float, span: float) -> Column:
        step = F.floor((value - low) / span * (1 << 21))
        # Binary digits read to the base of four leave every second bit free.
        return F.conv(F.bin(F.greatest(F.lit(0), F.least(F.lit((1 << 21) - 1), step))), 4, 10).cast("long")

    place = bits(lat, -90.0, 180.0) * 2 + bits(lon, -180.0, 360.0)
    return F.when(lat.isNotNull() & lon.isNotNull(), place)
