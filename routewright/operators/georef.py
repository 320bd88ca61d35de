"""Ground control points and pixel-to-map affine fits, one fit per image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routewright.functions import geo
from routewright.session import as_large, cut_lineage, spread

# Consensus distance, number of trials, and anchors needed.
CONSENSUS_M = 50.0
TRIALS = 200
MIN_ANCHORS = 3
_MAP = ["a", "b", "c", "d", "e", "f"]
_FIT = [*_MAP, "lat0", "lon0"]


def control_points(anchors: DataFrame, matches: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pixel anchor plus the hit of its street that lies in the cluster's box, nearest to the cluster's centre."""
    box = clusters.select(
        "image_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), "min_lat", "max_lat", "min_lon", "max_lon"
    )
    inside = matches.join(as_large(box), "image_id").filter(
        F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon"))
    )
    d_lat, d_lon = F.col("lat") - F.col("c_lat"), F.col("lon") - F.col("c_lon")
    chosen = inside.groupBy("image_id", "street").agg(
        F.min_by(F.struct("lat", "lon"), F.struct(F.round(d_lat * d_lat + d_lon * d_lon, 12), "hit_no")).alias("_p")
    )
    pixels = anchors.select("image_id", F.col("normalized").alias("street"), "x_px", "y_px", "confidence")
    return pixels.join(as_large(chosen), ["image_id", "street"]).select(
        "image_id", "x_px", "y_px", "_p.lat", "_p.lon", F.col("street").alias("label"),
        F.col("confidence").alias("weight"),
    )


def mean_label_conf(gcps: DataFrame) -> DataFrame:
    """Mean confidence over all control points of an image, also those a fit drops."""
    return gcps.groupBy("image_id").agg(F.avg("weight").alias("mean_label_conf"), F.count("*").alias("n_gcps"))


def _solve(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least-squares affine per key in closed form from centred moments; no row where the pixels are collinear."""
    moments = points.groupBy(*keys).agg(
        F.avg("x_px").alias("mx"), F.avg("y_px").alias("my"), F.avg("u").alias("mu"), F.avg("v").alias("mv"),
        F.var_pop("x_px").alias("xx"), F.var_pop("y_px").alias("yy"), F.covar_pop("x_px", "y_px").alias("xy"),
        F.covar_pop("x_px", "u").alias("xu"), F.covar_pop("y_px", "u").alias("yu"),
        F.covar_pop("x_px", "v").alias("xv"), F.covar_pop("y_px", "v").alias("yv"), F.count("*").alias("n"),
    )
    m = F.col
    det = m("xx") * m("yy") - m("xy") * m("xy")
    usable = (m("n") >= 3) & (det > m("xx") * m("yy") * 1e-9) & (det > 0)
    a = (m("xu") * m("yy") - m("yu") * m("xy")) / det
    b = (m("yu") * m("xx") - m("xu") * m("xy")) / det
    d = (m("xv") * m("yy") - m("yv") * m("xy")) / det
    e = (m("yv") * m("xx") - m("xv") * m("xy")) / det
    return (
        moments.filter(usable).withColumns({"a": a, "b": b, "d": d, "e": e})
        .withColumn("c", m("mu") - m("a") * m("mx") - m("b") * m("my"))
        .withColumn("f", m("mv") - m("d") * m("mx") - m("e") * m("my"))
        .select(*keys, "a", "b", "c", "d", "e", "f")
    )


def _residual() -> Column:
    return F.hypot(
        F.col("a") * F.col("x_px") + F.col("b") * F.col("y_px") + F.col("c") - F.col("u"),
        F.col("d") * F.col("x_px") + F.col("e") * F.col("y_px") + F.col("f") - F.col("v"),
    )


def _pairs_below(c: Column) -> Column:
    return (c * (c - 1) / 2).cast("long")


def _triples_below(c: Column) -> Column:
    return (c * (c - 1) * (c - 2) / 6).cast("long")


def _with_largest(df: DataFrame, name: str, guess: Column, value: str, size) -> DataFrame:
    """``name`` = the largest whole number whose ``size`` is at most ``value``; the guess may be one too high or two too low."""
    df = df.withColumn("_g", guess.cast("long"))
    fits = [F.when(size(F.col("_g") + step) <= F.col(value), F.col("_g") + step) for step in (-1, 0, 1, 2)]
    return df.withColumn(name, F.greatest(*fits)).drop("_g")


def _trials(frame: DataFrame, trials: int) -> DataFrame:
    """``image_id, trial, idx``: members of ``trials`` different triples of 1..n_all, or of all where there are fewer.

    The triples are numbered, their numbers cut into as many equal stretches as there are trials, and a hash picks one
    of each stretch. A number is turned into its triple step by step, each step a column that is computed once.
    """
    rows = frame.select("image_id", _triples_below(F.col("n_all").cast("long")).alias("total"))
    rows = rows.withColumn("count", F.least("total", F.lit(trials).cast("long")))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    rows = rows.withColumns({"low": F.expr("k * total div count"), "high": F.expr("(k + 1) * total div count")})
    rows = rows.withColumn("number", F.col("low") + F.pmod(F.xxhash64("image_id", "k"), F.col("high") - F.col("low")))
    rows = _with_largest(rows, "third", F.floor(F.cbrt(6 * F.col("number"))), "number", _triples_below)
    rows = rows.withColumn("rest", F.col("number") - _triples_below(F.col("third")))
    rows = _with_largest(rows, "second", F.floor((1 + F.sqrt(1 + 8 * F.col("rest"))) / 2), "rest", _pairs_below)
    rows = rows.withColumn("first", F.col("rest") - _pairs_below(F.col("second")))
    members = F.explode(F.array("first", "second", "third"))
    return rows.select("image_id", F.col("k").cast("int").alias("trial"), members.alias("_i")).select(
        "image_id", "trial", (F.col("_i") + 1).cast("int").alias("idx"))


def fit_affine(gcps: DataFrame, drop_outliers: bool = True, trials: int = TRIALS) -> tuple[DataFrame, DataFrame]:
    """(fits, rejects). One affine map per image with at least three anchors.

    The local frame is centred on all given anchors. With more than three, the triple whose map agrees with most anchors
    (within 50 m) decides which anchors the final least-squares fit uses; ties go to the smaller squared residual, then
    to the first labels. ``trials`` triples spread over all of them are tried, or every one where there are fewer.
    """
    # Every step below is written: a task then holds the rows of one join, not those of all steps that share a key.
    frame = cut_lineage(gcps.groupBy("image_id").agg(
        F.count("*").alias("n_all"), F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0")
    ))
    few = frame.filter(F.col("n_all") < MIN_ANCHORS).select(
        "image_id", F.concat(F.lit("georef: only "), F.col("n_all").cast("string"), F.lit(" control points"))
        .alias("failure"),
    )
    label = ["label"] if drop_outliers else []
    points = gcps.select("image_id", "x_px", "y_px", "lat", "lon", *label).join(
        frame.filter(F.col("n_all") >= MIN_ANCHORS), "image_id"
    ).withColumns({
        "u": geo.local_x(F.col("lon"), F.col("lat0"), F.col("lon0")), "v": geo.local_y(F.col("lat"), F.col("lat0")),
    }).drop("lat", "lon")
    if drop_outliers:
        order = Window.partitionBy("image_id").orderBy("label", "x_px", "y_px")
        points = cut_lineage(points.withColumn("idx", F.row_number().over(order)))
        many = points.filter(F.col("n_all") > MIN_ANCHORS)
        triples = _trials(spread(frame.filter(F.col("n_all") > MIN_ANCHORS), "image_id"), trials)
        models = cut_lineage(_solve(
            triples.join(many, ["image_id", "idx"]).select("image_id", "trial", "x_px", "y_px", "u", "v"),
            ["image_id", "trial"],
        ))
        votes = many.join(models, "image_id").withColumn("r", _residual()).groupBy("image_id", "trial", *_MAP).agg(
            F.count_if(F.col("r") < CONSENSUS_M).alias("inliers"), F.sum(F.col("r") * F.col("r")).alias("sq")
        )
        chosen = cut_lineage(votes.filter(F.col("inliers") >= MIN_ANCHORS).groupBy("image_id").agg(F.min_by(
            F.struct(*_MAP), F.struct(-F.col("inliers"), F.round("sq", 6), "trial")
        ).alias("_m")).select("image_id", "_m.*"))
        points = points.join(chosen, "image_id", "left").withColumn(
            "inlier", F.coalesce(_residual() < CONSENSUS_M, F.lit(True))
        ).drop("n_all", "idx", *_MAP)
    else:
        points = points.withColumn("inlier", F.lit(True)).withColumn("label", F.lit(None).cast("string"))
    points = cut_lineage(points)
    solved = cut_lineage(_solve(
        points.filter("inlier").select("image_id", "lat0", "lon0", "x_px", "y_px", "u", "v"), ["image_id", "lat0", "lon0"]
    ))
    r = F.when(F.col("inlier"), _residual())
    fits = points.drop("lat0", "lon0").join(solved, "image_id").groupBy("image_id", *_FIT).agg(
        F.count_if("inlier").alias("n_anchors"), F.sqrt(F.avg(r * r)).alias("rmse_m"), F.max(r).alias("max_residual_m"),
        F.sort_array(F.collect_list(F.when(~F.col("inlier"), F.col("label")))).alias("dropped_labels"),
    )
    flat = frame.filter(F.col("n_all") >= MIN_ANCHORS).join(solved, "image_id", "left_anti").select(
        "image_id", F.lit("georef: control points are collinear").alias("failure")
    )
    return fits, few.unionByName(flat)


def project_pixels(pixels: DataFrame, fits: DataFrame) -> DataFrame:
    """Geographic position of pixel lines (image_id, seq, x, y)."""
    fit = F.struct(*_FIT)
    joined = pixels.join(as_large(fits.select("image_id", fit.alias("_fit"))), "image_id")
    return joined.withColumn("_g", geo.apply_affine(F.col("x"), F.col("y"), F.col("_fit"))).select(
        *pixels.columns, "_g.lat", "_g.lon"
    )


def locate_pixels(points: DataFrame, fits: DataFrame) -> DataFrame:
    """Pixel position of geographic points (image_id, lat, lon)."""
    joined = points.join(as_large(fits.select("image_id", F.struct(*_FIT).alias("_fit"))), "image_id")
    return joined.withColumn("_p", geo.invert_affine(F.col("lat"), F.col("lon"), F.col("_fit"))).select(
        *points.columns, F.col("_p.x").alias("x_px"), F.col("_p.y").alias("y_px")
    )
