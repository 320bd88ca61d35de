"""Whole jobs over work lists: index tiles, geocode by labels, reconstruct routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewright.functions import scores
from routewright.operators import catalogue as cat
from routewright.operators import crossref, georef, graph, labels, raster, similarity
from routewright.operators.lines import as_lines
from routewright.session import cut_lineage
from routewright.sinks import writers


def index_batch(
    tiles: DataFrame, hits: DataFrame | None, old: DataFrame, cities: DataFrame | None = None, non_places: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(next catalogue snapshot, one row of counts: rows, geocoded). Without ``hits`` nothing is geocoded."""
    parsed = cat.parse_titles(tiles, cities, non_places)
    if hits is None:
        geocoded = parsed.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})
    else:
        geocoded = cat.geocode_titles(parsed, hits)
    fresh = cut_lineage(cat.catalogue_rows(geocoded))  # read by the merge and by the counts
    counts = fresh.agg(F.count("*").alias("rows"), F.count("lat").alias("geocoded"))
    return cat.upsert_catalogue(fresh, old), counts


def label_geocode_outcomes(
    work: DataFrame, fragments: DataFrame, gazetteer: DataFrame, stamp: str, min_streets: int = 2,
    radius_km: float = 3.0, min_confidence: float = 0.20, failures: DataFrame | None = None, **limits,
) -> DataFrame:
    """One outcome row per work row: counts, cluster, confidence, street list and error.

    ``fragments`` carry image_id = catalogue id; ``failures`` (image_id, error) name images whose labels could not be read.
    ``limits`` are the lookup limits of :func:`crossref.find_geocodes`.
    """
    todo = work.select(F.col("id").alias("image_id"))
    merged = cut_lineage(labels.merge_labels(fragments.join(todo, "image_id", "left_semi")))
    candidates = cut_lineage(labels.street_candidates(merged, min_confidence))
    clusters, matches = crossref.find_geocodes(candidates, gazetteer, min_streets, radius_km, **limits)
    counts = merged.groupBy("image_id").agg(F.count("*").alias("fragments"))
    ranked = labels.rank_candidates(candidates)
    named = ranked.groupBy("image_id").agg(
        F.count("*").alias("candidates"),
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "normalized"))), lambda s: s["normalized"]))
        .alias("streets_json"),
    )
    matched = matches.groupBy("image_id").agg(F.count_distinct("street").alias("matched"))
    located = clusters.select(
        "image_id", F.col("lat").alias("cluster_lat"), F.col("lon").alias("cluster_lon"),
        F.col("streets").alias("cluster_streets"), "confidence", F.col("city").alias("cluster_city"),
        F.col("country").alias("cluster_country"),
    )
    rows = work.select("id", "title", "image_url")
    for part in (counts, named, matched, located):
        rows = rows.join(part.withColumnRenamed("image_id", "id"), "id", "left")
    if failures is None:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    else:
        rows = rows.join(failures.withColumnRenamed("image_id", "id"), "id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("fragments", "candidates", "matched")}
    return rows.withColumns({
        **zero, "confidence": F.coalesce("confidence", F.lit(0.0)),
        "streets_json": F.coalesce("streets_json", F.lit("[]")), "attempted_at": F.lit(stamp),
    })


def label_geocode_batch(
    catalogue: DataFrame, fragments: DataFrame, gazetteer: DataFrame, stamp: str,
    categories: Sequence[str] | None = None, retry_attempted: bool = False, limit: int | None = None, **options,
) -> tuple[DataFrame, DataFrame]:
    """(updated catalogue, outcomes). Every attempted row is marked, found or not."""
    work = cut_lineage(cat.needs_label_geocode(catalogue, categories, retry_attempted, limit))
    outcomes = cut_lineage(label_geocode_outcomes(work, fragments, gazetteer, stamp, **options))
    updates = outcomes.select(
        "id", F.col("cluster_lat").alias("lat"), F.col("cluster_lon").alias("lon"), "confidence", "streets_json",
        "attempted_at", F.col("cluster_city").alias("city"), F.col("cluster_country").alias("country"),
    )
    return cat.apply_label_geocode(catalogue, updates), outcomes


# Stages of a reconstruction in the order in which they can fail.
STAGES = ["fetch", "contour", "ocr", "crossref", "georef", "mapmatch", "confidence"]


def reconstruct_outcomes(
    work: DataFrame, pixels: DataFrame, fragments: DataFrame, gazetteer: DataFrame, nodes: DataFrame, edges: DataFrame,
    min_streets: int = 3, radius_km: float = 3.0, min_confidence: float = 0.6, step_m: float = 30.0,
    pad_m: float = 200.0, buffer_m: float = 25.0, min_area: int = 200, **limits,
) -> DataFrame:
    """One row per work row: confidence, failure, n_gcps, fidelity_score, length and GPX text when good enough.

    Each stage runs once over all images still alive; the first stage an image does not survive names its failure.
    ``pixels`` and ``fragments`` carry image_id = catalogue id; ``limits`` are the lookup limits of
    :func:`crossref.find_geocodes`.
    """
    todo = work.select(F.col("id").alias("image_id"))
    alive = pixels.select("image_id").distinct().join(todo, "image_id", "left_semi")
    fates = [todo.join(alive, "image_id", "left_anti").withColumn("failure", F.lit("fetch: no image"))]

    def survivors(current: DataFrame, passed: DataFrame, reason: str) -> DataFrame:
        fates.append(
            current.join(passed, "image_id", "left_anti").select("image_id", F.lit(reason).alias("failure"))
        )
        return current.join(passed, "image_id", "left_semi")

    contours = cut_lineage(raster.extract_route(pixels.join(todo, "image_id", "left_semi"), min_area))
    long_enough = contours.groupBy("image_id").agg(F.count("*").alias("n")).filter("n >= 10").select("image_id")
    alive = survivors(alive, long_enough, "contour: empty or too short")

    merged = cut_lineage(labels.merge_labels(fragments.join(alive, "image_id", "left_semi")))
    candidates = cut_lineage(labels.street_candidates(merged, 0.20))
    alive = survivors(alive, candidates.select("image_id").distinct(), "ocr: no street candidates")

    clusters, matches = crossref.find_geocodes(candidates, gazetteer, min_streets, radius_km, **limits)
    clusters, matches = cut_lineage(clusters), cut_lineage(matches)
    alive = survivors(alive, clusters.select("image_id"), "crossref: no consensus cluster")

    gcps = cut_lineage(georef.control_points(labels.pixel_anchors(merged, candidates), matches, clusters))
    fits, rejects = georef.fit_affine(gcps)
    fits = cut_lineage(fits)
    no_points = alive.join(gcps, "image_id", "left_anti").select(
        "image_id", F.lit("georef: only 0 control points").alias("failure")
    )
    fates.append(rejects.join(alive, "image_id", "left_semi").unionByName(no_points))
    alive = alive.join(fits, "image_id", "left_semi")

    lines = cut_lineage(
        georef.project_pixels(contours.join(alive, "image_id", "left_semi"), fits)
        .select("image_id", "seq", "lat", "lon")
    )
    _, matched = graph.map_match(lines, nodes, edges, "image_id", step_m, pad_m)
    matched = cut_lineage(matched)
    alive = survivors(alive, matched.select("image_id").distinct(), "mapmatch: empty result")

    traced = matched.select("image_id", "seq", "lat", "lon")
    scored = similarity.fidelity(
        traced, lines.join(alive, "image_id", "left_semi"), "image_id", buffer_m
    ).select("image_id", F.col("score").alias("fidelity_score"))
    judged = cut_lineage(
        alive.join(fits.select("image_id", "n_anchors", "rmse_m"), "image_id")
        .join(georef.mean_label_conf(gcps).select("image_id", "mean_label_conf"), "image_id").join(scored, "image_id")
        .withColumn("confidence", scores.reconstruction_confidence(
            F.col("n_anchors"), F.col("rmse_m"), F.col("mean_label_conf"), F.col("fidelity_score")
        ))
    )
    weak = F.concat(
        F.lit("confidence: "), F.format_string("%.2f", F.col("confidence")), F.lit(f" < {min_confidence:.2f}")
    )
    fates.append(judged.filter(F.col("confidence") < min_confidence).select("image_id", weak.alias("failure")))

    failed = fates[0]
    for fate in fates[1:]:
        failed = failed.unionByName(fate)
    documents = as_lines(traced, ["image_id"]).join(
        judged.filter(F.col("confidence") >= min_confidence).select("image_id"), "image_id", "left_semi"
    )
    n_gcps = gcps.groupBy("image_id").agg(F.count("*").alias("n_gcps"))
    rows = work.select(F.col("id").alias("image_id"), "title", "category", "image_url")
    for part in (failed, n_gcps, judged.select("image_id", "confidence", "fidelity_score"), documents):
        rows = rows.join(part, "image_id", "left")
    about = F.concat(F.lit("reconstruction (route "), F.col("image_id").cast("string"), F.lit(")"))
    gpx = writers.gpx_route(F.col("line"), F.col("title"), about, F.lit(writers.CREATOR), F.array("category"))
    return rows.select(
        F.col("image_id").alias("id"), "title", "image_url", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "failure", F.coalesce("n_gcps", F.lit(0)).alias("n_gcps"), "fidelity_score",
        F.when(F.col("line").isNotNull(), gpx).alias("gpx_xml"),
    )


def reconstruct_batch(
    catalogue: DataFrame, pixels: DataFrame, fragments: DataFrame, gazetteer: DataFrame, nodes: DataFrame,
    edges: DataFrame, stamp: str, folder: str | None = None, categories: Sequence[str] | None = None,
    retry_attempted: bool = False, limit: int | None = None, min_confidence: float = 0.6, **options,
) -> tuple[DataFrame, DataFrame]:
    """(updated catalogue, outcomes with gpx_path). Files are written under ``folder`` where one is given."""
    work = cut_lineage(cat.needs_reconstruction(catalogue, categories, retry_attempted, limit))
    outcomes = cut_lineage(reconstruct_outcomes(
        work, pixels, fragments, gazetteer, nodes, edges, min_confidence=min_confidence, **options
    ))
    if folder is None:
        shipped = writers.shippable(outcomes, min_confidence).select("id", "gpx_path")
    else:
        shipped = writers.write_route_files(outcomes, folder, min_confidence)
    outcomes = outcomes.join(shipped, "id", "left").withColumn("attempted_at", F.lit(stamp))
    return cat.apply_reconstruction(catalogue, outcomes), outcomes


def batch_funnel(outcomes: DataFrame) -> DataFrame:
    """Outcomes lost at each stage, in stage order; ``shipped`` is what is left."""
    from routewright.functions.text import failure_mode

    stage = F.when(F.col("failure").isNull(), F.lit("shipped")).otherwise(failure_mode(F.col("failure")))
    order = F.array_position(F.array(*[F.lit(s) for s in [*STAGES, "shipped"]]), F.col("stage"))
    return outcomes.groupBy(stage.alias("stage")).agg(F.count("*").alias("n")).withColumn(
        "stage_no", order
    ).orderBy("stage_no", "stage")
