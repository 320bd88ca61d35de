"""Catalogue table operators: build rows, merge by key, apply enrichment outcomes, pick work, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routewright import dims, schemas
from routewright.functions import text
from routewright.operators import titles
from routewright.operators.scans import number_rows
from routewright.session import cut_lineage

KEY = "image_url"
KEPT_ON_UPDATE = [
    "id", "gpx_path", "reconstruction_confidence", "reconstruction_attempted_at", "reconstruction_failure"
]
LABEL_COLUMNS = ["geocode_source", "ocr_streets", "ocr_attempted_at"]


# --- building rows ----------------------------------------------------------------------------------------------

def parse_titles(tiles: DataFrame, cities: DataFrame | None = None, non_places: DataFrame | None = None) -> DataFrame:
    """Add shape, city, country and confidence read from the title.

    With rows of ``cities`` (name, country) or ``non_places`` (word) the names are looked up by joins; else, and for the
    one that is not given, the built-in lists hold.
    """
    if cities is not None or non_places is not None:
        return titles.parse_titles_by_rows(tiles, cities, non_places)
    return tiles.withColumn("_t", text.parse_title(F.col("title"))).select("*", "_t.*").drop("_t")


def geocode_titles(parsed: DataFrame, hits: DataFrame) -> DataFrame:
    """Coordinates by place key; a named city that is not found lowers the confidence to 0.25 at most."""
    found = hits.select(
        F.col("key").alias("_key"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"),
        F.col("country").alias("_country"),
    )
    keyed = parsed.withColumn("_key", text.geocode_key(F.col("city"), F.col("country")))
    joined = keyed.join(found, "_key", "left")
    missed = F.col("_key").isNotNull() & F.col("_lat").isNull()
    return joined.select(
        *[c for c in parsed.columns if c not in ("country", "confidence")],
        F.coalesce("country", "_country").alias("country"),
        F.when(missed, F.least("confidence", F.lit(0.25))).otherwise(F.col("confidence")).alias("confidence"),
        F.col("_lat").alias("lat"), F.col("_lon").alias("lon"),
    )


def unresolved_places(parsed: DataFrame, hits: DataFrame, negatives: DataFrame) -> DataFrame:
    """Place keys still to be looked up: distinct, in neither cache table."""
    # The null test is on an aggregate: on the key itself it would move below the parse and repeat it.
    keys = parsed.select(text.geocode_key(F.col("city"), F.col("country")).alias("_key")).groupBy("_key").agg(
        F.first("_key").alias("key")).filter("key IS NOT NULL").select("key")
    return keys.join(hits.select("key"), "key", "left_anti").join(negatives.select("key"), "key", "left_anti")


def catalogue_rows(geocoded: DataFrame) -> DataFrame:
    """Catalogue columns of freshly indexed tiles (``position`` = input order is kept)."""
    return geocoded.select(
        "position", "title", "category", F.nullif(F.col("shape"), F.lit("")).alias("subcategory"), "city", "country",
        "lat", "lon", F.col("confidence").alias("geocode_confidence"), F.lit("title").alias("geocode_source"),
        F.lit(None).cast("string").alias("ocr_streets"), F.lit(None).cast("string").alias("ocr_attempted_at"),
        "image_url", "page_url", F.lit(None).cast("double").alias("distance_estimate_km"), "scraped_at",
    )


def index_tiles(prepared: DataFrame) -> DataFrame:
    """Catalogue columns of prepared tiles: values given with a tile override what its title says."""
    parsed = parse_titles(prepared.withColumnsRenamed({c: f"given_{c}" for c in ("city", "country")}))
    resolved = parsed.withColumns({
        "city": F.coalesce(F.nullif(F.col("given_city"), F.lit("")), F.col("city")),
        "country": F.coalesce(F.nullif(F.col("given_country"), F.lit("")), F.col("country")),
        "confidence": F.coalesce("geocode_confidence", "confidence"),
    })
    return catalogue_rows(resolved)


# --- merge by key -----------------------------------------------------------------------------------------------

def dedupe_by_key(rows: DataFrame, key: str = KEY, position: str = "position") -> DataFrame:
    """Last row of each key in input order. One aggregation with map-side combine: a hot key shuffles few rows."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), position).alias("_row"))
    return last.select("_row.*")


def upsert_catalogue(new: DataFrame, old: DataFrame, preserve_labels: bool = False) -> DataFrame:
    """Next snapshot: new rows overwrite by image_url but keep the id and the reconstruction columns.

    Unseen keys get ids after the highest known one, in order of first appearance. ``preserve_labels`` keeps
    label-derived columns and coordinates where the new row has none.
    """
    content = [c for c in schemas.CATALOGUE_COLUMNS if c not in KEPT_ON_UPDATE]
    latest = new.groupBy(KEY).agg(
        F.max_by(F.struct(*[F.col(c) for c in content if c != KEY]), "position").alias("_row"),
        F.min("position").alias("_first"),
    ).select(KEY, "_row.*", "_first")
    kept = old.select(*[F.col(c).alias(f"_old_{c}") for c in old.columns])
    merged = latest.join(kept, F.col(KEY) == F.col(f"_old_{KEY}"), "full_outer")
    is_new_row = F.col("_first").isNotNull()

    def pick(name: str) -> Column:
        value = F.when(is_new_row, F.col(name)).otherwise(F.col(f"_old_{name}"))
        labelled = (F.col("_old_geocode_source") == "ocr") & F.col("lat").isNull()
        if preserve_labels and name in (*LABEL_COLUMNS, "lat", "lon", "geocode_confidence"):
            value = F.when(labelled, F.col(f"_old_{name}")).otherwise(value)
        return value.alias(name)

    picked = merged.select(
        F.col("_old_id").alias("id"), "_first", *[pick(c) for c in content],
        *[F.col(f"_old_{c}").alias(c) for c in KEPT_ON_UPDATE if c != "id"],
    )
    picked = cut_lineage(picked)  # the one join; what follows reads its columns
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    known = picked.filter("id IS NOT NULL").drop("_first")
    fresh = number_rows(picked.filter("id IS NULL").drop("id"), "_first", "id", top).drop("_first")
    order = schemas.CATALOGUE_COLUMNS
    return known.select(*order).unionByName(fresh.select(*order))


def evolve_schema(rows: DataFrame) -> DataFrame:
    """Add the columns older tables lack, with their defaults; existing columns stay as they are."""
    missing = {
        name: F.lit(default).cast(kind) for name, kind, default in schemas.ADDITIVE_COLUMNS if name not in rows.columns
    }
    return rows.withColumns(missing) if missing else rows


def apply_label_geocode(catalogue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Write label-geocode outcomes (id, lat, lon, confidence, streets_json, attempted_at, city, country)."""
    new = outcomes.select(F.col("id"), F.struct(*[c for c in outcomes.columns if c != "id"]).alias("_o"))
    joined = catalogue.join(new, "id", "left")
    hit = F.col("_o").isNotNull()
    source = F.when(F.col("_o.lat").isNotNull(), "ocr").otherwise("ocr-failed")
    values = {
        "lat": F.col("_o.lat"), "lon": F.col("_o.lon"), "geocode_confidence": F.col("_o.confidence"),
        "geocode_source": source, "ocr_streets": F.col("_o.streets_json"),
        "ocr_attempted_at": F.col("_o.attempted_at"),
        "city": F.coalesce("_o.city", "city"), "country": F.coalesce("_o.country", "country"),
    }
    return joined.select(*[
        F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in catalogue.columns
    ])


def apply_reconstruction(catalogue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Write reconstruction outcomes (id, gpx_path, confidence, attempted_at, failure)."""
    new = outcomes.select("id", F.struct("gpx_path", "confidence", "attempted_at", "failure").alias("_o"))
    hit = F.col("_o").isNotNull()
    values = {
        "gpx_path": "_o.gpx_path", "reconstruction_confidence": "_o.confidence",
        "reconstruction_attempted_at": "_o.attempted_at", "reconstruction_failure": "_o.failure",
    }
    return catalogue.join(new, "id", "left").select(*[
        F.when(hit, F.col(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in catalogue.columns
    ])


# --- small tables -----------------------------------------------------------------------------------------------

def replace_synonyms(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new (term, slug) rows take the place of all old ones; a repeated term keeps its last slug."""
    return dedupe_by_key(new, "term", "position").select("term", "slug") if "position" in new.columns else new


def set_meta(meta: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert (key, value) rows; ``new`` has a position and its last value per key wins."""
    latest = dedupe_by_key(new, "key", "position").select("key", "value")
    return meta.join(latest, "key", "left_anti").select("key", "value").unionByName(latest)


def get_meta(meta: DataFrame, key: str) -> DataFrame:
    return meta.filter(F.col("key") == key).select("value")


def merge_hit_caches(old_hits, new_hits, old_negatives, new_negatives) -> tuple[DataFrame, DataFrame]:
    """Cached and new lookups joined; a new hit replaces a cached one, and no key is both hit and negative."""
    hits = old_hits.join(new_hits.select("key").distinct(), "key", "left_anti").unionByName(new_hits)
    negatives = old_negatives.select("key").union(new_negatives.select("key")).distinct()
    return hits, negatives.join(hits.select("key"), "key", "left_anti")


def resolve_category(rows: DataFrame, term: str, synonyms: DataFrame, name: str = "resolved") -> DataFrame:
    """Category of a term: synonym table first (lower-cased, not trimmed), then slugs, then built-in terms."""
    table = synonyms.select(F.col("term").alias("_term"), F.col("slug").alias("_slug"))
    joined = rows.withColumn("_term", F.lower(F.col(term))).join(table, "_term", "left")
    known = F.coalesce(F.nullif(F.col("_slug"), F.lit("")), text.built_in_category(F.col(term)))
    return joined.withColumn(name, F.when(F.col(term) != "", known)).drop("_term", "_slug")


# --- work lists and samples -------------------------------------------------------------------------------------

def _work(rows: DataFrame, attempted: str, retry: bool, categories: Sequence[str] | None, limit: int | None):
    if not retry:
        rows = rows.filter(F.col(attempted).isNull())
    if categories:
        rows = rows.filter(F.col("category").isin(list(categories)))
    rows = rows.orderBy("id")
    return rows if limit is None else rows.limit(limit)


def needs_label_geocode(catalogue, categories=None, retry_attempted=False, limit=None) -> DataFrame:
    """Rows without coordinates whose labels were not tried yet."""
    return _work(catalogue.filter("lat IS NULL"), "ocr_attempted_at", retry_attempted, categories, limit)


def needs_reconstruction(catalogue, categories=None, retry_attempted=False, limit=None) -> DataFrame:
    """Rows with coordinates whose reconstruction was not tried yet."""
    return _work(
        catalogue.filter("lat IS NOT NULL"), "reconstruction_attempted_at", retry_attempted, categories, limit
    )


def qa_sample(catalogue: DataFrame, n: int = 50, min_confidence: float = 0.55, seed: int = 7) -> DataFrame:
    """``n`` label-geocoded rows for review, in a repeatable random order."""
    return (
        catalogue.filter((F.col("geocode_source") == "ocr") & (F.col("geocode_confidence") > min_confidence))
        .orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("id"))), "id").limit(n)
    )


def all_routes(catalogue: DataFrame) -> DataFrame:
    return catalogue.orderBy("id")


def shape_metadata(outlines: DataFrame) -> DataFrame:
    """Known shapes with display name, emoji and features, by id."""
    names = outlines.sparkSession.createDataFrame(
        dims.SHAPE_METADATA, "id string, name string, emoji string, distinctive_features string"
    )
    return names.join(outlines.select(F.col("shape").alias("id")).distinct(), "id", "left_semi").orderBy("id")


# --- reports ----------------------------------------------------------------------------------------------------

def catalogue_stats(catalogue: DataFrame) -> DataFrame:
    """Rows and geocoded rows, in total (category NULL) and per category, largest first."""
    return (
        catalogue.rollup("category")
        .agg(F.count("*").alias("total"), F.count("lat").alias("geocoded"), F.grouping("category").alias("is_total"))
        .orderBy(F.desc("is_total"), F.desc("total"), "category")
    )


def count_by_source(catalogue: DataFrame) -> DataFrame:
    return catalogue.filter("lat IS NOT NULL").groupBy("geocode_source").agg(F.count("*").alias("n"))


def reconstruction_counts(catalogue: DataFrame) -> DataFrame:
    return catalogue.agg(
        F.count("reconstruction_attempted_at").alias("attempted"), F.count("gpx_path").alias("shipped")
    )


def label_geocode_summary(outcomes: DataFrame) -> DataFrame:
    """attempted, geocoded, success_rate, errors, no_streets, no_cluster over (candidates, cluster_lat, error)."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    quiet = F.col("error").isNull()
    lost = F.col("cluster_lat").isNull()
    totals = outcomes.agg(
        F.count("*").alias("attempted"), F.count("cluster_lat").alias("geocoded"),
        F.count_if(failed).alias("errors"),
        F.count_if((F.col("candidates") == 0) & quiet).alias("no_streets"),
        F.count_if((F.col("candidates") > 0) & lost & quiet).alias("no_cluster"),
    )
    rate = F.when(F.col("attempted") > 0, F.round(F.col("geocoded") / F.col("attempted"), 3)).otherwise(0.0)
    return totals.select("attempted", "geocoded", rate.alias("success_rate"), "errors", "no_streets", "no_cluster")


def reconstruction_summary(outcomes: DataFrame) -> DataFrame:
    """attempted, shipped, ship_rate, failure_modes (array of mode, n; most frequent first), mean_confidence."""
    mode = F.when(F.col("gpx_path").isNull(), text.failure_mode(F.col("failure")))
    per_mode = outcomes.groupBy(mode.alias("mode")).agg(
        F.count("*").alias("n"), F.count("gpx_path").alias("shipped"), F.sum("confidence").alias("conf")
    )
    ranked = F.array_sort(F.collect_list(F.when(
        F.col("mode").isNotNull(), F.struct((-F.col("n")).alias("neg"), F.col("mode"))
    )))
    totals = per_mode.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("attempted"), F.coalesce(F.sum("shipped"), F.lit(0)).alias("shipped"),
        F.sum("conf").alias("conf"), ranked.alias("ranked"),
    )
    some = F.col("attempted") > 0
    return totals.select(
        "attempted", "shipped",
        F.when(some, F.round(F.col("shipped") / F.col("attempted"), 3)).alias("ship_rate"),
        F.when(some, F.transform("ranked", lambda r: F.struct(r["mode"].alias("mode"), (-r["neg"]).alias("n"))))
        .alias("failure_modes"),
        F.when(some, F.round(F.col("conf") / F.col("attempted"), 3)).alias("mean_confidence"),
    )
