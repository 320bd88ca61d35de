"""Catalogue maintenance, lookups, search and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from routewright import schemas
from routewright.operators import catalogue as cat
from routewright.operators import search
from routewright.plans import jobs
from workload.fixtures import STAMP, derive, table
from workload.registry import query, r6, s6, s_hav
from workload.text_queries import _SYNONYMS, s_map, s_parse_title

# --- search -----------------------------------------------------------------------------------------------------

_DIST = s_hav("q.lat", "q.lon", "r.lat", "r.lon", "6371.0088")
_RESOLVED = f"SELECT *, {s_map(_SYNONYMS, 'lower(trim(term))')} AS wanted FROM [spots]"
_BOX = ("r.lat BETWEEN q.lat - q.radius_km / 111.0 AND q.lat + q.radius_km / 111.0 AND r.lon BETWEEN "
        "q.lon - q.radius_km / (111.0 * greatest(0.01, cos(radians(q.lat)))) AND "
        "q.lon + q.radius_km / (111.0 * greatest(0.01, cos(radians(q.lat)))) AND")


def _search_sql(box: str, limit: int) -> str:
    return f"""
        SELECT query_id, id, {s6('dist', 'distance_km')}, rank FROM (
          SELECT query_id, id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM (
            SELECT q.query_id, r.id, q.radius_km, {_DIST} AS dist FROM ({_RESOLVED}) AS q JOIN [catalogue] AS r
            ON {box} (q.wanted IS NULL OR r.category = q.wanted)) AS c WHERE dist <= radius_km) AS k WHERE rank <= {limit}"""


def _searched(spark, d, limit, exact):
    spots = cat.resolve_category(
        derive(spark, d, "spots"), "term", spark.createDataFrame([], "term string, slug string"), "category"
    )
    hits = search.radius_search(spots, derive(spark, d, "catalogue"), limit, exact)
    return hits.select("query_id", "id", r6("distance_km"), F.col("rank").cast("long").alias("rank"))


@query(_search_sql(_BOX, 20))
def radius_search(spark, d):
    return _searched(spark, d, 20, False)


@query(_search_sql("", 50))
def radius_search_exact(spark, d):
    return _searched(spark, d, 50, True)


@query(f"""SELECT id, {s6('dist', 'distance_km')} FROM (
             SELECT r.id, {_DIST} AS dist FROM [catalogue] AS r CROSS JOIN (SELECT 52.0 AS lat, 0.1 AS lon, 60.0 AS radius_km) AS q
             WHERE {_BOX} r.category = 'shapes') AS c WHERE dist <= 60 ORDER BY dist, id LIMIT 50""")
def search_near(spark, d):
    return search.search_near(derive(spark, d, "catalogue"), 52.0, 0.1, 60.0, "shapes", 50).select("id", r6("distance_km"))


# --- lookups ----------------------------------------------------------------------------------------------------

_PARSED = s_parse_title("SELECT position, title FROM [titles]", "position")
_KEY = "lower(p.city || CASE WHEN p.country IS NULL THEN '' ELSE ', ' || p.country END)"
_GEOCODED = f"""
    SELECT p.position, p.shape, p.city, coalesce(p.country, h.country) AS country,
      CASE WHEN p.city IS NOT NULL AND h.key IS NULL THEN least(p.confidence, 0.25) ELSE p.confidence END AS confidence, h.lat, h.lon
    FROM ({_PARSED}) AS p LEFT JOIN [place_hits] AS h ON h.key = {_KEY}"""


@query(f"SELECT position, city, country, confidence, {s6('lat', 'lat')}, {s6('lon', 'lon')} FROM ({_GEOCODED}) AS g")
def geocode_titles(spark, d):
    found = cat.geocode_titles(cat.parse_titles(derive(spark, d, "titles")), derive(spark, d, "place_hits"))
    return found.select("position", "city", "country", "confidence", r6("lat"), r6("lon"))


@query(f"""SELECT DISTINCT {_KEY} AS key FROM ({_PARSED}) AS p WHERE p.city IS NOT NULL
           AND {_KEY} NOT IN (SELECT key FROM [place_hits]) AND {_KEY} NOT IN (SELECT 'brand ' || CAST(p_size AS STRING) FROM {{part}} WHERE p_size < 5)""")
def unresolved_places(spark, d):
    negatives = derive(spark, d, "SELECT DISTINCT 'brand ' || CAST(p_size AS STRING) AS key FROM {part} WHERE p_size < 5")
    return cat.unresolved_places(cat.parse_titles(derive(spark, d, "titles")), derive(spark, d, "place_hits"), negatives)


@query("""SELECT 'hit' AS kind, key FROM (SELECT key FROM [place_hits] UNION SELECT 'place ' || CAST(p_size AS STRING) FROM {part}) AS h
          UNION ALL SELECT 'negative', key FROM (
            SELECT 'place ' || CAST(p_size + 20 AS STRING) AS key FROM {part} UNION SELECT lower(p_brand) FROM {part}) AS n
          WHERE key NOT IN (SELECT key FROM [place_hits] UNION SELECT 'place ' || CAST(p_size AS STRING) FROM {part})""")
def merge_hit_caches(spark, d):
    new = derive(spark, d, """SELECT 'place ' || CAST(p_size AS STRING) AS key, CAST(min(p_partkey) AS DOUBLE) AS lat, 0D AS lon,
                              'Land' AS country FROM {part} GROUP BY p_size""")
    hits, negatives = cat.merge_hit_caches(
        derive(spark, d, "place_hits"), new,
        derive(spark, d, "SELECT DISTINCT 'place ' || CAST(p_size + 20 AS STRING) AS key FROM {part}"),
        derive(spark, d, "SELECT DISTINCT lower(p_brand) AS key FROM {part}"),
    )
    return hits.select(F.lit("hit").alias("kind"), "key").unionByName(negatives.select(F.lit("negative").alias("kind"), "key"))


# --- rows and merges --------------------------------------------------------------------------------------------

_CHANGES = f"""
    SELECT o_orderkey AS position, o_orderpriority AS title, lower(o_orderstatus) AS category, o_orderpriority AS subcategory,
           CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Town' END AS city, 'Land' AS country,
           CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 1 + CAST(o_orderkey % 50 AS DOUBLE) END AS lat,
           CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 2 + CAST(o_orderkey % 60 AS DOUBLE) END AS lon,
           0.5 AS geocode_confidence, 'title' AS geocode_source, CAST(NULL AS STRING) AS ocr_streets,
           CAST(NULL AS STRING) AS ocr_attempted_at,
           'https://img.example.org/' || CAST(o_custkey * 2 AS STRING) AS image_url, 'https://site.example.org/new' AS page_url,
           CAST(NULL AS DOUBLE) AS distance_estimate_km, CAST(o_orderkey AS STRING) AS scraped_at
    FROM {{orders}}"""


def _changes(spark, d):
    return derive(spark, d, _CHANGES).withColumn("geocode_confidence", F.col("geocode_confidence").cast("double"))


@query(f"""SELECT image_url, position, title, category, city FROM (
             SELECT *, row_number() OVER (PARTITION BY image_url ORDER BY position DESC) AS n FROM ({_CHANGES}) AS c) AS r WHERE n = 1""")
def dedupe_by_key(spark, d):
    return cat.dedupe_by_key(_changes(spark, d)).select("image_url", "position", "title", "category", "city")


_CONTENT = [c for c in schemas.CATALOGUE_COLUMNS if c not in (*cat.KEPT_ON_UPDATE, "image_url")]


@query(f"""
    WITH chg AS (SELECT *, row_number() OVER (PARTITION BY image_url ORDER BY position DESC) AS n,
                   min(position) OVER (PARTITION BY image_url) AS first FROM ({_CHANGES}) AS c),
         last AS (SELECT * FROM chg WHERE n = 1),
         fresh AS (SELECT image_url, (SELECT max(id) FROM [catalogue]) + row_number() OVER (ORDER BY first) AS id
                   FROM last WHERE image_url NOT IN (SELECT image_url FROM [catalogue]))
    SELECT coalesce(o.id, f.id) AS id, coalesce(l.image_url, o.image_url) AS image_url,
      {', '.join(f'CASE WHEN l.image_url IS NOT NULL THEN l.{c} ELSE o.{c} END AS {c}' for c in _CONTENT)},
      o.gpx_path, o.reconstruction_confidence, o.reconstruction_attempted_at, o.reconstruction_failure
    FROM last AS l FULL OUTER JOIN [catalogue] AS o ON o.image_url = l.image_url
    LEFT JOIN fresh AS f ON f.image_url = l.image_url""")
def upsert_catalogue(spark, d):
    return cat.upsert_catalogue(_changes(spark, d), derive(spark, d, "catalogue"))


_PREPARED = """SELECT position, title, category, image_url, thumbnail_url, page_url, scraped_at,
    CASE WHEN position % 3 = 0 THEN 'Given' WHEN position % 3 = 1 THEN '' END AS city,
    CASE WHEN position % 4 = 0 THEN 'Givenland' END AS country,
    CASE WHEN position % 2 = 0 THEN CAST(position % 80 AS DOUBLE) END AS lat,
    CASE WHEN position % 2 = 0 THEN CAST(position % 70 AS DOUBLE) END AS lon,
    CASE WHEN position % 5 = 0 THEN CAST(0.75 AS DOUBLE) END AS geocode_confidence FROM [titles]"""


@query(f"""SELECT t.position, nullif(p.shape, '') AS subcategory, coalesce(nullif(t.city, ''), p.city) AS city,
             coalesce(t.country, p.country) AS country, t.lat, t.lon, coalesce(t.geocode_confidence, p.confidence) AS geocode_confidence
           FROM ({_PREPARED}) AS t JOIN ({_PARSED}) AS p ON p.position = t.position""")
def index_tiles(spark, d):
    return cat.index_tiles(derive(spark, d, _PREPARED)).select(
        "position", "subcategory", "city", "country", "lat", "lon", "geocode_confidence"
    )


@query(f"""
    SELECT g.position + 1 + (SELECT max(id) FROM [catalogue]) AS id, t.image_url, t.title, nullif(g.shape, '') AS subcategory, g.city,
      g.country, g.confidence AS geocode_confidence, {s6('g.lat', 'lat')}, {s6('g.lon', 'lon')}
    FROM ({_GEOCODED}) AS g JOIN [titles] AS t ON t.position = g.position
    UNION ALL SELECT id, image_url, title, subcategory, city, country, geocode_confidence, {s6('lat', 'lat')}, {s6('lon', 'lon')}
    FROM (SELECT * REPLACE (image_url || '/old' AS image_url) FROM [catalogue]) AS o""")
def index_batch(spark, d):
    old = derive(spark, d, "catalogue").withColumn("image_url", F.concat("image_url", F.lit("/old")))
    rows, _ = jobs.index_batch(derive(spark, d, "titles"), derive(spark, d, "place_hits"), old)
    return rows.select(
        "id", "image_url", "title", "subcategory", "city", "country", "geocode_confidence", r6("lat"), r6("lon")
    )


@query(f"SELECT count(*) AS rows, count(lat) AS geocoded FROM ({_GEOCODED}) AS g")
def index_batch_counts(spark, d):
    return jobs.index_batch(derive(spark, d, "titles"), derive(spark, d, "place_hits"), derive(spark, d, "catalogue"))[1]


@query("""SELECT id, title, geocode_source, ocr_streets, CASE WHEN TRUE THEN NULL::VARCHAR END AS gpx_path,
            NULL::DOUBLE AS reconstruction_confidence FROM (
            SELECT id, title, 'title' AS geocode_source, ocr_streets FROM [catalogue]) AS c""")
def evolve_schema(spark, d):
    older = derive(spark, d, "catalogue").select("id", "title", "ocr_streets")
    return cat.evolve_schema(older).select(
        "id", "title", "geocode_source", "ocr_streets", "gpx_path", "reconstruction_confidence"
    )


_LABEL_UPDATES = f"""SELECT id, cluster_lat AS lat, cluster_lat / 2 AS lon, CAST(id % 9 AS DOUBLE) / 9 AS confidence,
    '[]' AS streets_json, '{STAMP}' AS attempted_at, CASE WHEN id % 2 = 0 THEN 'New City' END AS city,
    CAST(NULL AS STRING) AS country FROM [label_outcomes] WHERE id % 3 = 0"""


@query(f"""SELECT c.id, CASE WHEN o.id IS NULL THEN c.lat ELSE o.lat END AS lat, CASE WHEN o.id IS NULL THEN c.lon ELSE o.lon END AS lon,
             CASE WHEN o.id IS NULL THEN c.geocode_source WHEN o.lat IS NULL THEN 'ocr-failed' ELSE 'ocr' END AS geocode_source,
             coalesce(o.city, c.city) AS city, c.country, {s6('coalesce(o.confidence, c.geocode_confidence)', 'geocode_confidence')},
             coalesce(o.streets_json, c.ocr_streets) AS ocr_streets, coalesce(o.attempted_at, c.ocr_attempted_at) AS ocr_attempted_at, c.gpx_path
           FROM [catalogue] AS c LEFT JOIN ({_LABEL_UPDATES}) AS o ON o.id = c.id""")
def apply_label_geocode(spark, d):
    updated = cat.apply_label_geocode(derive(spark, d, "catalogue"), derive(spark, d, _LABEL_UPDATES))
    return updated.select(
        "id", "lat", "lon", "geocode_source", "city", "country", r6("geocode_confidence"), "ocr_streets",
        "ocr_attempted_at", "gpx_path",
    )


@query(f"""SELECT c.id, CASE WHEN o.id IS NULL THEN c.gpx_path ELSE o.gpx_path END AS gpx_path,
             {s6('CASE WHEN o.id IS NULL THEN c.reconstruction_confidence ELSE o.confidence END', 'reconstruction_confidence')},
             CASE WHEN o.id IS NULL THEN c.reconstruction_attempted_at ELSE o.attempted_at END AS reconstruction_attempted_at,
             CASE WHEN o.id IS NULL THEN c.reconstruction_failure ELSE o.failure END AS reconstruction_failure, c.lat
           FROM [catalogue] AS c LEFT JOIN (SELECT * FROM [outcomes] WHERE id % 4 = 1) AS o ON o.id = c.id""")
def apply_reconstruction(spark, d):
    outcomes = derive(spark, d, "outcomes").filter("id % 4 = 1")
    return cat.apply_reconstruction(derive(spark, d, "catalogue"), outcomes).select(
        "id", "gpx_path", r6("reconstruction_confidence"), "reconstruction_attempted_at", "reconstruction_failure", "lat"
    )


@query("""SELECT term, arg_max(slug, position) AS slug FROM (
            SELECT p_partkey AS position, p_name AS term, lower(p_type) AS slug FROM {part}) AS t GROUP BY term""")
def replace_synonyms(spark, d):
    old = derive(spark, d, "SELECT p_brand AS term, 'old' AS slug FROM {part}")
    new = derive(spark, d, "SELECT p_partkey AS position, p_name AS term, lower(p_type) AS slug FROM {part}")
    return cat.replace_synonyms(old, new)


_META_OLD = "SELECT CAST(c_custkey AS STRING) AS key, c_name AS value FROM {customer}"
_META_NEW = "SELECT o_orderkey AS position, CAST(o_custkey * 2 AS STRING) AS key, CAST(o_orderkey AS STRING) AS value FROM {orders}"


@query(f"""SELECT coalesce(n.key, o.key) AS key, coalesce(n.value, o.value) AS value FROM ({_META_OLD}) AS o FULL OUTER JOIN
           (SELECT key, arg_max(value, position) AS value FROM ({_META_NEW}) AS m GROUP BY key) AS n ON n.key = o.key""")
def set_meta(spark, d):
    return cat.set_meta(derive(spark, d, _META_OLD), derive(spark, d, _META_NEW))


@query(f"SELECT value FROM ({_META_OLD}) AS o WHERE key = '17'")
def get_meta(spark, d):
    return cat.get_meta(derive(spark, d, _META_OLD), "17")


# --- work lists -------------------------------------------------------------------------------------------------

@query("SELECT id, title, category FROM [catalogue] WHERE lat IS NULL AND ocr_attempted_at IS NULL AND category IN ('transport', 'misc', 'birds')")
def needs_label_geocode(spark, d):
    rows = cat.needs_label_geocode(derive(spark, d, "catalogue"), ["transport", "misc", "birds"])
    return rows.select("id", "title", "category")


@query("SELECT id, title, category FROM [catalogue] WHERE lat IS NOT NULL")
def needs_reconstruction(spark, d):
    rows = cat.needs_reconstruction(derive(spark, d, "catalogue"), retry_attempted=True)
    return rows.select("id", "title", "category")


@query("""SELECT id, title, geocode_confidence FROM [catalogue] WHERE geocode_source = 'ocr' AND geocode_confidence > 0.55
          ORDER BY md5('7|' || id), id LIMIT 50""")
def qa_sample(spark, d):
    return cat.qa_sample(derive(spark, d, "catalogue")).select("id", "title", "geocode_confidence")


@query("SELECT id, title, category, image_url FROM [catalogue]")
def all_routes(spark, d):
    return cat.all_routes(derive(spark, d, "catalogue")).select("id", "title", "category", "image_url")


@query("""SELECT id, name, emoji, distinctive_features FROM (VALUES
            ('pig', 'Pig', '🐷', 'curly tail, ear bump, two wide legs'),
            ('dog', 'Dog', '🐶', 'floppy ear, long snout, longer body')) AS s(id, name, emoji, distinctive_features)
          WHERE id IN (SELECT CASE WHEN p_size % 2 = 0 THEN 'pig' ELSE 'dog' END FROM {part})""")
def shape_metadata(spark, d):
    drawn = table(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, "pig").otherwise("dog").alias("shape"))
    return cat.shape_metadata(drawn)


# --- reports ----------------------------------------------------------------------------------------------------

@query("""SELECT category, count(*) AS total, count(lat) AS geocoded FROM [catalogue] GROUP BY category
          UNION ALL SELECT NULL, count(*), count(lat) FROM [catalogue]""")
def catalogue_stats(spark, d):
    return cat.catalogue_stats(derive(spark, d, "catalogue")).drop("is_total")


@query("SELECT geocode_source, count(*) AS n FROM [catalogue] WHERE lat IS NOT NULL GROUP BY geocode_source")
def count_by_source(spark, d):
    return cat.count_by_source(derive(spark, d, "catalogue"))


@query("SELECT count(reconstruction_attempted_at) AS attempted, count(gpx_path) AS shipped FROM [catalogue]")
def reconstruction_counts(spark, d):
    return cat.reconstruction_counts(derive(spark, d, "catalogue"))


@query("""SELECT count(*) AS attempted, count(cluster_lat) AS geocoded, round(count(cluster_lat) / count(*), 3) AS success_rate,
            count(error) AS errors, count(*) FILTER (candidates = 0 AND error IS NULL) AS no_streets,
            count(*) FILTER (candidates > 0 AND cluster_lat IS NULL AND error IS NULL) AS no_cluster FROM [label_outcomes]""")
def label_geocode_summary(spark, d):
    return cat.label_geocode_summary(derive(spark, d, "label_outcomes"))


@query("""SELECT attempted, shipped, round(shipped / attempted, 3) AS ship_rate, mean_confidence, modes FROM (
            SELECT count(*) AS attempted, count(gpx_path) AS shipped, round(avg(confidence), 3) AS mean_confidence FROM [outcomes]) AS t
          CROSS JOIN (SELECT string_agg(mode || '=' || CAST(n AS STRING), ',' ORDER BY n DESC, mode) AS modes FROM (
            SELECT split_part(coalesce(failure, 'unknown'), ':', 1) AS mode, count(*) AS n FROM [outcomes] WHERE gpx_path IS NULL GROUP BY 1) AS f) AS g""")
def reconstruction_summary(spark, d):
    modes = F.array_join(F.transform("failure_modes", lambda m: F.concat(m["mode"], F.lit("="), m["n"].cast("string"))), ",")
    return cat.reconstruction_summary(derive(spark, d, "outcomes")).select(
        "attempted", "shipped", "ship_rate", "mean_confidence", modes.alias("modes")
    )


@query("""SELECT stage, n FROM (SELECT CASE WHEN failure IS NULL THEN 'shipped' ELSE split_part(failure, ':', 1) END AS stage, count(*) AS n
          FROM [outcomes] GROUP BY 1) AS f""")
def batch_funnel(spark, d):
    return jobs.batch_funnel(derive(spark, d, "outcomes")).select("stage", "n")
