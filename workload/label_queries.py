"""Label merging, street matching, clusters, city hypotheses and image fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from routewright.operators import crossref, georef, labels
from workload.fixtures import derive
from workload.registry import query, r6, s6, s_hav
from workload.text_queries import s_title_case, s_variants

# --- labels -----------------------------------------------------------------------------------------------------

# Each name stands in a band of its own in the data, so joining is a question of the gap alone.
_MERGED = """
    SELECT a.image_id, CASE WHEN near THEN a.text || ' ' || b.text ELSE a.text END AS text,
           CASE WHEN near THEN (a.conf + b.conf) / 2 ELSE a.conf END AS conf, a.x_min,
           CASE WHEN near THEN b.x_max ELSE a.x_max END AS x_max
    FROM (SELECT a.*, b.x_min - a.x_max <= 1.5 * ((a.y_max - a.y_min) + 12) / 2 AS near FROM [fragments] AS a
          JOIN [fragments] AS b ON b.fragment_no = a.fragment_no + 1 WHERE a.fragment_no % 4 = 0) AS a
    JOIN [fragments] AS b ON b.fragment_no = a.fragment_no + 1
    UNION ALL
    SELECT b.image_id, b.text, b.conf, b.x_min, b.x_max FROM [fragments] AS a JOIN [fragments] AS b ON b.fragment_no = a.fragment_no + 1
    WHERE a.fragment_no % 4 = 0 AND b.x_min - a.x_max > 1.5 * ((a.y_max - a.y_min) + 12) / 2"""


@query(f"SELECT image_id, text, {s6('conf', 'conf')}, x_min, x_max FROM ({_MERGED}) AS m")
def merge_labels(spark, d):
    return labels.merge_labels(derive(spark, d, "fragments")).select("image_id", "text", r6("conf"), "x_min", "x_max")


@query("SELECT image_id, text, conf FROM [labels] WHERE conf >= 0.3")
def candidate_filter(spark, d):
    return labels.parse_labels(derive(spark, d, "labels"), 0.30).select("image_id", "text", "conf")


def _s_candidates(source: str, least: float) -> str:
    return f"""
        SELECT image_id, normalized, conf AS confidence, x_center, y_center,
               row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, band_y, band_x) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY image_id, normalized ORDER BY conf DESC, band_y, band_x) AS n
              FROM (SELECT *, {s_title_case('name')} AS normalized FROM [{source}] WHERE conf >= {least}) AS s) AS d WHERE n = 1"""


def _candidates(spark, d, source="labels", least=0.2):
    return labels.street_candidates(derive(spark, d, source), least)


@query(f"SELECT image_id, normalized, confidence FROM ({_s_candidates('labels', 0.3)}) AS c")
def street_candidates(spark, d):
    return _candidates(spark, d, least=0.3).select("image_id", "normalized", "confidence")


@query(f"SELECT image_id, normalized, rank FROM ({_s_candidates('labels', 0.2)}) AS c WHERE rank <= 6")
def top_candidates(spark, d):
    ranked = labels.rank_candidates(_candidates(spark, d), 6)
    return ranked.select("image_id", "normalized", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT image_id, normalized, confidence, x_center AS x_px, y_center AS y_px FROM ({_s_candidates('labels', 0.2)}) AS c")
def pixel_anchors(spark, d):
    return labels.pixel_anchors(derive(spark, d, "labels"), _candidates(spark, d))


# --- gazetteer --------------------------------------------------------------------------------------------------

_KEYED = "SELECT lower(name) AS key, * FROM [gazetteer] UNION ALL SELECT lower(name_en), * FROM [gazetteer] WHERE name_en IS NOT NULL"


def _s_top_hits(limit: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY importance DESC, place_id) AS hit_no
               FROM ({_KEYED}) AS k) AS h WHERE hit_no <= {limit}"""


@query(f"SELECT key, place_id, hit_no FROM ({_s_top_hits(5)}) AS h")
def top_hits_per_name(spark, d):
    hits = crossref.top_hits_per_name(derive(spark, d, "gazetteer"), 5)
    return hits.select("key", "place_id", F.col("hit_no").cast("long").alias("hit_no"))


def _s_matches(source: str, cols: str = "*") -> str:
    """Hits of the first six candidates; a name without hits falls back to its first misreading that has some."""
    return f"""
        SELECT {cols} FROM (
          SELECT m.*, min(attempt) OVER (PARTITION BY image_id, street) AS first_attempt FROM (
            SELECT c.image_id, c.normalized AS street, c.confidence, c.attempt, c.spelling, h.hit_no, h.lat, h.lon, h.city, h.country
            FROM (SELECT image_id, normalized, confidence, unnest({s_variants('normalized', 3)}) AS spelling,
                    unnest(range(len({s_variants('normalized', 3)}))) AS attempt
                  FROM ({_s_candidates(source, 0.2)}) AS c0 WHERE rank <= 6) AS c
            JOIN ({_s_top_hits(40)}) AS h ON h.key = lower(c.spelling)) AS m) AS f WHERE attempt = first_attempt"""


def _matches(spark, d, source="labels"):
    return crossref.match_streets(_candidates(spark, d, source), derive(spark, d, "gazetteer"))


@query(f"SELECT image_id, street, spelling, hit_no, {s6('lat', 'lat')}, {s6('lon', 'lon')}, city FROM ({_s_matches('misread')}) AS m")
def match_streets(spark, d):
    return _matches(spark, d, "misread").select(
        "image_id", "street", "spelling", F.col("hit_no").cast("long").alias("hit_no"), r6("lat"), r6("lon"), "city"
    )


_NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY street, hit_no) AS point_id FROM ({_s_matches('labels')}) AS m0"
_NEAR = s_hav("a.lat", "a.lon", "b.lat", "b.lon", "6371.0", True)


def _numbered(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("image_id").orderBy("street", "hit_no")
    return _matches(spark, d).withColumn("point_id", F.row_number().over(order).cast("long"))


@query(f"""WITH pts AS ({_NUMBERED}) SELECT a.image_id, a.point_id AS a, b.point_id AS b, {s6(_NEAR, 'distance_km')}
           FROM pts AS a JOIN pts AS b ON a.image_id = b.image_id AND a.point_id < b.point_id WHERE {_NEAR} <= 0.7""")
def near_pairs(spark, d):
    return crossref.near_pairs(_numbered(spark, d), 0.7).select("image_id", "a", "b", r6("distance_km"))


@query(f"""WITH RECURSIVE pts AS ({_NUMBERED}), spots AS (SELECT DISTINCT image_id, lat, lon FROM pts),
             link AS (SELECT a.image_id, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2
                      FROM spots AS a JOIN spots AS b ON a.image_id = b.image_id WHERE {_NEAR} <= 0.4),
             reach AS (SELECT image_id, lat AS r_lat, lon AS r_lon, lat, lon FROM spots
                       UNION SELECT r.image_id, r.r_lat, r.r_lon, l.lat2, l.lon2 FROM reach AS r JOIN link AS l
                         ON l.image_id = r.image_id AND l.lat1 = r.lat AND l.lon1 = r.lon),
             root AS (SELECT image_id, r_lat AS lat, r_lon AS lon, min(row(lat, lon)) AS root FROM reach GROUP BY 1, 2, 3)
           SELECT image_id, count(*) AS points, count(DISTINCT street) AS names, {s6('min(lat)', 'min_lat')}, {s6('max(lon)', 'max_lon')}
           FROM pts JOIN root USING (image_id, lat, lon) GROUP BY image_id, root""")
def single_link_clusters(spark, d):
    clustered = crossref.single_link_clusters(_numbered(spark, d), 0.4)
    return clustered.groupBy("image_id", "component").agg(
        F.count("*").alias("points"), F.count_distinct("street").alias("names"),
        r6(F.min("lat"), "min_lat"), r6(F.max("lon"), "max_lon"),
    ).drop("component")


# Hits of one city lie within 3 km of each other and cities lie far apart, so at 3 km clusters are cities.
_CLUSTERS = f"""
    SELECT * FROM (
      SELECT image_id, city, country, count(DISTINCT street) AS n_names, avg(lat) AS lat, avg(lon) AS lon, min(lat) AS min_lat,
             max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, count(*) AS n_ways,
             string_agg(DISTINCT street, ', ' ORDER BY street) AS streets, min(row(lat, lon)) AS seed,
             list_sum(map_values(map_from_entries(list(DISTINCT row(street, confidence))))) AS conf_sum
      FROM ({_s_matches('labels')}) AS m GROUP BY image_id, city, country) AS c WHERE n_names >= 2"""
_CONF = "least(0.95, 0.4 + 0.15 * n_names + 0.4 * conf_sum / greatest(n_names, 1))"
_CLUSTER_COLS = (f"image_id, n_names, {s6('lat', 'lat')}, {s6('lon', 'lon')}, {s6('min_lat', 'min_lat')}, {s6('max_lon', 'max_lon')}, n_ways, "
                 f"streets, {s6(_CONF, 'confidence')}, city, country")


def _cluster_cols(df):
    return df.select(
        "image_id", "n_names", r6("lat"), r6("lon"), r6("min_lat"), r6("max_lon"), "n_ways",
        F.array_join("streets", ", ").alias("streets"), r6("confidence"), "city", "country",
    )


def _clusters(spark, d):
    return crossref.score_clusters(crossref.single_link_clusters(_matches(spark, d), 3.0), 2)


@query(f"SELECT {_CLUSTER_COLS} FROM ({_CLUSTERS}) AS c")
def cluster_score(spark, d):
    return _cluster_cols(_clusters(spark, d))


_BEST = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n_names DESC, round(conf_sum, 9) DESC, n_ways DESC, seed) AS n
            FROM ({_CLUSTERS}) AS c) AS b WHERE n = 1"""


@query(f"SELECT {_CLUSTER_COLS} FROM ({_BEST}) AS b")
def best_cluster(spark, d):
    return _cluster_cols(crossref.best_cluster(_clusters(spark, d)))


_HYPOTHESES = f"""SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n_candidates DESC, city, country) AS h_rank FROM (
      SELECT image_id, city, country, count(DISTINCT street) AS n_candidates FROM ({_s_matches('labels')}) AS m
      GROUP BY image_id, city, country) AS c) AS h WHERE h_rank <= 25"""


@query(f"SELECT image_id, city, country, n_candidates, h_rank AS rank FROM ({_HYPOTHESES}) AS h")
def city_hypotheses(spark, d):
    return crossref.city_hypotheses(_matches(spark, d)).withColumn("rank", F.col("rank").cast("long"))


_VERIFIED = f"""
    WITH asked AS (SELECT h.image_id, h.city, h.country, h.h_rank, c.normalized AS street, c.confidence FROM ({_HYPOTHESES}) AS h
                   JOIN ({_s_candidates('labels', 0.2)}) AS c ON c.image_id = h.image_id),
         m AS ({_s_matches('labels')})
    SELECT a.*, m.lat, m.lon FROM asked AS a JOIN m USING (image_id, city, country, street)
    UNION ALL
    SELECT a.*, g.lat, g.lon FROM asked AS a JOIN (
      SELECT *, row_number() OVER (PARTITION BY name, city, country ORDER BY importance DESC, place_id) AS n FROM [gazetteer]) AS g
      ON lower(g.name) = lower(a.street) AND g.city = a.city AND g.country = a.country AND n <= 40
    WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = a.image_id AND m.city = a.city AND m.country = a.country AND m.street = a.street)"""


def _verified(spark, d):
    candidates, gazetteer = _candidates(spark, d), derive(spark, d, "gazetteer")
    matches = crossref.match_streets(candidates, gazetteer)
    return crossref.verify_city_hypotheses(crossref.city_hypotheses(matches), candidates, matches, gazetteer)


@query(f"SELECT image_id, city, street, count(*) AS hits, {s6('min(lat)', 'lat')} FROM ({_VERIFIED}) AS v GROUP BY image_id, city, street")
def verify_city_hypotheses(spark, d):
    return _verified(spark, d).groupBy("image_id", "city", "street").agg(F.count("*").alias("hits"), r6(F.min("lat"), "lat"))


@query(f"""SELECT image_id, city, n_names, n_ways, {s6('lat', 'lat')} FROM (
             SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n_names DESC, h_rank) AS n FROM (
               SELECT image_id, city, h_rank, count(DISTINCT street) AS n_names, count(*) AS n_ways, avg(lat) AS lat
               FROM ({_VERIFIED}) AS v GROUP BY image_id, city, h_rank) AS s WHERE n_names >= 2) AS b WHERE n = 1""")
def best_hypothesis(spark, d):
    return crossref.best_hypothesis(_verified(spark, d), 2).select("image_id", "city", "n_names", "n_ways", r6("lat"))


# --- image fits -------------------------------------------------------------------------------------------------

@query(f"""SELECT image_id, label, x_px, y_px, {s6('lat', 'lat')}, {s6('lon', 'lon')}, confidence AS weight FROM (
             SELECT a.image_id, a.normalized AS label, a.x_center AS x_px, a.y_center AS y_px, a.confidence, m.lat, m.lon,
                    row_number() OVER (PARTITION BY a.image_id, a.normalized ORDER BY
                      round((m.lat - b.lat) * (m.lat - b.lat) + (m.lon - b.lon) * (m.lon - b.lon), 12), m.hit_no) AS n
             FROM ({_s_candidates('labels', 0.2)}) AS a JOIN ({_s_matches('labels')}) AS m ON m.image_id = a.image_id AND m.street = a.normalized
             JOIN ({_BEST}) AS b ON b.image_id = a.image_id
             WHERE m.lat BETWEEN b.min_lat AND b.max_lat AND m.lon BETWEEN b.min_lon AND b.max_lon) AS c WHERE n = 1""")
def control_points(spark, d):
    rows = derive(spark, d, "labels")
    anchors = labels.pixel_anchors(rows, _candidates(spark, d))
    points = georef.control_points(anchors, _matches(spark, d), crossref.best_cluster(_clusters(spark, d)))
    return points.select("image_id", "label", "x_px", "y_px", r6("lat"), r6("lon"), "weight")


@query(f"SELECT image_id, {s6('avg(weight)', 'mean_label_conf')}, count(*) AS n_gcps FROM [gcps] GROUP BY image_id")
def mean_label_conf(spark, d):
    return georef.mean_label_conf(derive(spark, d, "gcps")).select("image_id", r6("mean_label_conf"), "n_gcps")


# The data is drawn with a known map per image, so the fit must give that map back and drop the one bad anchor.
_KNOWN = """
    SELECT *, 6371000.0 * radians(1.0 / 60000) * cos(radians(lat0)) AS a, 0.0 AS b,
           6371000.0 * cos(radians(lat0)) * radians(image_id % 40 - lon0) AS c, 0.0 AS d,
           -6371000.0 * radians(1.0 / 100000) AS e, 6371000.0 * radians(51.5 - lat0) AS f
    FROM (SELECT image_id, avg(lat) AS lat0, avg(lon) AS lon0, count(*) AS n, max(CASE WHEN label = 'L6' AND image_id % 4 = 0 THEN 1 ELSE 0 END) AS bad
          FROM [gcps] GROUP BY image_id) AS g WHERE n >= 3"""


@query(f"""SELECT image_id, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in 'abcdef')}, n - bad AS n_anchors,
             0.0::DOUBLE AS rmse_m, CASE WHEN bad = 1 THEN 'L6' ELSE '' END AS dropped FROM ({_KNOWN}) AS k""")
def fit_affine(spark, d):
    fits, _ = georef.fit_affine(derive(spark, d, "gcps"))
    return fits.select(
        "image_id", *[(F.round(c, 4) + 0.0).alias(c) for c in "abcdef"], "n_anchors",
        (F.round("rmse_m", 4) + 0.0).alias("rmse_m"), F.array_join("dropped_labels", ",").alias("dropped"),
    )


@query("""SELECT g.image_id, g.label, round(51.5 - y_px / 100000, 5) AS lat, round(g.image_id % 40 + x_px / 60000, 5) AS lon
          FROM [gcps] AS g JOIN (SELECT image_id FROM [gcps] GROUP BY image_id HAVING count(*) >= 3) AS k ON k.image_id = g.image_id""")
def project_pixels(spark, d):
    gcps = derive(spark, d, "gcps")
    fits, _ = georef.fit_affine(gcps)
    placed = georef.project_pixels(gcps.select("image_id", "label", F.col("x_px").alias("x"), F.col("y_px").alias("y")), fits)
    return placed.select("image_id", "label", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query("""SELECT g.image_id, g.label, round(x_px, 3) AS x_px, round(y_px - CASE WHEN label = 'L6' AND g.image_id % 4 = 0 THEN 5000 ELSE 0 END, 3) AS y_px
          FROM [gcps] AS g JOIN (SELECT image_id FROM [gcps] GROUP BY image_id HAVING count(*) >= 3) AS k ON k.image_id = g.image_id""")
def locate_pixels(spark, d):
    gcps = derive(spark, d, "gcps")
    fits, _ = georef.fit_affine(gcps)
    found = georef.locate_pixels(gcps.select("image_id", "label", "lat", "lon"), fits)
    return found.select("image_id", "label", F.round("x_px", 3).alias("x_px"), F.round("y_px", 3).alias("y_px"))
