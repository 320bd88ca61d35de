"""Whole jobs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from routewright.operators import catalogue as cat
from routewright.plans import jobs
from routewright.session import staging_path
from routewright.streaming import jobs as streams
from routewright.streaming import store
from workload.catalogue_queries import _GEOCODED
from workload.fixtures import STAMP, derive, table
from workload.registry import query, r6, s6

# Work rows for the image jobs: one catalogue row per image of the label fixture.
_IMAGES = f"""
    SELECT DISTINCT image_id AS id, 'Image ' || CAST(image_id AS STRING) AS title, 'shapes' AS category, CAST(NULL AS STRING) AS subcategory,
      CAST(NULL AS STRING) AS city, CAST(NULL AS STRING) AS country, CASE WHEN image_id % 7 = 0 THEN 1D END AS lat, CASE WHEN image_id % 7 = 0 THEN 1D END AS lon,
      0D AS geocode_confidence, 'title' AS geocode_source, CAST(NULL AS STRING) AS ocr_streets, CAST(NULL AS STRING) AS ocr_attempted_at,
      'https://img.example.org/i' || CAST(image_id AS STRING) AS image_url, 'https://site.example.org' AS page_url, CAST(NULL AS DOUBLE) AS distance_estimate_km,
      '{STAMP}' AS scraped_at, CAST(NULL AS STRING) AS gpx_path, CAST(NULL AS DOUBLE) AS reconstruction_confidence,
      CAST(NULL AS STRING) AS reconstruction_attempted_at, CAST(NULL AS STRING) AS reconstruction_failure FROM [streets]"""


@query()
def label_geocode_batch(spark, d):
    rows, outcomes = jobs.label_geocode_batch(
        derive(spark, d, _IMAGES), derive(spark, d, "fragments"), derive(spark, d, "gazetteer"), STAMP
    )
    return outcomes.select("id", "fragments", "candidates", "matched", r6("cluster_lat"), r6("cluster_lon"), r6("confidence"), "streets_json").join(
        rows.select("id", "geocode_source", "city"), "id"
    )


@query()
def reconstruct_batch(spark, d):
    work = derive(spark, d, _IMAGES).withColumns({"lat": F.lit(1.0), "lon": F.lit(1.0)})
    nodes = derive(spark, d, """SELECT id, 40 + CAST(id % 30 AS DOUBLE) + CAST(floor(id / 30) AS DOUBLE) / 2000 AS lat,
                                CAST(id % 30 AS DOUBLE) - 10 + CAST(floor(id / 30) AS DOUBLE) / 2500 AS lon FROM [nodes]""")
    edges = derive(spark, d, "SELECT u, v, length FROM [edges]")
    _, outcomes = jobs.reconstruct_batch(
        work, derive(spark, d, "pixels"), derive(spark, d, "fragments"), derive(spark, d, "gazetteer"), nodes, edges, STAMP,
        min_area=100,
    )
    return outcomes.select("id", "failure", "n_gcps", r6("confidence"), r6("fidelity_score"), "gpx_path")


# The whole catalogue; every image_url of its even rows is another one than any tile's.
_KNOWN = "SELECT * REPLACE (image_url || CASE WHEN id % 2 = 0 THEN '' ELSE '/old' END AS image_url) FROM [catalogue]"


_INDEXED = f"""SELECT coalesce(n.image_url, o.image_url) AS image_url, CASE WHEN n.image_url IS NULL THEN o.title ELSE n.title END AS title,
             CASE WHEN n.image_url IS NULL THEN o.city ELSE n.city END AS city, CASE WHEN n.image_url IS NULL THEN o.country ELSE n.country END AS country,
             {s6('CASE WHEN n.image_url IS NULL THEN o.lat ELSE n.lat END', 'lat')},
             coalesce(o.id, (SELECT max(id) FROM ({_KNOWN}) AS k) + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY n.position)) AS id
           FROM (SELECT t.image_url, t.title, g.city, g.country, g.lat, g.position FROM ({_GEOCODED}) AS g JOIN [titles] AS t ON t.position = g.position) AS n
           FULL JOIN ({_KNOWN}) AS o ON o.image_url = n.image_url"""


def _indexed(spark, d):
    """The catalogue before the stream, and the change log that the stream of tiles left."""
    source, changes = staging_path(spark, "arrivals"), staging_path(spark, "changes")
    derive(spark, d, "titles").write.json(source)
    tiles = spark.readStream.schema("position long, title string, image_url string, thumbnail_url string, category string, page_url string, scraped_at string").json(source)
    streams.stream_index(tiles, derive(spark, d, "place_hits"), changes, staging_path(spark, "checkpoint")).awaitTermination()
    known = derive(spark, d, "catalogue").withColumn(
        "image_url", F.when(F.col("id") % 2 == 0, F.col("image_url")).otherwise(F.concat("image_url", F.lit("/old"))))
    return known, changes


@query(_INDEXED)
def stream_index(spark, d):
    known, changes = _indexed(spark, d)
    current = streams.current_catalogue(known, streams.read_changes(spark, changes))
    return current.select("image_url", "title", "city", "country", r6("lat"), "id")


@query(_INDEXED)
def compact_changes(spark, d):
    known, changes = _indexed(spark, d)
    root = staging_path(spark, "store")
    store.compact_changes(spark, root, changes, known)
    store.expire(spark, root, keep=1, changes=changes)
    return store.load_catalogue(spark, root, changes).select("image_url", "title", "city", "country", r6("lat"), "id")


@query(f"""SELECT c.id, CASE WHEN o.id IS NULL THEN c.gpx_path ELSE o.gpx_path END AS gpx_path,
             {s6('CASE WHEN o.id IS NULL THEN c.reconstruction_confidence ELSE o.confidence END', 'reconstruction_confidence')},
             CASE WHEN o.id IS NULL THEN c.reconstruction_attempted_at ELSE o.attempted_at END AS reconstruction_attempted_at,
             CASE WHEN o.id IS NULL THEN c.reconstruction_failure ELSE o.failure END AS reconstruction_failure
           FROM [catalogue] AS c LEFT JOIN [outcomes] AS o ON o.id = c.id""")
def merge_attempts(spark, d):
    """Two batches of attempts, of which the first holds an older attempt of every id, and a replay of the first."""
    root, known = staging_path(spark, "store"), derive(spark, d, "catalogue")
    last = derive(spark, d, "outcomes").withColumns({"attempt_no": F.lit(1), "attempted_ts": F.to_timestamp("attempted_at")})
    older = last.withColumns({
        "attempt_no": F.lit(0), "attempted_ts": F.col("attempted_ts") - F.expr("INTERVAL 1 HOUR"), "gpx_path": F.lit("gpx/older"), "failure": F.lit("older")})
    first, second = older.unionByName(last.filter("id % 2 = 0")), last.filter("id % 2 = 1")
    for number, batch in ((0, first), (1, second), (0, first)):
        store.merge_attempts(spark, root, "reconstruction", number, batch, cat.apply_reconstruction, "reconstruction_attempted_at", base=known)
    return store.load_catalogue(spark, root).select(
        "id", "gpx_path", r6("reconstruction_confidence"), "reconstruction_attempted_at", "reconstruction_failure")


_ATTEMPTS = "SELECT event_id % 500 AS id, CAST(floor(event_id / 500) AS BIGINT) % 3 AS attempt_no, ts AS attempted_ts, event_type AS outcome FROM {events}"


@query(f"""SELECT id, attempt_no, outcome, strftime(attempted_ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY attempted_ts DESC, attempt_no DESC) AS n
           FROM ({_ATTEMPTS}) AS a) AS l WHERE n = 1""")
def latest_attempts(spark, d):
    latest = streams.latest_attempts(derive(spark, d, _ATTEMPTS))
    return latest.select("id", "attempt_no", "outcome", F.date_format("attempted_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("SELECT event_id AS id, event_type AS outcome FROM {events}")
def stream_attempts(spark, d):
    ledger = staging_path(spark, "ledger")
    attempts = _event_stream(spark, d).select(
        F.col("event_id").alias("id"), F.explode(F.array(F.lit(0), F.lit(0))).alias("attempt_no"),
        F.col("ts").cast("timestamp").alias("attempted_ts"), F.col("event_type").alias("outcome"),
    )
    streams.stream_attempts(attempts, ledger, staging_path(spark, "checkpoint"), "40 days").awaitTermination()
    return spark.read.option("basePath", ledger).parquet(ledger).select("id", "outcome")


_SHARES = "SELECT event_id AS share_id, ts AS created_at, props AS payload FROM {events}"
_LIVE = """SELECT CAST(event_id AS VARCHAR) AS share_id, props AS payload, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM {events}
           WHERE ts >= (SELECT max(ts) FROM {events}) - INTERVAL 7 DAY ORDER BY ts DESC, event_id LIMIT 1024"""


def _shown(df):
    return df.select(F.col("share_id").cast("string"), "payload", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query(_LIVE)
def live_shares(spark, d):
    now = table(spark, d, "events").agg(F.max("ts")).scalar()
    return _shown(streams.live_shares(derive(spark, d, _SHARES), now))


@query(_LIVE)
def stream_shares(spark, d):
    emitted = staging_path(spark, "shares")
    shares = _event_stream(spark, d).select(F.col("event_id").alias("share_id"), F.col("ts").cast("timestamp").alias("created_at"),
                                               F.col("props").alias("payload"))

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{emitted}/batch_id={batch_id}")

    running = streams.stream_shares(shares).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", staging_path(spark, "checkpoint")
    ).trigger(availableNow=True).start()
    running.awaitTermination()
    now = table(spark, d, "events").agg(F.max("ts")).scalar()
    return _shown(streams.merge_shards(spark.read.option("basePath", emitted).parquet(emitted), now))
