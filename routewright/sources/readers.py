"""Sources: tile lines, page HTML, caches, service responses, route files and street graphs as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routewright import schemas
from routewright.functions import geo

GRAPH_FILE_BYTES = 64 << 20
_VALUE_BYTES = 8


# --- gallery tiles ----------------------------------------------------------------------------------------------

def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tile rows of JSON lines, with their input ``position``; blank lines are skipped, a malformed line fails the job."""
    rows = spark.read.schema(schemas.TILE).option("mode", "FAILFAST").json(path)
    return rows.withColumn("position", F.monotonically_increasing_id())


def _attribute(tag: Column, name: str) -> Column:
    """Value of an HTML attribute, either quote style; empty where absent."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    raw = F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return raw


def extract_tiles(pages: DataFrame, cdn_host: str, site_name: str, scraped_at: str) -> DataFrame:
    """Tiles of gallery pages (page_id, category, page_url, html): links around an image that point at the CDN.

    The first link to an address decides for its page, even if its image then has no usable alt text.
    """
    links = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<a\s[^>]*>.*?</a>"), F.lit(0))
    rows = pages.select("page_id", "category", "page_url", F.posexplode(links).alias("pos", "link"))
    image = F.regexp_extract(F.col("link"), r"(?is)<img\b[^>]*>", 0)
    rows = rows.withColumn("image", image).filter(F.col("image") != "").select(
        "page_id", "category", "page_url", "pos",
        _attribute(F.regexp_extract(F.col("link"), r"(?is)^<a\s[^>]*>", 0), "href").alias("image_url"),
        F.trim(_attribute(F.col("image"), "alt")).alias("title"),
        F.coalesce(F.nullif(_attribute(F.col("image"), "src"), F.lit("")), _attribute(F.col("image"), "data-src"))
        .alias("thumbnail_url"),
    ).filter(F.contains(F.col("image_url"), F.lit(cdn_host)))
    first = rows.groupBy("page_id", "category", "page_url", "image_url").agg(
        F.min_by(F.struct("pos", "title", "thumbnail_url"), "pos").alias("_t")
    ).select("page_id", "category", "page_url", "image_url", "_t.*")
    return first.filter((F.col("title") != "") & (F.lower("title") != site_name.lower())).withColumn(
        "scraped_at", F.lit(scraped_at)
    )


def limit_per_category(tiles: DataFrame, n: int | None, order: tuple[str, ...] = ("page_id", "pos")) -> DataFrame:
    """First ``n`` tiles of each category in page order; no ``n`` keeps all."""
    if not n:
        return tiles
    rank = F.row_number().over(Window.partitionBy("category").orderBy(*order))
    return tiles.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


# --- caches -----------------------------------------------------------------------------------------------------

def _cache_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).option("ignoreMissingFiles", True).text(path).select(
        F.col("value").alias("body")
    )


def parse_place_caches(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, negatives) of place-cache documents in column ``body``; an unreadable document gives no rows."""
    parsed = bodies.select(F.from_json("body", schemas.PLACE_CACHE).alias("c"))
    hits = parsed.select(F.explode("c.hits").alias("key", "h")).select("key", "h.*")
    return hits, parsed.select(F.explode("c.negatives").alias("key"))


def read_place_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_place_caches(_cache_text(spark, path))


def parse_street_caches(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, negatives) of street-cache documents. Keys ``in::city::country::name`` fill the scope columns."""
    parsed = bodies.select(F.from_json("body", schemas.STREET_CACHE).alias("c"))
    key = F.lower(F.trim(F.col("key")))
    parts = F.split(key, "::")
    scoped = F.startswith(key, F.lit("in::")) & (F.size(parts) >= 4)
    scope = [
        key.alias("key"), F.when(scoped, F.get(parts, F.lit(1))).alias("in_city"),
        F.when(scoped, F.nullif(F.get(parts, F.lit(2)), F.lit(""))).alias("in_country"),
        F.when(scoped, F.array_join(F.slice(parts, 4, F.size(parts)), "::")).otherwise(key).alias("lookup"),
    ]
    hits = parsed.select(F.explode("c.hits").alias("key", "ways")).select("key", F.posexplode("ways").alias("hit_no", "w"))
    return hits.select(*scope, "hit_no", "w.*"), parsed.select(F.explode("c.negatives").alias("key")).select(*scope)


def read_street_hits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_street_caches(_cache_text(spark, path))


# --- service responses ------------------------------------------------------------------------------------------

def parse_place_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, negatives) of single-place lookups (key, raw_query, body). Only an empty list is a negative; an
    unreadable body is a failed call and gives neither."""
    parsed = responses.withColumn("r", F.from_json("body", schemas.PLACE_RESPONSE)).filter(F.col("r").isNotNull())
    first = F.get("r", F.lit(0))
    hits = parsed.filter(F.size("r") > 0).select(
        "key", F.expr("try_cast(r[0].lat AS double)").alias("lat"), F.expr("try_cast(r[0].lon AS double)").alias("lon"),
        F.coalesce(first["display_name"], F.col("raw_query")).alias("display_name"),
        first["address"]["country"].alias("country"), "raw_query",
    )
    return hits, parsed.filter(F.size("r") == 0).select("key")


def parse_street_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, negatives) of street lookups (key, body): all hits with usable coordinates, in answer order."""
    parsed = responses.withColumn("r", F.from_json("body", schemas.PLACE_RESPONSE)).filter(F.col("r").isNotNull())
    rows = parsed.select("key", F.posexplode("r").alias("hit_no", "h")).select(
        "key", "hit_no", F.split_part(F.coalesce("h.display_name", F.lit("")), F.lit(","), F.lit(1)).alias("name"),
        F.expr("try_cast(h.lat AS double)").alias("lat"), F.expr("try_cast(h.lon AS double)").alias("lon"),
        F.coalesce(*[
            F.nullif(F.col(f"h.address.{c}"), F.lit("")) for c in ("city", "town", "village", "suburb", "municipality")
        ]).alias("city"),
        F.col("h.address.country").alias("country"),
    )
    hits = rows.filter("lat IS NOT NULL AND lon IS NOT NULL")
    usable = F.filter("r", lambda h: h["lat"].try_cast("double").isNotNull() & h["lon"].try_cast("double").isNotNull())
    return hits, parsed.filter(F.size(usable) == 0).select("key")


def parse_way_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, negatives) of way queries (key, name, body): ways with a centre, named by tag, English tag or query."""
    parsed = responses.withColumn("r", F.from_json("body", schemas.WAY_RESPONSE)).filter(F.col("r").isNotNull())
    usable = F.filter(
        F.coalesce("r.elements", F.array().cast(schemas.WAYS)),
        lambda e: (e["type"] == "way") & e["center"]["lat"].isNotNull() & e["center"]["lon"].isNotNull(),
    )
    ways = parsed.withColumn("ways", usable)
    hits = ways.select("key", F.col("name").alias("asked"), F.posexplode("ways").alias("hit_no", "e")).select(
        "key", "hit_no",
        F.coalesce(
            F.nullif(F.col("e.tags")["name"], F.lit("")), F.nullif(F.col("e.tags")["name:en"], F.lit("")), "asked"
        ).alias("name"),
        F.col("e.center.lat").alias("lat"), F.col("e.center.lon").alias("lon"),
    )
    return hits, ways.filter(F.size("ways") == 0).select("key")


def parse_routing_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routes, rejects) of routing answers (request_id, body): first route of an ``Ok`` answer, lon/lat flipped."""
    parsed = responses.withColumn("r", F.from_json("body", schemas.ROUTE_RESPONSE))
    ok = F.coalesce((F.col("r.code") == "Ok") & (F.size("r.routes") > 0), F.lit(False))
    first = F.get(F.col("r.routes"), F.lit(0))
    line = F.transform(first["geometry"]["coordinates"], lambda c: F.struct(c[1].alias("lat"), c[0].alias("lon")))
    routes = parsed.filter(ok).select(
        "request_id", line.alias("line"), first["distance"].alias("distance_m"), first["duration"].alias("duration_s")
    )
    rejects = parsed.filter(~ok).select(
        "request_id", F.col("r.code").alias("code"), F.coalesce("r.message", F.lit("")).alias("message")
    )
    return routes, rejects


def from_geojson(body: Column) -> Column:
    """Array of (lat, lon) from a LineString document."""
    parsed = F.from_json(body, "type string, coordinates array<array<double>>")
    return F.transform(parsed["coordinates"], lambda c: F.struct(c[1].alias("lat"), c[0].alias("lon")))


# --- route files ------------------------------------------------------------------------------------------------

def read_gpx(spark: SparkSession, path: str, kind: str = "rte") -> DataFrame:
    """Lines of GPX files: path, name, line. ``kind`` is ``rte`` (routes) or ``trk`` (track segments)."""
    tag, schema, points = ("rte", schemas.GPX_ROUTE, "rtept") if kind == "rte" else (
        "trkseg", schemas.GPX_SEGMENT, "trkpt"
    )
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    name = F.col("name") if kind == "rte" else F.lit(None).cast("string")
    line = F.transform(points, lambda p: F.struct(p["_lat"].alias("lat"), p["_lon"].alias("lon")))
    return rows.select(
        F.col("_metadata.file_path").alias("path"), name.alias("name"),
        F.coalesce(line, F.array().cast("array<struct<lat:double,lon:double>>")).alias("line"),
    )


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Lines of KML files: path, line (altitude dropped)."""
    rows = spark.read.format("xml").option("rowTag", "LineString").schema(schemas.KML_LINE).load(path)
    triples = F.transform(F.split(F.trim("coordinates"), r"\s+"), lambda t: F.split(t, ","))
    line = F.transform(triples, lambda t: F.struct(t[1].cast("double").alias("lat"), t[0].cast("double").alias("lon")))
    return rows.select(F.col("_metadata.file_path").alias("path"), line.alias("line"))


# --- street graphs ----------------------------------------------------------------------------------------------

def write_street_graph(nodes: DataFrame, edges: DataFrame, path: str, file_bytes: int = GRAPH_FILE_BYTES) -> None:
    """Nodes (id, lat, lon) and edges (u, v, length) as Parquet files of at most about ``file_bytes``, laid along a curve.

    Rows are dealt and sorted by their place on a curve that keeps near places near, so a file covers a small area however
    dense it is, and its statistics tell a reader of a box to pass it over. Edges carry the places of both ends. Edges
    with an end that is no node are left out; of nodes that share an id, edges take the smallest place.
    """
    along = geo.curve_place(F.col("lat"), F.col("lon"))
    _write_along(nodes.select("id", "lat", "lon"), along, ["id"], f"{path}/nodes", file_bytes)
    places = nodes.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("lat", "lon")).alias("at"))
    for end in ("u", "v"):
        edges = edges.join(places.select(
            F.col("id").alias(end), F.col("at.lat").alias(f"{end}_lat"), F.col("at.lon").alias(f"{end}_lon")), end)
    placed = edges.select("u", "v", "length", "u_lat", "u_lon", "v_lat", "v_lon")
    _write_along(placed, geo.curve_place(F.col("u_lat"), F.col("u_lon")), ["u", "v"], f"{path}/edges", file_bytes)


def _write_along(rows: DataFrame, place: Column, ties: list[str], path: str, file_bytes: int) -> None:
    """The rows in files by their place; every column is a number, so a count of rows bounds the bytes."""
    most = max(1, file_bytes // (_VALUE_BYTES * len(rows.columns)))
    keyed = rows.withColumn("_place", place)
    laid = keyed.repartitionByRange("_place", *ties).sortWithinPartitions("_place", *ties)
    laid.drop("_place").write.option("maxRecordsPerFile", most).parquet(path)


def read_street_graph(
    spark: SparkSession, path: str, south: float, north: float, west: float, east: float
) -> tuple[DataFrame, DataFrame]:
    """Nodes inside a box, and edges with both ends in it; a box with ``west`` beyond ``east`` crosses the date line.

    Both are scans with filters that reach the files' statistics: nothing is shuffled or sent to the driver.
    """
    def inside(lat: str, lon: str) -> Column:
        across = (F.col(lon) >= west) | (F.col(lon) <= east) if west > east else F.col(lon).between(west, east)
        return F.col(lat).between(south, north) & across

    nodes = spark.read.parquet(f"{path}/nodes").where(inside("lat", "lon")).select("id", "lat", "lon")
    edges = spark.read.parquet(f"{path}/edges").where(inside("u_lat", "u_lon") & inside("v_lat", "v_lon"))
    return nodes, edges.select("u", "v", "length")
