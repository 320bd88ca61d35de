"""Sources and sinks, over documents derived from the given tables or written from them and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from routewright.operators.lines import as_lines, as_points
from routewright.session import staging_path
from routewright.sinks import writers
from routewright.sources import readers
from workload.fixtures import STAMP, derive, table
from workload.registry import query, r6, s6

# --- tiles ------------------------------------------------------------------------------------------------------


@query("SELECT title, image_url, thumbnail_url, category, page_url, scraped_at FROM [titles]")
def read_tiles(spark, d):
    path = staging_path(spark, "tiles")
    derive(spark, d, "titles").drop("position").write.json(path)
    return readers.read_tiles(spark, path).drop("position")


# Pages hold plain links only; each becomes an image link, with every third address off the CDN host.
_LINK = '<a href="/([^"]*)">([^<]*)</a>'
_IMAGE = '<a class="t" href="https://{host}/\\1"><img src="/thumb/\\1" alt=" \\2 "></a>'


def _pages(spark, d):
    image = _IMAGE.replace("\\1", "$1").replace("\\2", "$2")
    html = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", _LINK, image.format(host="other.example.net"))).otherwise(
        F.regexp_replace("html", _LINK, image.format(host="cdn.example.org"))
    )
    return table(spark, d, "pages").select(
        "page_id", F.concat(F.lit("c"), (F.col("page_id") % 7).cast("string")).alias("category"),
        F.col("url").alias("page_url"), html.alias("html"),
    )


_TILES = f"""
    SELECT page_id, 'c' || CAST(page_id % 7 AS STRING) AS category, url AS page_url, pos, image_url, title, thumbnail_url FROM (
      SELECT *, row_number() OVER (PARTITION BY page_id, image_url ORDER BY pos) AS n FROM (
        SELECT page_id, url, i - 1 AS pos, 'https://cdn.example.org/' || hrefs[i] AS image_url, '/thumb/' || hrefs[i] AS thumbnail_url,
               trim(texts[i]) AS title
        FROM (SELECT page_id, url, regexp_extract_all(html, '{_LINK}', 1) AS hrefs, regexp_extract_all(html, '{_LINK}', 2) AS texts,
                unnest(range(1, len(regexp_extract_all(html, '{_LINK}', 1)) + 1)) AS i FROM {{pages}} WHERE page_id % 3 <> 0) AS u) AS l) AS f
    WHERE n = 1 AND title <> '' AND lower(title) <> 'and'"""


def _tiles(spark, d):
    return readers.extract_tiles(_pages(spark, d), "cdn.example.org", "and", STAMP)


@query(f"SELECT page_id, category, page_url, pos, image_url, title, thumbnail_url FROM ({_TILES}) AS t")
def extract_tiles(spark, d):
    return _tiles(spark, d).select(
        "page_id", "category", "page_url", F.col("pos").cast("long").alias("pos"), "image_url", "title", "thumbnail_url"
    )


@query(f"""SELECT category, page_id, pos, title FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY page_id, pos) AS k FROM ({_TILES}) AS t) AS r
           WHERE k <= 40""")
def limit_per_category(spark, d):
    return readers.limit_per_category(_tiles(spark, d), 40).select(
        "category", "page_id", F.col("pos").cast("long").alias("pos"), "title"
    )


# --- caches and responses ---------------------------------------------------------------------------------------

_NUM = "CAST(CAST(c_custkey % 500 AS DOUBLE) / 10 AS STRING)"


@query("""SELECT 'hit' AS kind, lower(c_name) AS key, CAST(c_custkey % 500 AS DOUBLE) / 10 AS lat, c_mktsegment AS country FROM {customer} WHERE c_custkey % 5 <> 0
          UNION ALL SELECT 'negative', lower(c_name), NULL, NULL FROM {customer} WHERE c_custkey % 5 = 0""")
def read_place_cache(spark, d):
    entry = F.expr("struct(lower(c_name) AS k, struct(CAST(c_custkey % 500 AS DOUBLE) / 10 AS lat, 1D AS lon, c_name AS display_name, "
                   "c_mktsegment AS country, c_name AS raw_query) AS v)")
    docs = table(spark, d, "customer").groupBy(F.expr("c_custkey div 100").alias("g")).agg(
        F.map_from_entries(F.collect_list(F.when(F.expr("c_custkey % 5 <> 0"), entry))).alias("hits"),
        F.collect_list(F.when(F.expr("c_custkey % 5 = 0"), F.lower("c_name"))).alias("negatives"),
    )
    path = staging_path(spark, "cache")
    docs.select(F.to_json(F.struct("hits", "negatives")).alias("value"), "g").repartition("g").write.partitionBy("g").text(path)
    hits, negatives = readers.read_place_cache(spark, path)
    return hits.select(F.lit("hit").alias("kind"), "key", "lat", "country").unionByName(
        negatives.select(F.lit("negative").alias("kind"), "key"), allowMissingColumns=True
    )


_STREET_BODY = """SELECT c_custkey, '{"hits":{"' || CASE WHEN c_custkey % 2 = 0 THEN ' Mill Road ' || CAST(c_custkey AS STRING) ELSE
      'in::York::uk::High Street ' || CAST(c_custkey AS STRING) END || '":[{"name":"N","lat":1.5,"lon":2.5,"city":"York"},{"name":"M","lat":3.5,"lon":4.5}]},'
    || '"negatives":["gone ' || CAST(c_custkey AS STRING) || '"]}' AS body FROM {customer}"""


@query("""SELECT CASE WHEN c_custkey % 2 = 0 THEN 'mill road ' ELSE 'high street ' END || CAST(c_custkey AS STRING) AS lookup,
            CASE WHEN c_custkey % 2 = 1 THEN 'york' END AS in_city, CASE WHEN c_custkey % 2 = 1 THEN 'uk' END AS in_country, h.hit_no, h.name, h.lat, h.city
          FROM {customer} CROSS JOIN (VALUES (0, 'N', 1.5::DOUBLE, 'York'), (1, 'M', 3.5::DOUBLE, NULL)) AS h(hit_no, name, lat, city)
          UNION ALL SELECT 'gone ' || CAST(c_custkey AS STRING), NULL, NULL, NULL, NULL, NULL, NULL FROM {customer}""")
def read_street_hits(spark, d):
    hits, negatives = readers.parse_street_caches(derive(spark, d, _STREET_BODY))
    return hits.select("lookup", "in_city", "in_country", "hit_no", "name", "lat", "city").unionByName(
        negatives.select("lookup"), allowMissingColumns=True
    )


_PLACE_BODY = f"""SELECT lower(c_name) AS key, c_name AS raw_query, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN '[]' WHEN 1 THEN '<html>' ELSE
    '[{{"lat":"' || {_NUM} || '","lon":"2.25",' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '"display_name":"Place, ' || c_mktsegment || '",' END
    || '"address":{{"town":"Town","country":"Land"}}}},{{"lat":"x","lon":"1","display_name":"Bad"}}]' END AS body FROM {{customer}}"""


@query("""SELECT lower(c_name) AS key, CASE c_custkey % 4 WHEN 0 THEN 'negative' ELSE 'hit' END AS kind,
            CASE WHEN c_custkey % 4 > 1 THEN CAST(c_custkey % 500 AS DOUBLE) / 10 END AS lat,
            CASE WHEN c_custkey % 4 > 1 THEN CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'Place, ' || c_mktsegment END END AS display_name
          FROM {customer} WHERE c_custkey % 4 <> 1""")
def read_place_responses(spark, d):
    hits, negatives = readers.parse_place_responses(derive(spark, d, _PLACE_BODY))
    return hits.select("key", F.lit("hit").alias("kind"), "lat", "display_name").unionByName(
        negatives.select("key", F.lit("negative").alias("kind")), allowMissingColumns=True
    )


@query("""SELECT lower(c_name) AS key, CASE c_custkey % 4 WHEN 0 THEN 'negative' ELSE 'hit' END AS kind,
            CASE WHEN c_custkey % 4 > 1 THEN CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Place' END END AS name,
            CASE WHEN c_custkey % 4 > 1 THEN 'Town' END AS city FROM {customer} WHERE c_custkey % 4 <> 1""")
def read_street_responses(spark, d):
    hits, negatives = readers.parse_street_responses(derive(spark, d, _PLACE_BODY))
    return hits.select("key", F.lit("hit").alias("kind"), "name", "city").unionByName(
        negatives.select("key", F.lit("negative").alias("kind")), allowMissingColumns=True
    )


_WAY_BODY = f"""SELECT lower(c_name) AS key, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN '{{"elements":[{{"type":"node"}}]}}' ELSE
    '{{"elements":[{{"type":"way","tags":{{' || CASE c_custkey % 3 WHEN 0 THEN '"name":"Tagged"' WHEN 1 THEN '"name:en":"English"' ELSE '' END
    || '}},"center":{{"lat":' || {_NUM} || ',"lon":3.5}}}},{{"type":"way","tags":{{}}}}]}}' END AS body FROM {{customer}}"""


@query("""SELECT lower(c_name) AS key, CASE WHEN c_custkey % 4 = 0 THEN 'negative' ELSE 'hit' END AS kind,
            CASE WHEN c_custkey % 4 <> 0 THEN CASE c_custkey % 3 WHEN 0 THEN 'Tagged' WHEN 1 THEN 'English' ELSE c_name END END AS name,
            CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 500 AS DOUBLE) / 10 END AS lat FROM {customer}""")
def read_way_responses(spark, d):
    hits, negatives = readers.parse_way_responses(derive(spark, d, _WAY_BODY))
    return hits.select("key", F.lit("hit").alias("kind"), "name", "lat").unionByName(
        negatives.select("key", F.lit("negative").alias("kind")), allowMissingColumns=True
    )


_ROUTE_BODY = """SELECT o_orderkey AS request_id, CASE o_orderkey % 5 WHEN 0 THEN '{"code":"NoRoute","message":"gone"}' WHEN 1 THEN '{"code":"Ok","routes":[]}'
    ELSE '{"code":"Ok","routes":[{"geometry":{"coordinates":[[1.5,' || CAST(o_orderkey % 90 AS STRING) || '.25],[2.5,10.75]]},"distance":'
      || CAST(o_custkey AS STRING) || '.5,"duration":9.0}]}' END AS body FROM {orders}"""


@query("""SELECT o_orderkey AS request_id, CASE o_orderkey % 5 WHEN 0 THEN 'NoRoute' WHEN 1 THEN 'Ok' END AS code,
            CASE WHEN o_orderkey % 5 > 1 THEN o_orderkey % 90 + 0.25::DOUBLE END AS first_lat, CASE WHEN o_orderkey % 5 > 1 THEN 2.5::DOUBLE END AS last_lon,
            CASE WHEN o_orderkey % 5 > 1 THEN o_custkey + 0.5::DOUBLE END AS distance_m FROM {orders}""")
def read_routing_responses(spark, d):
    routes, rejects = readers.parse_routing_responses(derive(spark, d, _ROUTE_BODY))
    kept = routes.select(
        "request_id", F.lit(None).cast("string").alias("code"), F.element_at("line", 1)["lat"].alias("first_lat"),
        F.element_at("line", -1)["lon"].alias("last_lon"), "distance_m",
    )
    return kept.unionByName(rejects.select("request_id", "code"), allowMissingColumns=True)


# --- documents --------------------------------------------------------------------------------------------------

def _records(spark, d):
    return as_lines(derive(spark, d, "lines"), ["route_id"])


_ROUND_TRIP = f"SELECT route_id, seq, {s6('lat', 'lat')}, {s6('lon', 'lon')} FROM [lines]"


@query(_ROUND_TRIP)
def geojson_round_trip(spark, d):
    documents = _records(spark, d).select("route_id", writers.to_geojson(F.col("line")).alias("body"))
    back = documents.select("route_id", readers.from_geojson(F.col("body")).alias("line"))
    return as_points(back, ["route_id"]).select("route_id", "seq", r6("lat"), r6("lon"))


_NAMED = "'Line ' || CAST(route_id AS STRING) || ' & <co>'"
_NAMED_XML = "'Line ' || CAST(route_id AS STRING) || ' &amp; &lt;co&gt;'"


def _named():
    return F.concat(F.lit("Line "), F.col("route_id").cast("string"), F.lit(" & <co>"))


def _joined(item: str, sep: str) -> str:
    return f"string_agg({item}, '{sep}' ORDER BY seq)"


_GPX_HEAD = (writers._HEAD + writers._GPX.format(creator=writers.CREATOR)).replace("\n", "' || chr(10) || '")


@query(f"""SELECT route_id, md5('{_GPX_HEAD}  <metadata><name>' || {_NAMED_XML} || '</name><desc>about</desc><time>{STAMP}</time></metadata>' || chr(10) ||
             '  <rte>' || chr(10) || '    <name>' || {_NAMED_XML} || '</name>' || chr(10) || {_joined("'    <rtept lat=' || chr(34) || printf('%.6f', lat) || chr(34) || ' lon=' || chr(34) || printf('%.6f', lon) || chr(34) || '/>' || chr(10)", '')}
             || '  </rte>' || chr(10) || '  <trk>' || chr(10) || '    <name>' || {_NAMED_XML} || '</name>' || chr(10) || '    <trkseg>' || chr(10) ||
             {_joined("'      <trkpt lat=' || chr(34) || printf('%.6f', lat) || chr(34) || ' lon=' || chr(34) || printf('%.6f', lon) || chr(34) || '/>' || chr(10)", '')}
             || '    </trkseg>' || chr(10) || '  </trk>' || chr(10) || '</gpx>' || chr(10)) AS doc FROM [lines] GROUP BY route_id""")
def write_gpx_route_and_track(spark, d):
    document = writers.gpx_route_and_track(F.col("line"), _named(), F.lit("about"), STAMP)
    return _records(spark, d).select("route_id", F.md5(document).alias("doc"))


@query(f"""SELECT route_id, length(doc) AS size, md5(doc) AS doc FROM (SELECT route_id, '{_GPX_HEAD}  <metadata>' || chr(10) || '    <name>' || {_NAMED_XML} || '</name>' || chr(10) || '    <desc>about</desc>' || chr(10)
             || '    <keywords>art, run</keywords>' || chr(10) || '  </metadata>' || chr(10) || '  <rte>' || chr(10) || '    <name>' || {_NAMED_XML} || '</name>' || chr(10)
             || '    <desc>about</desc>' || chr(10) || '    <src>here</src>' || chr(10) || coalesce({_joined("'    <rtept lat=' || chr(34) || CAST(lat AS STRING) || chr(34) || ' lon=' || chr(34) || CAST(lon AS STRING) || chr(34) || '/>' || chr(10)", '')}
             FILTER (seq % 10 <> 3), '') || '  </rte>' || chr(10) || '</gpx>' || chr(10) AS doc
           FROM (SELECT route_id, seq, 50.5 + route_id % 8 * 0.25::DOUBLE AS lat, seq * 0.5::DOUBLE AS lon FROM [lines]) AS l GROUP BY route_id) AS x""")
def write_gpx_route(spark, d):
    rows = derive(spark, d, "SELECT route_id, seq, CASE WHEN seq % 10 = 3 THEN 95D ELSE 50.5D + route_id % 8 * 0.25D END AS lat, seq * 0.5D AS lon FROM [lines]")
    document = writers.gpx_route(F.col("line"), _named(), F.lit("about"), F.lit("here"), F.array(F.lit("art"), F.lit("run")))
    written = as_lines(rows, ["route_id"]).withColumn("doc", document)
    return written.select("route_id", F.length("doc").cast("long").alias("size"), F.md5("doc").alias("doc"))


@query(f"""SELECT route_id, md5(coords) AS coords, {_NAMED_XML} AS title FROM (
             SELECT route_id, {_joined("printf('%.6f', lon) || ',' || printf('%.6f', lat) || ',0'", ' ')} AS coords FROM [lines] GROUP BY route_id) AS k""")
def write_kml(spark, d):
    documents = _records(spark, d).withColumn("doc", writers.kml_line(F.col("line"), _named(), F.lit("about")))
    return documents.select(
        "route_id", F.md5(F.regexp_extract("doc", "<coordinates>(.*)</coordinates>", 1)).alias("coords"),
        F.regexp_extract("doc", "<description>[^<]*</description>(?s:.*)<Placemark>\\s*<name>([^\\n]*)</name>", 1).alias("title"),
    )


def _written(spark, d, document):
    folder = staging_path(spark, "documents")
    name = F.concat(F.lit("line_"), F.col("route_id").cast("string"), F.lit(".xml"))
    writers.write_documents(_records(spark, d).select(F.col("route_id").alias("id"), name.alias("path"), document.alias("body")), folder)
    return folder


@query(f"SELECT 'Line ' || CAST(route_id AS STRING) || ' & <co>' AS name, seq, {s6('lat', 'lat')}, {s6('lon', 'lon')} FROM [lines]")
def read_gpx(spark, d):
    path = _written(spark, d, writers.gpx_route_and_track(F.col("line"), _named(), F.lit("about"), STAMP))
    return as_points(readers.read_gpx(spark, path), ["name"]).select("name", "seq", r6("lat"), r6("lon"))


@query(f"SELECT count(*) AS points, {s6('sum(lat)', 'lat_sum')} FROM [lines]")
def read_gpx_tracks(spark, d):
    path = _written(spark, d, writers.gpx_route_and_track(F.col("line"), _named(), F.lit("about"), STAMP))
    points = as_points(readers.read_gpx(spark, path, "trk"), ["path"])
    return points.agg(F.count("*").alias("points"), r6(F.sum("lat"), "lat_sum"))


@query(f"SELECT seq, {s6('lat', 'lat')}, {s6('lon', 'lon')} FROM [lines]")
def read_kml(spark, d):
    path = _written(spark, d, writers.kml_line(F.col("line"), _named(), F.lit("about")))
    return as_points(readers.read_kml(spark, path), ["path"]).select("seq", r6("lat"), r6("lon"))


@query("""SELECT 'node' AS kind, id AS a, id AS b FROM [nodes] WHERE lat BETWEEN 51.003 AND 51.3 AND lon BETWEEN 0.01 AND 0.05
          UNION ALL SELECT 'edge', e.u, e.v FROM [edges] AS e JOIN [nodes] AS p ON p.id = e.u JOIN [nodes] AS q ON q.id = e.v
          WHERE p.lat BETWEEN 51.003 AND 51.3 AND p.lon BETWEEN 0.01 AND 0.05 AND q.lat BETWEEN 51.003 AND 51.3 AND q.lon BETWEEN 0.01 AND 0.05""")
def read_street_graph(spark, d):
    path = staging_path(spark, "graph")
    readers.write_street_graph(derive(spark, d, "nodes"), derive(spark, d, "edges"), path)
    nodes, edges = readers.read_street_graph(spark, path, 51.003, 51.3, 0.01, 0.05)
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("id").alias("b")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"))
    )


@query("SELECT route_id AS id, 'gpx/route_' || lpad(CAST(route_id AS STRING), CAST(greatest(5, length(CAST(route_id AS STRING))) AS INT), '0') || '.gpx' AS gpx_path, 40 AS points FROM (SELECT DISTINCT route_id FROM [lines] WHERE route_id % 10 >= 6) AS r")
def write_route_files(spark, d):
    about = F.lit("about")
    outcomes = _records(spark, d).select(
        F.col("route_id").alias("id"), (F.col("route_id") % 10 / 10).alias("confidence"),
        writers.gpx_route(F.col("line"), _named(), about, about, F.array(about)).alias("gpx_xml"),
    )
    folder = staging_path(spark, "files")
    written = writers.write_route_files(outcomes, folder)
    found = readers.read_gpx(spark, f"{folder}/gpx").select(
        F.concat(F.lit("gpx/"), F.element_at(F.split("path", "/"), -1)).alias("gpx_path"), F.size("line").alias("points")
    )
    return written.join(found, "gpx_path").select("id", "gpx_path", "points")
