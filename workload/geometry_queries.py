"""Lines, similarity, street graphs, rasters and route choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from routewright.functions import geo
from routewright.operators import graph, lines, nearest, raster, routers, routes, similarity
from routewright.plans import generation
from workload.fixtures import derive
from workload.registry import query, r6, s6, s_hav
from workload.text_queries import S_STROKE

# --- lines ------------------------------------------------------------------------------------------------------

_STEP = s_hav("lat", "lon", "lat2", "lon2", "6371008.8")


def _s_pairs(source: str, a: str, b: str, key: str) -> str:
    return (f"SELECT *, lead({a}) OVER w AS {a}2, lead({b}) OVER w AS {b}2 FROM ({source}) AS src WINDOW w AS (PARTITION BY {key} ORDER BY seq)")


@query(f"SELECT shape_id, {s6('sum(coalesce(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), 0))', 'length')} FROM ({_s_pairs('SELECT * FROM [shapes_xy]', 'x', 'y', 'shape_id')}) AS p GROUP BY shape_id")
def perimeter(spark, d):
    return lines.line_length(derive(spark, d, "shapes_xy"), ["shape_id"]).select("shape_id", r6("length"))


@query(f"SELECT route_id, round(sum(coalesce({_STEP}, 0)), 3) AS length_m FROM ({_s_pairs('SELECT * FROM [lines]', 'lat', 'lon', 'route_id')}) AS p GROUP BY route_id")
def ground_length(spark, d):
    step = lines.ground_step(geo.OUTLINE_RADIUS_M, False)
    measured = lines.line_length(derive(spark, d, "lines"), ["route_id"], ("lat", "lon"), step, "length_m")
    return measured.select("route_id", F.round("length_m", 3).alias("length_m"))


_BOX = "SELECT route_id, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM [lines] GROUP BY route_id"


@query(f"""SELECT route_id, {s6('s - 200 / 111000.0', 'south')}, {s6('n + 200 / 111000.0', 'north')},
             {s6('w - 200 / (111000.0 * greatest(cos(radians((s + n) / 2)), 1e-6))', 'west')},
             {s6('e + 200 / (111000.0 * greatest(cos(radians((s + n) / 2)), 1e-6))', 'east')} FROM ({_BOX}) AS b""")
def padded_box(spark, d):
    return lines.padded_box(derive(spark, d, "lines"), ["route_id"]).select(
        "route_id", *[r6(c) for c in ("south", "north", "west", "east")]
    )


@query(f"""SELECT route_id, round({s_hav('s', 'w', 'n', 'e', '6371008.8')}, 3) AS diagonal_m, {s6('(s + n) / 2', 'lat0')},
             {s6('(w + e) / 2', 'lon0')}, {s6('s', 'min_lat')}, {s6('e', 'max_lon')} FROM ({_BOX}) AS b""")
def line_boxes(spark, d):
    rows = derive(spark, d, "lines")
    joined = lines.box_diagonal(rows, ["route_id"]).join(lines.shared_origin(rows, ["route_id"]), "route_id").join(
        lines.line_box(rows, ["route_id"]), "route_id"
    )
    return joined.select(
        "route_id", F.round("diagonal_m", 3).alias("diagonal_m"), r6("lat0"), r6("lon0"), r6("min_lat"), r6("max_lon")
    )


def _s_resample(source: str, key: str, n: str) -> str:
    cols = f"{key}, {n} AS n" if not n.isdigit() else f"{key}, {n} AS n"
    return f"""
        WITH seg AS (SELECT {cols}, seq, x, y, x2, y2, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len
                     FROM ({_s_pairs(source, 'x', 'y', key)}) AS p),
             cum AS (SELECT *, sum(coalesce(len, 0)) OVER (PARTITION BY {key} ORDER BY seq) AS fin,
                       sum(coalesce(len, 0)) OVER (PARTITION BY {key}) AS total, max(seq) OVER (PARTITION BY {key}) AS last FROM seg),
             want AS (SELECT DISTINCT {key}, n, total, unnest(range(n)) AS i FROM cum)
        SELECT {key.replace(', ', ', ')}, i AS seq, x + share * coalesce(x2 - x, 0) AS x, y + share * coalesce(y2 - y, 0) AS y FROM (
          SELECT w.*, c.x, c.y, c.x2, c.y2, CASE WHEN w.i = 0 OR w.i = w.n - 1 THEN 0.0 ELSE (w.i * w.total / (w.n - 1) - (c.fin - c.len)) / c.len END AS share,
            row_number() OVER (PARTITION BY {', '.join('w.' + k.strip() for k in key.split(','))}, w.i ORDER BY c.seq) AS k
          FROM want AS w JOIN cum AS c USING ({key})
          WHERE CASE WHEN w.i = 0 THEN c.seq = 0 WHEN w.i = w.n - 1 THEN c.seq = c.last ELSE c.len > 0 AND c.fin >= w.i * w.total / (w.n - 1) - 1e-9 END) AS r
        WHERE k = 1"""


@query(f"SELECT shape_id, seq, {s6('x', 'x')}, {s6('y', 'y')} FROM ({_s_resample('SELECT * FROM [shapes_xy]', 'shape_id', '25')}) AS r")
def resample(spark, d):
    return lines.resample(derive(spark, d, "shapes_xy"), ["shape_id"], 25).select("shape_id", "seq", r6("x"), r6("y"))


def s_densify(source: str, step: int = 25) -> str:
    return f"""
        SELECT route_id, seq, part, lat + (lat2 - lat) * part / n AS lat, lon + (lon2 - lon) * part / n AS lon FROM (
          SELECT *, unnest(range(1, n + 1)) AS part FROM (SELECT *, CAST(greatest(1, ceil({_STEP} / {step})) AS BIGINT) AS n
            FROM ({_s_pairs(source, 'lat', 'lon', 'route_id')}) AS p WHERE lat2 IS NOT NULL) AS q) AS e
        UNION ALL SELECT route_id, seq, 0, lat, lon FROM ({source}) AS f WHERE seq = 0"""


@query(f"SELECT route_id, seq, part, {s6('lat', 'lat')}, {s6('lon', 'lon')} FROM ({s_densify('SELECT * FROM [lines]')}) AS d")
def densify(spark, d):
    rows = lines.densify(derive(spark, d, "lines"), ["route_id"], 25.0)
    return rows.select("route_id", "seq", F.col("part").cast("long").alias("part"), r6("lat"), r6("lon"))


@query(f"""WITH RECURSIVE step AS (SELECT *, {s_hav('lat', 'lon', 'lat2', 'lon2', '6371000.0', True)} AS d FROM ({_s_pairs('SELECT * FROM [lines]', 'lat', 'lon', 'route_id')}) AS p),
             walk AS (SELECT route_id, seq, lat, lon, true AS kept, 0.0::DOUBLE AS acc FROM step WHERE seq = 0
                      UNION ALL SELECT s.route_id, s.seq + 1, s.lat2, s.lon2, w.acc + s.d >= 60.0, CASE WHEN w.acc + s.d >= 60.0 THEN 0.0 ELSE w.acc + s.d END
                      FROM walk AS w JOIN step AS s ON s.route_id = w.route_id AND s.seq = w.seq WHERE s.lat2 IS NOT NULL)
           SELECT route_id, {s6('lat', 'lat')}, {s6('lon', 'lon')} FROM (SELECT *, max(seq) OVER (PARTITION BY route_id) AS last FROM walk) AS w
           WHERE kept OR seq = last""")
def downsample(spark, d):
    records = lines.as_lines(derive(spark, d, "lines"), ["route_id"]).withColumn(
        "line", lines.downsample(F.col("line"), 60.0)
    )
    return lines.as_points(records, ["route_id"]).select("route_id", r6("lat"), r6("lon"))


# --- nearest neighbours and similarity --------------------------------------------------------------------------

_PROBES = "SELECT query_id AS src_id, 51 + (lat - 50) / 100 AS lat, (lon + 4) / 100 AS lon FROM [spots]"


@query(f"""SELECT src_id, arg_min(id, row(round(dist, 6), id)) AS node, round(min(dist), 3) AS distance_m FROM (
             SELECT q.src_id, r.id, {s_hav('q.lat', 'q.lon', 'r.lat', 'r.lon', '6371000.0', True)} AS dist FROM ({_PROBES}) AS q CROSS JOIN [nodes] AS r) AS c
           GROUP BY src_id""")
def snap_to_nodes(spark, d):
    snapped = nearest.snap_to_nodes(derive(spark, d, _PROBES), derive(spark, d, "nodes"))
    return snapped.select("src_id", "node", F.round("distance_m", 3).alias("distance_m"))


def _s_mean_nearest(a: str, b: str) -> str:
    return f"""SELECT route_id, avg(best) AS m FROM (SELECT a.route_id, a.seq, a.part, min({s_hav('a.lat', 'a.lon', 'b.lat', 'b.lon', '6371008.8')}) AS best
               FROM ({a}) AS a JOIN ({b}) AS b ON b.route_id = a.route_id GROUP BY a.route_id, a.seq, a.part) AS n GROUP BY route_id"""


_PLAIN_A = "SELECT *, 0 AS part FROM [lines]"
_PLAIN_B = "SELECT *, 0 AS part FROM [lines_b]"


@query(f"SELECT route_id, round(m, 3) AS mean_nearest_m FROM ({_s_mean_nearest(_PLAIN_A, _PLAIN_B)}) AS n")
def mean_nearest(spark, d):
    found = nearest.mean_nearest(derive(spark, d, "lines"), derive(spark, d, "lines_b"), "route_id")
    return found.select("route_id", F.round("mean_nearest_m", 3).alias("mean_nearest_m"))


_DENSE_A, _DENSE_B = s_densify("SELECT * FROM [lines]"), s_densify("SELECT * FROM [lines_b]")


@query(f"""SELECT route_id, {s6(f"0.5 * (f.m + g.m) / {s_hav('s', 'w', 'n', 'e', '6371008.8')}", 'fidelity')} FROM ({_s_mean_nearest(_DENSE_A, _DENSE_B)}) AS f
           JOIN ({_s_mean_nearest(_DENSE_B, _DENSE_A)}) AS g USING (route_id) JOIN ({_BOX}) AS b USING (route_id)""")
def shape_fidelity(spark, d):
    scored = similarity.shape_fidelity(derive(spark, d, "lines"), derive(spark, d, "lines_b"), "route_id")
    return scored.select("route_id", r6("fidelity"))


@query()
def discrete_frechet(spark, d):
    return similarity.discrete_frechet(derive(spark, d, "lines"), derive(spark, d, "lines_b"), "route_id")


_UNION_BOX = ("SELECT route_id, (min(lat) + max(lat)) / 2 AS lat0, (min(lon) + max(lon)) / 2 AS lon0 FROM "
              "(SELECT route_id, lat, lon FROM [lines] UNION ALL SELECT route_id, lat, lon FROM [lines_b]) AS u GROUP BY route_id")


def _s_swept(source: str, side: int) -> str:
    local = f"SELECT l.route_id, seq, radians(lon - lon0) * 6371000.0 * cos(radians(lat0)) AS x, radians(lat - lat0) * 6371000.0 AS y FROM [{source}] AS l JOIN ({_UNION_BOX}) AS o ON o.route_id = l.route_id"
    disc = "CASE WHEN abs(h - {y}) <= 20 THEN {x} {s} sqrt(greatest(0, 400 - (h - {y}) * (h - {y}))) END"
    edge = "CASE WHEN y <> y2 AND (h - (y {s} ny)) / (y2 - y) BETWEEN 0 AND 1 THEN x {s} nx + (h - (y {s} ny)) / (y2 - y) * (x2 - x) END"
    lo = ", ".join([disc.format(x=x, y=y, s="-") for x, y in (("x", "y"), ("x2", "y2"))] + [edge.format(s=s) for s in "+-"])
    hi = ", ".join([disc.format(x=x, y=y, s="+") for x, y in (("x", "y"), ("x2", "y2"))] + [edge.format(s=s) for s in "+-"])
    return f"""
        SELECT route_id, k, {side} AS side, least({lo}) AS lo, greatest({hi}) AS hi FROM (
          SELECT *, (k + 0.5) * 2.5 AS h, -(y2 - y) / len * 20 AS nx, (x2 - x) / len * 20 AS ny FROM (
            SELECT *, nullif(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), 0) AS len,
              unnest(range(CAST(ceil((least(y, y2) - 20) / 2.5 - 0.5) AS BIGINT), CAST(floor((greatest(y, y2) + 20) / 2.5 - 0.5) AS BIGINT) + 1)) AS k
            FROM ({_s_pairs(local, 'x', 'y', 'route_id')}) AS p WHERE x2 IS NOT NULL) AS s) AS t"""


@query(f"""SELECT route_id, round(sum(CASE WHEN ina AND inb THEN w ELSE 0 END) / sum(CASE WHEN ina OR inb THEN w ELSE 0 END), 5) AS iou FROM (
             SELECT route_id, lead(x) OVER v - x AS w, sum(da) OVER u > 0 AS ina, sum(db) OVER u > 0 AS inb FROM (
               SELECT route_id, k, x, sum(CASE WHEN side = 1 THEN step ELSE 0 END) AS da, sum(CASE WHEN side = 2 THEN step ELSE 0 END) AS db FROM (
                 SELECT route_id, k, side, lo AS x, 1 AS step FROM s WHERE lo < hi UNION ALL SELECT route_id, k, side, hi, -1 FROM s WHERE lo < hi) AS e
               GROUP BY route_id, k, x) AS g WINDOW v AS (PARTITION BY route_id, k ORDER BY x), u AS (PARTITION BY route_id, k ORDER BY x ROWS UNBOUNDED PRECEDING)) AS z
           GROUP BY route_id""".replace("FROM s WHERE", f"FROM ({_s_swept('lines', 1)} UNION ALL {_s_swept('lines_b', 2)}) AS s WHERE"))
def buffered_iou(spark, d):
    found = similarity.buffered_iou(derive(spark, d, "lines"), derive(spark, d, "lines_b"), "route_id")
    return found.select("route_id", F.round("iou", 5).alias("iou"))


@query()
def line_fidelity(spark, d):
    return similarity.fidelity(derive(spark, d, "lines_b"), derive(spark, d, "lines"), "route_id")


# --- street graph -----------------------------------------------------------------------------------------------

# One node pair per graph node: a row further and up to three columns along.
_NODE_PAIRS = "SELECT a.id AS u, b.id AS v FROM [nodes] AS a JOIN [nodes] AS b ON b.id = a.id + 50 + a.id % 3 WHERE a.id % 50 + a.id % 3 < 50"
_NODE_WALKS = "SELECT CAST(floor(id / 7) AS BIGINT) AS walk_id, id % 7 AS seq, id AS node FROM [nodes]"


@query(f"""SELECT walk_id, sum(coalesce(e.length, 0)) AS length_m FROM (SELECT *, lead(node) OVER (PARTITION BY walk_id ORDER BY seq) AS nxt
             FROM ({_NODE_WALKS}) AS w) AS p LEFT JOIN (SELECT u, v, min(length) AS length FROM (SELECT * FROM [edges] UNION ALL
               SELECT u, v, length + 20 FROM [edges]) AS m GROUP BY u, v) AS e ON e.u = p.node AND e.v = p.nxt GROUP BY walk_id""")
def path_length(spark, d):
    edges = derive(spark, d, "SELECT * FROM [edges] UNION ALL SELECT u, v, length + 20 FROM [edges]")
    return graph.path_length(derive(spark, d, _NODE_WALKS), edges, ["walk_id"])


@query(f"""WITH RECURSIVE pairs AS ({_NODE_PAIRS}), sp(src, dst, node, dist) USING KEY (src, dst, node) AS (
             SELECT u, v, u, 0.0::DOUBLE FROM pairs
             UNION SELECT s.src, s.dst, e.v, min(s.dist + e.length) FROM sp AS s JOIN [edges] AS e ON e.u = s.node
             LEFT JOIN recurring.sp AS r ON r.src = s.src AND r.dst = s.dst AND r.node = e.v
             WHERE s.dist + e.length < coalesce(r.dist, 1000.0) AND s.node <> s.dst GROUP BY s.src, s.dst, e.v)
           SELECT p.u, p.v, sp.dist FROM pairs AS p LEFT JOIN sp ON sp.src = p.u AND sp.dst = p.v AND sp.node = p.v""")
def shortest_paths(spark, d):
    return graph.shortest_paths(derive(spark, d, _NODE_PAIRS), derive(spark, d, "edges")).select("u", "v", "dist")


# Routes by way of three nodes, each leg one of the node pairs.
_CHAIN = f"SELECT p.u AS route_id, p.u AS a, p.v AS b, q.v AS c FROM ({_NODE_PAIRS}) AS p JOIN ({_NODE_PAIRS}) AS q ON q.u = p.v"
_STOPS = " UNION ALL ".join(
    f"SELECT route_id, CAST({i} AS BIGINT) AS seq, lat, lon FROM ({_CHAIN}) AS c{i} JOIN [nodes] AS n{i} ON n{i}.id = c{i}.{stop}" for i, stop in enumerate("abc"))


@query(f"""WITH RECURSIVE pairs AS ({_NODE_PAIRS}), sp(src, dst, node, dist) USING KEY (src, dst, node) AS (
             SELECT u, v, u, 0.0::DOUBLE FROM pairs
             UNION SELECT s.src, s.dst, e.v, min(s.dist + e.length) FROM sp AS s JOIN [edges] AS e ON e.u = s.node
             LEFT JOIN recurring.sp AS r ON r.src = s.src AND r.dst = s.dst AND r.node = e.v
             WHERE s.dist + e.length < coalesce(r.dist, 1000.0) AND s.node <> s.dst GROUP BY s.src, s.dst, e.v)
           SELECT route_id, x.dist + y.dist AS distance_m, {s6('f.lat', 'from_lat')}, {s6('f.lon', 'from_lon')}, {s6('t.lat', 'to_lat')}, {s6('t.lon', 'to_lon')}
           FROM ({_CHAIN}) AS c JOIN sp AS x ON x.src = a AND x.dst = b AND x.node = b JOIN sp AS y ON y.src = b AND y.dst = c AND y.node = c
           JOIN [nodes] AS f ON f.id = a JOIN [nodes] AS t ON t.id = c""")
def graph_routes(spark, d):
    routed = routers.graph_router(derive(spark, d, "nodes"), derive(spark, d, "edges"))(derive(spark, d, _STOPS))
    ends = [how(F.struct("lat", "lon"), "seq").alias(name) for how, name in ((F.min_by, "f"), (F.max_by, "t"))]
    return routed.groupBy("route_id").agg(F.max("distance_m").alias("distance_m"), *ends).select(
        "route_id", "distance_m", r6("f.lat", "from_lat"), r6("f.lon", "from_lon"), r6("t.lat", "to_lat"), r6("t.lon", "to_lon"))


# Customers' orders as waypoints; the stored answer of a request is the line from its first point to its last.
_VISITS = """SELECT o_custkey AS route_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq,
             50 + CAST(o_orderkey % 1000 AS DOUBLE) / 1000 AS lat, CAST((o_orderkey * 7) % 400 AS DOUBLE) / 100 - 2 AS lon FROM {orders}"""
_ENDS = f"SELECT route_id, count(*) AS n, min_by(lat, seq) AS lat1, min_by(lon, seq) AS lon1, max_by(lat, seq) AS lat2, max_by(lon, seq) AS lon2 FROM ({_VISITS}) AS v GROUP BY route_id"


@query(f"""SELECT route_id, CAST(i AS BIGINT) AS seq, {s6('CASE WHEN i = 0 THEN lat1 ELSE lat2 END', 'lat')}, {s6('CASE WHEN i = 0 THEN lon1 ELSE lon2 END', 'lon')}, CAST(n * 10 AS DOUBLE) AS distance_m
           FROM ({_ENDS}) AS e CROSS JOIN (VALUES (0), (1)) AS o(i) WHERE n >= 2 AND route_id % 7 <> 0""")
def stored_routes(spark, d):
    visits = derive(spark, d, _VISITS)
    line = F.array(F.array("lon1", "lat1"), F.array("lon2", "lat2"))
    route = F.struct(F.struct(line.alias("coordinates")).alias("geometry"), (F.col("n") * 10.0).alias("distance"), F.lit(1.0).alias("duration"))
    body = F.when(F.col("route_id") % 7 == 0, '{"code":"NoRoute"}').otherwise(F.to_json(F.struct(F.lit("Ok").alias("code"), F.array(route).alias("routes"))))
    answers = routers.request_texts(visits).join(derive(spark, d, _ENDS), "route_id").select("request", body.alias("body"))
    return routers.stored_router(answers)(visits).select("route_id", "seq", r6("lat"), r6("lon"), "distance_m")


_STEPS = """SELECT CAST(floor(id / 9) AS BIGINT) AS route_id, id % 9 AS seq, id AS u, CASE WHEN id % 5 = 0 THEN id ELSE id + 1 END AS v,
            CASE WHEN id % 7 = 3 THEN 0 ELSE 1 END AS ok FROM [nodes]"""


@query(f"""SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY seq, i) - 1 AS seq, nodes[i] AS node FROM (
             SELECT *, unnest(range(1, len(nodes) + 1)) AS i FROM (
               SELECT route_id, seq, CASE WHEN lag(v) OVER (PARTITION BY route_id ORDER BY seq) = u THEN [-u, v] ELSE [u, -u, v] END AS nodes
               FROM ({_STEPS}) AS s WHERE u <> v AND ok = 1) AS w) AS n""")
def stitch_paths(spark, d):
    steps = derive(spark, d, _STEPS).withColumn("path", F.when(F.col("ok") == 1, F.array("u", -F.col("u"), "v")))
    return graph.stitch_paths(steps, "route_id").select("route_id", "seq", "node")


@query()
def map_match(spark, d):
    rows = derive(spark, d, "SELECT route_id, seq, 51 + CAST(route_id % 25 + seq AS DOUBLE) / 1000 AS lat, "
                            "CAST(route_id % 40 AS DOUBLE) * 16 / 10000 + CAST(seq % 3 AS DOUBLE) / 10000 AS lon FROM [lines]")
    return graph.map_match(rows, derive(spark, d, "nodes"), derive(spark, d, "edges"), "route_id")[0]


# --- rasters ----------------------------------------------------------------------------------------------------

_CROSS = "(VALUES (0, -1), (-1, 0), (0, 0), (1, 0), (0, 1)) AS o(dx, dy)"
_SIZE = "SELECT image_id, max(x) AS mx, max(y) AS my FROM [pixels] GROUP BY image_id"
_GROWN = (f"SELECT DISTINCT m.image_id, m.x + o.dx AS x, m.y + o.dy AS y FROM ({S_STROKE}) AS m CROSS JOIN {_CROSS} "
          f"JOIN ({_SIZE}) AS z ON z.image_id = m.image_id WHERE m.x + o.dx BETWEEN 0 AND mx AND m.y + o.dy BETWEEN 0 AND my")
_CLOSED = f"""
    SELECT p.image_id, p.x, p.y FROM [pixels] AS p JOIN ({_SIZE}) AS z ON z.image_id = p.image_id CROSS JOIN {_CROSS}
    LEFT JOIN ({_GROWN}) AS g ON g.image_id = p.image_id AND g.x = p.x + o.dx AND g.y = p.y + o.dy
    GROUP BY p.image_id, p.x, p.y
    HAVING count(*) FILTER (g.x IS NULL AND p.x + o.dx BETWEEN 0 AND mx AND p.y + o.dy BETWEEN 0 AND my) = 0"""


def _stroke(spark, d):
    pixels = derive(spark, d, "pixels")
    return raster.stroke_mask(pixels), raster.image_sizes(pixels)


@query(_CLOSED)
def morph_close(spark, d):
    return raster.morph_close(*_stroke(spark, d))


_DEGREE = f"""SELECT a.image_id, a.x, a.y, count(b.x) AS degree FROM ({S_STROKE}) AS a LEFT JOIN ({S_STROKE}) AS b ON b.image_id = a.image_id
              AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY a.image_id, a.x, a.y"""


@query(_DEGREE)
def pixel_degree(spark, d):
    return raster.pixel_degree(_stroke(spark, d)[0])


# Lines of one pixel: those of the whole stroke without a stroke pixel to their left.
_EDGE = f"(SELECT a.image_id, a.x, a.y FROM ({S_STROKE}) AS a ANTI JOIN ({S_STROKE}) AS b ON b.image_id = a.image_id AND b.x = a.x - 1 AND b.y = a.y)"


@query(f"SELECT image_id, x, y FROM ({_DEGREE.replace(f'({S_STROKE})', _EDGE)}) AS g WHERE degree = 1")
def endpoints(spark, d):
    mask = _stroke(spark, d)[0]
    beside = mask.select("image_id", (F.col("x") + 1).alias("x"), "y")
    return raster.endpoints(mask.join(beside, ["image_id", "x", "y"], "left_anti"))


@query(f"""WITH RECURSIVE m AS ({S_STROKE}), reach AS (SELECT image_id, x AS rx, y AS ry, x, y FROM m
             UNION SELECT r.image_id, r.rx, r.ry, m.x, m.y FROM reach AS r JOIN m ON m.image_id = r.image_id AND abs(m.x - r.x) <= 1 AND abs(m.y - r.y) <= 1),
             root AS (SELECT image_id, rx AS x, ry AS y, min(y * 100 + x) AS root, count(*) AS area FROM reach GROUP BY image_id, rx, ry)
           SELECT image_id, x, y FROM (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY area DESC, root) AS n FROM root) AS r WHERE n = 1 AND area >= 100""")
def largest_component(spark, d):
    return raster.largest_component(_stroke(spark, d)[0], 100)


@query()
def stroke_to_polyline(spark, d):
    mask, sizes = _stroke(spark, d)
    return raster.stroke_to_polyline(raster.clean_mask(mask, sizes, 100))


# --- routes -----------------------------------------------------------------------------------------------------

_REASONS = """
    SELECT request_id, array_to_string(list_filter([
      CASE WHEN shape NOT IN (SELECT shape FROM [outlines]) THEN 'shape' END, CASE WHEN lat NOT BETWEEN -90 AND 90 THEN 'lat' END,
      CASE WHEN distance_km <= 0 OR distance_km > 50 THEN 'distance_km' END, CASE WHEN waypoints NOT BETWEEN 10 AND 80 THEN 'waypoints' END,
      CASE WHEN search_radius_km <= 0 OR search_radius_km > 200 THEN 'search_radius_km' END], lambda r: r IS NOT NULL), ',') AS reasons FROM [requests]"""


@query(f"SELECT request_id, reasons FROM ({_REASONS}) AS r")
def split_requests(spark, d):
    good, bad = routes.split_requests(derive(spark, d, "requests"), derive(spark, d, "outlines"))
    return good.select("request_id", F.lit("").alias("reasons")).unionByName(
        bad.select("request_id", F.array_join("reasons", ",").alias("reasons"))
    )


# The requests that split_requests lets through, rule by rule; a request without a radius is valid.
_VALID = ("SELECT * FROM [requests] WHERE shape <> 'yak' AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND distance_km > 0 AND distance_km <= 50 "
          "AND waypoints BETWEEN 10 AND 80 AND (search_radius_km IS NULL OR (search_radius_km > 0 AND search_radius_km <= 200))")


def _valid(spark, d):
    return routes.split_requests(derive(spark, d, "requests"), derive(spark, d, "outlines"))[0]


def _centres(n: str = "candidates") -> str:
    return f"""SELECT *, CASE WHEN c = 0 THEN lat ELSE lat + search_radius_km / 2 * sin(2 * pi() * (c - 1) / greatest({n} - 1, 1)) / 111.32 END AS centre_lat,
                 CASE WHEN c = 0 THEN lon ELSE lon + search_radius_km / 2 * cos(2 * pi() * (c - 1) / greatest({n} - 1, 1)) / (111.32 * cos(radians(lat))) END AS centre_lon
               FROM (SELECT *, unnest(range(CASE WHEN search_radius_km > 0 THEN {n} ELSE 1 END)) AS c FROM ({_VALID}) AS v) AS u"""


@query(f"SELECT request_id, c AS centre_no, {s6('centre_lat', 'lat')}, {s6('centre_lon', 'lon')} FROM ({_centres()}) AS c")
def candidate_centres(spark, d):
    rows = _valid(spark, d).select("request_id", F.posexplode(routes.candidate_centres(
        F.col("lat"), F.col("lon"), F.col("search_radius_km"), F.col("candidates"))).alias("centre_no", "c"))
    return rows.select("request_id", F.col("centre_no").cast("long").alias("centre_no"), r6("c.lat", "lat"), r6("c.lon", "lon"))


_SCALE = "distance_km * 1000 / 1.3 / {p} * CASE WHEN scales = 1 THEN 1.0 ELSE 0.6 * pow(5.0, s / greatest(scales - 1, 1)::DOUBLE) END"


@query(f"SELECT request_id, s AS scale_no, {s6(_SCALE.format(p='100'), 'scale')} FROM (SELECT *, unnest(range(scales)) AS s FROM ({_VALID}) AS v) AS u")
def candidate_scales(spark, d):
    rows = _valid(spark, d).select("request_id", F.posexplode(routes.candidate_scales(
        F.col("distance_km") * 1000.0, F.lit(100.0), F.col("scales"))).alias("scale_no", "scale"))
    return rows.select("request_id", F.col("scale_no").cast("long").alias("scale_no"), r6("scale"))


_DRAWN = _s_resample(f"SELECT o.shape, v.waypoints, o.seq, o.x, o.y FROM [outlines] AS o JOIN (SELECT DISTINCT shape, waypoints FROM ({_VALID}) AS v0) AS v ON v.shape = o.shape",
                     "shape, waypoints", "waypoints")
_PERIMETER = (f"SELECT shape, waypoints, sum(coalesce(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), 0)) AS perimeter, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy "
              f"FROM ({_s_pairs(_DRAWN, 'x', 'y', 'shape, waypoints')}) AS p GROUP BY shape, waypoints")
_GRID = f"""SELECT g.request_id, g.shape, g.waypoints, c * scales + s AS candidate_no, centre_lat, centre_lon, {_SCALE.format(p='perimeter')} AS scale, cx, cy
            FROM (SELECT *, unnest(range(scales)) AS s FROM ({_centres()}) AS c0) AS g JOIN ({_PERIMETER}) AS p ON p.shape = g.shape AND p.waypoints = g.waypoints"""


def _grid(spark, d):
    requests, outlines = _valid(spark, d), derive(spark, d, "outlines")
    sampled = routes.sampled_outlines(requests, outlines)
    return routes.candidate_grid(requests, sampled), sampled


@query(f"SELECT request_id, candidate_no, {s6('centre_lat', 'centre_lat')}, {s6('centre_lon', 'centre_lon')}, round(scale, 4) AS scale FROM ({_GRID}) AS g")
def candidate_grid(spark, d):
    return _grid(spark, d)[0].select(
        "request_id", F.col("candidate_no").cast("long").alias("candidate_no"), r6("centre_lat"), r6("centre_lon"),
        F.round("scale", 4).alias("scale"),
    )


@query(f"""SELECT request_id, candidate_no, d.seq, {s6('centre_lat + (d.y - cy) * scale / 111320.0', 'lat')},
             {s6('centre_lon + (d.x - cx) * scale / (111320.0 * cos(radians(centre_lat)))', 'lon')}
           FROM ({_GRID}) AS g JOIN ({_DRAWN}) AS d ON d.shape = g.shape AND d.waypoints = g.waypoints""")
def project_shape(spark, d):
    rows = routes.candidate_waypoints(*_grid(spark, d))
    return rows.select("request_id", F.col("candidate_no").cast("long").alias("candidate_no"), "seq", r6("lat"), r6("lon"))


_SCORED = """SELECT o_custkey AS request_id, o_orderkey AS candidate_no, CASE WHEN o_orderstatus = 'P' THEN NULL
             ELSE floor(o_totalprice / 1000) END AS fidelity FROM {orders}"""


@query(f"""SELECT request_id, candidate_no, fidelity FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY fidelity, candidate_no) AS n
           FROM ({_SCORED}) AS s WHERE fidelity IS NOT NULL) AS b WHERE n = 1""")
def best_route_by_fidelity(spark, d):
    return routes.best_route_by_fidelity(derive(spark, d, _SCORED).withColumn("fidelity", F.col("fidelity").cast("double")))


_ITERATIONS = "SELECT o_custkey AS request_id, o_orderkey AS iteration, floor(o_totalprice / 1000) AS distance_m, CAST(150 AS DOUBLE) AS target_m FROM {orders}"


@query(f"""SELECT request_id, iteration, {s6('err', 'error')} FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY err, iteration) AS n
           FROM (SELECT *, abs(distance_m - target_m) / target_m AS err FROM ({_ITERATIONS}) AS i) AS e) AS b WHERE n = 1""")
def best_iteration(spark, d):
    return routes.best_iteration(derive(spark, d, _ITERATIONS)).select("request_id", "iteration", r6("error"))


def _detour_router(waypoints):
    """Stands for a routing service: walks the waypoints with a detour and refuses some routes."""
    measured = lines.line_length(waypoints, ["route_id"], ("lat", "lon"), lines.ground_step(geo.OUTLINE_RADIUS_M, False))
    detour = 1.05 + F.pmod(F.xxhash64("route_id"), F.lit(50)) / 100.0
    kept = measured.filter(F.pmod(F.crc32("route_id"), F.lit(9)) != 0)
    bent = waypoints.withColumn("lat", F.col("lat") + F.pmod(F.col("seq"), F.lit(3)) / 20000.0)
    return bent.join(kept.select("route_id", (F.col("length") * detour).alias("distance_m")), "route_id")


@query()
def search_routes(spark, d):
    best, lost = routes.search_routes(_valid(spark, d), derive(spark, d, "outlines"), _detour_router)
    return best.select("request_id", "candidate_no", "distance_m", "fidelity").unionByName(
        lost.select("request_id"), allowMissingColumns=True
    )


@query()
def rescale_iterate(spark, d):
    best, lost = routes.rescale_iterate(_valid(spark, d), derive(spark, d, "outlines"), _detour_router)
    return best.select("request_id", "iteration", "distance_m", "error").unionByName(
        lost.select("request_id"), allowMissingColumns=True
    )


@query()
def generate_routes(spark, d):
    """Requests moved to where the streets are and made as short as those; every request ends as a route or a reject."""
    near = "51 + CAST(request_id * 37 % 300 AS DOUBLE) / 100000 + CASE WHEN request_id % 11 = 0 THEN 60 ELSE 0 END"
    asked = derive(spark, d, "requests").withColumns({
        "lat": F.expr(near), "lon": F.expr("CAST(request_id * 71 % 700 AS DOUBLE) / 10000"), "distance_km": F.col("distance_km") / 20,
        "search_radius_km": F.col("search_radius_km") / 20})
    router = routers.graph_router(derive(spark, d, "nodes"), derive(spark, d, "edges"))
    made, rejects = generation.generate_routes(asked, derive(spark, d, "outlines"), router, "2024-01-01T00:00:00Z")
    shown = made.select(
        "request_id", F.lit(200).alias("status"), F.round("routed_distance_m", 3).alias("routed_distance_m"), r6("error_pct"), r6("fidelity"), r6("chosen_lat"),
        r6("chosen_lon"), F.size("line").alias("points"), F.length("gpx").alias("gpx_chars"), F.length("kml").alias("kml_chars"))
    return shown.unionByName(rejects.select("request_id", "status", "reason"), allowMissingColumns=True)
