import math
import random

from pyspark.sql import functions as F

from routewright.functions import geo
from routewright.sources import readers

NODE, EDGE = "id long, lat double, lon double", "u long, v long, length double"


def city(seed=5):
    """Two thirds of all nodes in one dense spot, some on the date line, some without a place, ids that repeat."""
    random.seed(seed)
    nodes = [(n, 51.5 + random.random() * 0.01, random.random() * 0.01) for n in range(1200)]
    nodes += [(n, random.uniform(-80, 80), random.uniform(-180, 180)) for n in range(1200, 1700)]
    nodes += [(n, 10 + random.random(), random.choice([-1, 1]) * (180 - random.random())) for n in range(1700, 1790)]
    nodes += [(1790, None, 1.0), (1791, 1.0, None), (None, 51.505, 0.005), (0, 51.505, 0.005)]
    edges = [(random.randrange(1850), random.randrange(1850), float(n)) for n in range(4000)] + [(1, 1, 0.0), (1, 2, 1.0), (1, 2, 1.0)]
    return nodes, edges + [(None, 3, 1.0), (3, None, 1.0)]


def inside(place, box):
    south, north, west, east = box
    lat, lon = place
    if lat is None or lon is None:
        return False
    return south <= lat <= north and (west <= lon <= east if west <= east else lon >= west or lon <= east)


def test_boxes_match_brute_force_and_dense_spots_are_split(spark, tmp_path):
    nodes, edges = city()
    path = str(tmp_path / "graph")
    readers.write_street_graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), path, file_bytes=24 * 100)
    held = spark.read.parquet(f"{path}/nodes").groupBy(F.input_file_name().alias("file")).agg(
        F.count("*").alias("n"), (F.max("lat") - F.min("lat")).alias("high"),
        F.count_if(F.col("lat").between(51.5, 51.51) & F.col("lon").between(0, 0.01)).alias("dense")).collect()
    assert sum(r["n"] for r in held) == len(nodes) and max(r["n"] for r in held) <= 100
    assert sum(r["dense"] > 0 for r in held) >= 12
    assert max(r["high"] for r in held if r["dense"] == r["n"]) < 0.011

    place = {}
    for n, lat, lon in nodes:
        key = ((lat is not None, lat or 0.0), (lon is not None, lon or 0.0))
        if n is not None and (n not in place or key < place[n][0]):
            place[n] = (key, (lat, lon))
    for box in [(51.502, 51.507, 0.002, 0.006), (-90, 90, -180, 180), (10, 11, 179.2, -179.2), (0, 0.1, 0, 0.1), (-60, 20, -100, 90)]:
        got_nodes, got_edges = readers.read_street_graph(spark, path, *box)
        assert sorted(map(repr, map(tuple, got_nodes.collect()))) == sorted(repr(n) for n in nodes if inside(n[1:], box))
        want = [e for e in edges if all(end in place and inside(place[end][1], box) for end in e[:2])]
        assert sorted(map(tuple, got_edges.collect())) == sorted(want)
        plan = got_edges._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "GreaterThanOrEqual(u_lat" in plan


def test_empty_graph(spark, tmp_path):
    path = str(tmp_path / "graph")
    readers.write_street_graph(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE), path)
    nodes, edges = readers.read_street_graph(spark, path, -90, 90, -180, 180)
    assert (nodes.columns, edges.columns) == (["id", "lat", "lon"], ["u", "v", "length"])
    assert nodes.count() == edges.count() == 0


def test_curve_place_takes_bits_in_turn(spark):
    def place(lat, lon):
        y, x = (min((1 << 21) - 1, max(0, math.floor(v * (1 << 21)))) for v in ((lat + 90) / 180, (lon + 180) / 360))
        return sum((y >> b & 1) << 2 * b + 1 | (x >> b & 1) << 2 * b for b in range(21))

    points = [(0.0, 0.0), (51.5, -0.1), (-90.0, -180.0), (90.0, 180.0), (12.34, 179.99), (95.0, -200.0), (-33.8, 151.2)]
    rows = spark.createDataFrame(points + [(None, 1.0), (1.0, None)], "lat double, lon double").select(
        geo.curve_place(F.col("lat"), F.col("lon"))).collect()
    assert [r[0] for r in rows] == [place(*p) for p in points] + [None, None]
