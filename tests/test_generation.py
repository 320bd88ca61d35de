import heapq
import json
import random

import pytest
from pyspark.sql import functions as F

from routewright.operators import routers, routes
from routewright.plans.generation import generate_routes
from tests.test_geometry import REQ, echo_router, outlines

POINTS = "route_id string, seq long, lat double, lon double"


def street_grid(spark, wide=8, seed=3):
    """Nodes, edges with random lengths (some one-way), and the same as plain dicts."""
    rng = random.Random(seed)
    places = {y * wide + x: (51 + y / 1000, x * 0.0016) for y in range(wide) for x in range(wide)}
    ways = {}
    for n in places:
        for m in ([n + 1] if (n + 1) % wide else []) + ([n + wide] if n + wide in places else []):
            ways[n, m] = float(rng.randint(50, 120))
            if rng.random() < 0.8:
                ways[m, n] = float(rng.randint(50, 120))
    places[900], places[901] = (51.5, 0.5), (51.5, 0.5016)
    nodes = spark.createDataFrame([(n, *p) for n, p in places.items()], "id long, lat double, lon double")
    edges = spark.createDataFrame([(u, v, d) for (u, v), d in ways.items()], "u long, v long, length double")
    return nodes, edges, places, ways


def plain_distance(ways, start, end):
    reached, queue = {}, [(0.0, start)]
    while queue:
        d, n = heapq.heappop(queue)
        if n in reached:
            continue
        reached[n] = d
        for (u, v), length in ways.items():
            if u == n and v not in reached:
                heapq.heappush(queue, (d + length, v))
    return reached.get(end)


def lines_of(routed):
    out = {}
    for r in routed.orderBy("route_id", "seq").collect():
        out.setdefault(r["route_id"], (r["distance_m"], []))[1].append((r["lat"], r["lon"]))
    return out


def test_graph_router_matches_plain_search(spark):
    nodes, edges, places, ways = street_grid(spark)
    rng = random.Random(5)
    stops = {f"r{i}": [rng.randrange(64) for _ in range(rng.randint(2, 5))] for i in range(12)}
    rows = [(k, i, places[n][0] + rng.uniform(-2e-4, 2e-4), places[n][1] + rng.uniform(-3e-4, 3e-4)) for k, ns in stops.items() for i, n in enumerate(ns)]
    rows += [("one", 0, 51.0, 0.0), ("null", 0, None, 0.0), ("null", 1, 51.0, 0.0), ("out", 0, 51.0, 0.0), ("out", 1, 99.0, 0.0)]
    rows += [("apart", 0, 51.0, 0.0), ("apart", 1, 51.5, 0.5), ("stay", 0, 51.0, 0.0), ("stay", 1, 51.0, 0.00001)]
    got = lines_of(routers.graph_router(nodes, edges)(spark.createDataFrame(rows, POINTS)))
    want = {}
    for k, ns in stops.items():
        parts = [plain_distance(ways, a, b) for a, b in zip(ns, ns[1:])]
        if None not in parts:
            want[k] = sum(parts)
    assert set(got) == set(want) | {"stay"} and got["stay"] == (0.0, [places[0]])
    number = {p: n for n, p in places.items()}
    for k, total in want.items():
        distance, line = got[k]
        walked = [number[p] for p in line]
        assert distance == pytest.approx(total)
        assert sum(ways[a, b] for a, b in zip(walked, walked[1:])) == pytest.approx(total)
        left = iter(walked)
        assert all(n in left for n in [n for i, n in enumerate(stops[k]) if i == 0 or n != stops[k][i - 1]])


def test_graph_router_refuses_far_waypoints_and_takes_empty_tables(spark):
    nodes, edges, *_ = street_grid(spark)
    rows = [("near", 0, 51.0, 0.0), ("near", 1, 51.0, 0.0016), ("far", 0, 51.0, 0.0), ("far", 1, 51.02, 0.0)]
    points = spark.createDataFrame(rows, POINTS)
    assert set(lines_of(routers.graph_router(nodes, edges, max_snap_m=200.0)(points))) == {"near"}
    assert routers.graph_router(nodes, edges)(points.limit(0)).count() == 0
    assert routers.graph_router(nodes.limit(0), edges)(points).count() == 0


def answer(distance, *line):
    return json.dumps({"code": "Ok", "routes": [{"geometry": {"coordinates": [[b, a] for a, b in line]}, "distance": distance, "duration": 1}]})


def test_stored_answers(spark):
    rows = [("a", 0, 51.0, 0.25), ("a", 1, 52.0, 1.0), ("b", 0, 51.0, 0.25), ("b", 1, 52.0, 1.0), ("c", 0, 51.0, 2.0), ("c", 1, 52.0, 2.0),
            ("d", 0, 10.0, 2.0), ("d", 1, 11.0, 2.0), ("e", 0, 10.0, 2.0)]
    points = spark.createDataFrame(rows, POINTS)
    asked = "0.250000,51.000000;1.000000,52.000000"
    kept = [(asked, answer(9.0, (51.0, 0.0), (52.0, 1.0))), (asked, answer(7.0, (51.0, 0.3), (51.5, 0.4), (52.0, 1.0))), (asked, "oops"),
            ("2.000000,51.000000;2.000000,52.000000", '{"code":"NoRoute"}')]
    answers = spark.createDataFrame(kept, "request string, body string")
    got = lines_of(routers.stored_router(answers)(points))
    assert got == {k: (7.0, [(51.0, 0.3), (51.5, 0.4), (52.0, 1.0)]) for k in "ab"}
    assert [r["request"] for r in routers.unanswered(points, answers).collect()] == ["2.000000,10.000000;2.000000,11.000000"]


def test_bad_counts_are_lost_one_by_one(spark):
    rows = [(1, "box", 51.0, 0.0, 10.0, 40, 5, 10.0, 0, 2), (2, "box", 40.0, 5.0, 5.0, 20, 5, 1.0, 1, 1), (3, "box", 40.0, 5.0, 5.0, 20, 5, 1.0, None, 1)]
    best, lost = routes.search_routes(spark.createDataFrame(rows, REQ), outlines(spark), echo_router(1.0))
    assert [r["request_id"] for r in best.collect()] == [2]
    assert {r["request_id"]: r["reason"] for r in lost.collect()} == dict.fromkeys((1, 3), "candidates and scales must be >= 1")


def test_every_request_ends_as_route_or_reject(spark):
    rows = [
        (1, "box", 51.003, 0.005, 1.0, 10, 2, None, 5, 3), (2, "box", 51.003, 0.005, 1.0, 12, 3, 0.5, 3, 2),
        (3, "yak", 51.0, 0.0, 1.0, 10, 3, None, 5, 3), (4, "yak", 95.0, 0.0, 1.0, 10, 3, None, 5, 3), (5, "box", 51.0, 0.0, 1.0, 10, 3, None, 99, 3),
        (6, "box", 20.0, 0.0, 1.0, 10, 3, None, 1, 1), (7, "box", 20.0, 0.0, 1.0, 10, 3, 3.0, 2, 1),
    ]
    nodes, edges, places, _ = street_grid(spark)
    both_ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length"))
    made, rejects = generate_routes(spark.createDataFrame(rows, REQ), outlines(spark), routers.graph_router(nodes, both_ways, 2000.0), "2024-01-01T00:00:00Z")
    got = {r["request_id"]: r for r in made.collect()}
    assert set(got) == {1, 2}
    for r in got.values():
        line = [tuple(p) for p in r["line"]]
        assert set(line) <= set(places.values()) and len(r["waypoints"]) == {1: 10, 2: 12}[r["request_id"]]
        assert json.loads(r["geojson"])["coordinates"] == [[b, a] for a, b in line]
        assert r["gpx"].count("<rtept") == r["gpx"].count("<trkpt") == len(line) and "<name>Box Run</name>" in r["kml"]
        assert r["error_pct"] == pytest.approx((r["routed_distance_m"] - 1000) / 10) and r["target_distance_m"] == 1000.0
        assert f"~{r['routed_distance_m'] / 1000:.2f} km" in r["gpx"]
    assert (got[1]["chosen_lat"], got[1]["chosen_lon"]) == (51.003, 0.005)
    assert {r["request_id"]: (r["status"], r["reason"]) for r in rejects.collect()} == {
        3: (404, "shape"), 4: (422, "shape,lat"), 5: (422, "candidates"), 6: (502, "the first routing failed"), 7: (502, "every candidate failed"),
    }
