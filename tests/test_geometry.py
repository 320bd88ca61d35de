import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from routewright.functions import geo, scores
from routewright.operators import crossref, georef, graph, lines, nearest, routes, similarity
from routewright.operators.components import connected_components
from routewright.operators.scans import number_rows, running


def hav(a, b, r):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * r * math.asin(min(1.0, math.sqrt(h)))


def test_cells_cover_the_disc(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        lat, lon = rng.uniform(-89.9, 89.9), rng.uniform(-180, 180)
        bearing, d = rng.uniform(0, 2 * math.pi), rng.uniform(0, 1.0)
        la, dd = math.radians(lat), math.radians(d)
        lat2 = math.asin(math.sin(la) * math.cos(dd) + math.cos(la) * math.sin(dd) * math.cos(bearing))
        lon2 = math.radians(lon) + math.atan2(
            math.sin(bearing) * math.sin(dd) * math.cos(la), math.cos(dd) - math.sin(la) * math.sin(lat2)
        )
        rows.append((lat, lon, math.degrees(lat2), (math.degrees(lon2) + 540) % 360 - 180))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for size in (0.3, 1.0, 2.5):
        inside = F.array_contains(
            geo.cells_within(F.col("a"), F.col("b"), F.lit(1.0001), size), geo.cell_id(F.col("c"), F.col("d"), size)
        )
        assert df.filter(~inside).count() == 0
        exploded = geo.explode_cells(df, F.col("a"), F.col("b"), F.lit(1.0001), size)
        arrays = df.select("*", F.explode(geo.cells_within(F.col("a"), F.col("b"), F.lit(1.0001), size)).alias("cell"))
        assert exploded.exceptAll(arrays).isEmpty() and arrays.exceptAll(exploded).isEmpty()


def test_running_and_numbers_match_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, rng.randint(-9, 9)])) for k in "ab" for i in range(57)]
    df = spark.createDataFrame(rows, "k string, i long, v int")
    for how, inclusive in (("sum", True), ("max", False), ("last", False)):
        got = running(df, ["k"], ["i"], F.col("v"), how, "r", F.floor(F.col("i") / 8), inclusive)
        got = {(r["k"], r["i"]): r["r"] for r in got.collect()}
        for k in "ab":
            values = [v for kk, _, v in rows if kk == k]
            for i in range(57):
                seen = [v for v in values[: i + inclusive] if v is not None]
                want = {"sum": sum(seen), "max": max(seen, default=None), "last": seen[-1] if seen else None}[how]
                assert got[k, i] == want
    shuffled = spark.createDataFrame([(p,) for p in rng.sample(range(10**6), 300)], "p long")
    numbered = number_rows(shuffled, "p", "n", F.lit(10), chunk=1000).orderBy("p").collect()
    assert [r["n"] for r in numbered] == list(range(11, 311))


def line_df(spark, named, cols=("lat", "lon")):
    rows = [(k, i, float(p[0]), float(p[1])) for k, pts in named.items() for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, f"k string, seq long, {cols[0]} double, {cols[1]} double")


def walk_resample(pts, n):
    cum = np.concatenate([[0], np.cumsum([math.dist(a, b) for a, b in zip(pts, pts[1:])])])
    targets = np.linspace(0, cum[-1], n)
    return [(np.interp(t, cum, [p[0] for p in pts]), np.interp(t, cum, [p[1] for p in pts])) for t in targets]


def test_resample_and_length(spark):
    rng = random.Random(1)
    named = {
        "a": [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(23)], "b": [(0, 0), (4, 0), (4, 4)],
        "c": [(1, 1), (1, 1)], "d": [(2, 3)],
    }
    df = line_df(spark, named, ("x", "y"))
    for chunk in (4096, 5):
        got = {}
        for r in lines.resample(df, ["k"], 11, chunk).orderBy("k", "seq").collect():
            got.setdefault(r["k"], []).append((r["x"], r["y"]))
        for k, pts in named.items():
            want = walk_resample(pts, 11) if k in "ab" else [pts[0]] * 11
            assert np.allclose(got[k], want), k
    lengths = {r["k"]: r["length"] for r in lines.line_length(df, ["k"]).collect()}
    assert lengths["b"] == 8 and lengths["c"] == 0 and lengths["d"] == 0
    with pytest.raises(ValueError):
        lines.resample(df, ["k"], 1)


def test_densify(spark):
    df = line_df(spark, {"a": [(0, 0), (0, 0.001), (0, 0.0011)]})
    got = lines.densify(df, ["k"], 50.0).orderBy("seq", "part").collect()
    assert [round(r["lon"], 6) for r in got] == [0, 0.000333, 0.000667, 0.001, 0.0011]
    assert lines.densify(df, ["k"], 0).count() == 3


def test_downsample_restarts_after_each_kept_vertex(spark):
    step = math.degrees(20 / 6371000.0)
    df = line_df(spark, {"a": [(i * step, 0) for i in range(8)], "b": [(1, 1)], "c": [(0, 0), (step, 0)]})
    out = lines.as_lines(df, ["k"]).select("k", lines.downsample(F.col("line"), 30.0).alias("w"))
    got = {r["k"]: [round(p["lat"] / step) for p in r["w"]] for r in out.collect()}
    assert got["a"] == [0, 2, 4, 6, 7] and got["c"] == [0, 1] and len(got["b"]) == 1


def test_nearest_matches_brute_force_near_and_far(spark):
    rng = random.Random(9)
    dst = [(i, 51 + rng.uniform(-0.02, 0.02), rng.uniform(-0.02, 0.02)) for i in range(80)]
    dst += [(100, -40.0, 179.95), (101, 88.0, 10.0)]
    src = [(i, 51 + rng.uniform(-0.03, 0.03), rng.uniform(-0.03, 0.03)) for i in range(60)]
    src += [(100, 10.0, 10.0), (101, -41.0, -179.9), (102, 89.5, -170.0), (103, 51.0, 3.0), (104, -89.0, 0.0)]
    s = spark.createDataFrame(src, "src_id long, lat double, lon double")
    t = spark.createDataFrame(dst, "id long, lat double, lon double")
    got = {r["src_id"]: (r["node"], r["distance_m"]) for r in nearest.snap_to_nodes(s, t).collect()}
    assert len(got) == len(src)
    for i, lat, lon in src:
        d, best = min((hav((lat, lon), (a, b), 6371000.0), j) for j, a, b in dst)
        assert got[i][0] == best and abs(got[i][1] - d) < 1e-3


def test_nearest_ties_are_those_of_six_decimals(spark):
    """The larger id is closer by less than a rounding step, near and far."""
    nodes = spark.createDataFrame([(1, 0.0, 0.001), (2, 0.0, -0.001 + 2e-13), (3, 40.0, 0.01), (4, 40.0, -0.01 + 2e-13)], "id long, lat double, lon double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 40.0, 0.0)], "src_id long, lat double, lon double")
    got = {r["src_id"]: r["node"] for r in nearest.snap_to_nodes(points, nodes).collect()}
    assert got == {1: 1, 2: 3}


def test_mean_nearest_and_shape_fidelity(spark):
    square = [(0, 0), (0, 0.01), (0.01, 0.01), (0.01, 0), (0, 0)]
    moved = [(a + 0.001, b) for a, b in square]
    ideal = line_df(spark, {"same": square, "moved": square, "flat": [(1, 1)], "lost": square, "far": square})
    snapped = line_df(spark, {"same": square, "moved": moved, "flat": square, "far": [(10, 10), (10, 10.001)]})
    got = {r["k"]: r["fidelity"] for r in similarity.shape_fidelity(ideal, snapped, "k").collect()}
    assert got["same"] == 0 and 0 < got["moved"] < 0.08
    assert math.isinf(got["flat"]) and math.isinf(got["lost"]) and got["far"] > 500


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(g, rng.randrange(120), rng.randrange(120)) for g in (1, 2) for _ in range(90)] + [(1, 500 + i, 501 + i) for i in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for g, a, b in edges:
        x, y = find((g, a)), find((g, b))
        parent[max(x, y)] = min(x, y)
    nodes = sorted({(g, x) for g, a, b in edges for x in (a, b)})
    got = connected_components(
        spark.createDataFrame(nodes, "g int, node long"), spark.createDataFrame(edges, "g int, a long, b long"), ["g"]
    ).collect()
    assert len(got) == len(nodes)
    for r in got:
        root = find((r["g"], r["node"]))
        assert r["component"] == min(n for g, n in nodes if find((g, n)) == root and g == r["g"])


def test_single_link_matches_brute_force(spark):
    rng = random.Random(8)
    pts = [(i % 3, i, rng.uniform(51, 51.4), rng.uniform(-0.4, 0.4)) for i in range(150)]
    pts += [(7, 900, 0.0, 179.99), (7, 901, 0.0, -179.99), (7, 902, 89.99, 0.0), (7, 903, 89.99, 170.0), (7, 904, 0.0, 179.99)]
    df = spark.createDataFrame(pts, "image_id long, point_id long, lat double, lon double")
    label = {p[1]: p[1] for p in pts}
    pairs = set()
    for a in pts:
        for b in pts:
            if a[0] == b[0] and a[1] < b[1] and hav(a[2:], b[2:], 6371.0) <= 3.0:
                pairs.add((a[1], b[1]))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    got = crossref.single_link_clusters(df, 3.0).collect()
    groups = {}
    for r in got:
        groups.setdefault((r["image_id"], r["component"]), set()).add(r["point_id"])
    want = {}
    for p in pts:
        want.setdefault((p[0], label[p[1]]), set()).add(p[1])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert {(r["a"], r["b"]) for r in crossref.near_pairs(df, 3.0).collect()} == pairs


def gcp(x, y, label, image=1, off=(0.0, 0.0)):
    lat = 51.5 - math.degrees(y / 6371000.0) + off[0]
    lon = -0.1 + math.degrees(x / (6371000.0 * math.cos(math.radians(51.5)))) + off[1]
    return (image, float(x), float(y), lat, lon, label, 0.5)


GCP = "image_id long, x_px double, y_px double, lat double, lon double, label string, weight double"


def test_affine_uses_every_anchor_of_a_large_image(spark):
    """700 anchors; those that agree sort last, past the 600th."""
    rng = random.Random(8)
    rows = [gcp(11 * i % 997, 37 * i % 911, f"A{i:03}", off=(rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3))) for i in range(601)]
    rows += [gcp(13 * i % 991, 41 * i % 919, f"Z{i:03}") for i in range(99)]
    fits, _ = georef.fit_affine(spark.createDataFrame(rows, GCP), trials=6000)
    got = fits.first()
    assert got["n_anchors"] >= 99 and got["rmse_m"] < 50 and not any(x.startswith("Z") for x in got["dropped_labels"])


@pytest.mark.parametrize("n", [3, 4, 7, 12, 40])
def test_trials_are_different_triples(spark, n):
    frame = spark.createDataFrame([(1, n)], "image_id long, n_all long")
    rows = georef._trials(frame, 200).groupBy("trial").agg(F.sort_array(F.collect_list("idx")).alias("t")).collect()
    trials = [r["t"] for r in rows]
    whole = n * (n - 1) * (n - 2) // 6
    assert len({tuple(t) for t in trials}) == len(trials) == min(200, whole)
    assert all(1 <= a < b < c <= n for a, b, c in trials)


def test_affine_recovers_map_and_drops_the_bad_anchor(spark):
    six = [(90, 40, "A"), (410, 70, "B"), (210, 190, "C"), (440, 260, "D"), (340, 410, "E"), (160, 370, "F")]
    rows = [gcp(*p, image=1) for p in six] + [gcp(300, 150, "BAD", 1, (0.05, 0.05))]
    rows += [gcp(*p, image=2) for p in (six[0], six[1], six[4])] + [gcp(300, 200, "OFF", 2, (1.0, 0.0))]
    rows += [gcp(*p, image=3) for p in six[:2]]
    rows += [gcp(i, i, f"L{i}", image=4) for i in range(4)]
    rows += [gcp(*p, image=5) for p in six[:4]]
    rows += [gcp(20 * i % 470, 37 * i % 410, f"P{i:03}", image=6, off=(0.0, 0.05) if i % 6 == 0 else (0.0, 0.0)) for i in range(60)]
    fits, rejects = georef.fit_affine(spark.createDataFrame(rows, GCP))
    got = {r["image_id"]: r for r in fits.collect()}
    assert set(got) == {1, 2, 5, 6} and {r["image_id"] for r in rejects.collect()} == {3, 4}
    assert got[1]["dropped_labels"] == ["BAD"] and got[1]["n_anchors"] == 6 and got[1]["rmse_m"] < 1
    assert got[2]["dropped_labels"] == ["OFF"] and got[2]["n_anchors"] == 3
    assert got[5]["dropped_labels"] == [] and got[5]["n_anchors"] == 4
    assert got[6]["n_anchors"] == 50
    pixels = spark.createDataFrame([(1, 0, 200.0, 200.0), (1, 1, 300.0, 200.0)], "image_id long, seq long, x double, y double")
    projected = georef.project_pixels(pixels, fits).orderBy("seq").collect()
    a, b = [(r["lat"], r["lon"]) for r in projected]
    assert abs(hav(a, b, 6371000.0) - 100) < 1
    back = georef.locate_pixels(georef.project_pixels(pixels, fits).select("image_id", "seq", "lat", "lon"), fits)
    for r in back.collect():
        assert abs(r["x_px"] - (200 + 100 * r["seq"])) < 1e-3 and abs(r["y_px"] - 200) < 1e-3


def test_frechet_against_recursion(spark):
    from functools import lru_cache
    rng = random.Random(2)
    m = math.degrees(1 / 6371000.0)
    a = {k: [(rng.uniform(0, 500) * m, rng.uniform(0, 500) * m) for _ in range(n)] for k, n in zip("pqrs", (1, 4, 9, 12))}
    b = {k: [(rng.uniform(0, 500) * m, rng.uniform(0, 500) * m) for _ in range(n)] for k, n in zip("pqrs", (5, 1, 7, 12))}
    a["only"] = [(0, 0)]
    got = {r["k"]: r["frechet_m"] for r in similarity.discrete_frechet(line_df(spark, a), line_df(spark, b), "k").collect()}
    assert math.isinf(got["only"])
    for k in "pqrs":
        d = lambda i, j: math.dist(*[tuple(math.radians(v) * 6371000.0 for v in p) for p in (a[k][i], b[k][j])])

        @lru_cache(None)
        def c(i, j):
            before = [c(*q) for q in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if min(q) >= 0]
            return max(min(before), d(i, j)) if before else d(i, j)
        assert abs(got[k] - c(len(a[k]) - 1, len(b[k]) - 1)) < 0.01


def test_buffered_overlap(spark):
    m = math.degrees(1 / 6371000.0)
    base = [(0, 0), (0, 1000 * m)]
    a = line_df(spark, {"same": base, "off": base, "far": base, "dot": base, "diag": [(0, 0), (300 * m, 400 * m), (0, 800 * m)]})
    b = line_df(spark, {
        "same": base, "off": [(20 * m, 0), (20 * m, 1000 * m)], "far": [(1, 1), (1, 1.001)], "dot": [(0, 0)],
        "diag": [(0, 0), (300 * m, 400 * m), (0, 800 * m)],
    })
    got = {r["k"]: r["iou"] for r in similarity.buffered_iou(a, b, "k", 20.0).collect()}
    back = {r["k"]: r["iou"] for r in similarity.buffered_iou(b, a, "k", 20.0).collect()}
    assert got["same"] == 1.0 and got["diag"] == 1.0 and got["far"] == 0.0 and got["dot"] == 0.0
    # Two 40 m wide strips half over each other, with half discs at the ends.
    rect = 20 * 1000
    lens = 2 * 20**2 * math.acos(0.5) - 10 * math.sqrt(4 * 400 - 400)
    want = (rect + lens) / (2 * (40 * 1000 + math.pi * 400) - rect - lens)
    assert abs(got["off"] - want) < 0.01 and abs(got["off"] - back["off"]) < 1e-9
    score = similarity.fidelity(a, b, "k").filter("k = 'same'").first()
    assert score["score"] == pytest.approx(1.0) and score["passes"]
    with pytest.raises(ValueError):
        similarity.buffered_iou(a, b, "k", 0)


def grid(spark, n, broken=()):
    m = 0.001
    nodes = [(r * n + c, 51 + r * m, c * m) for r in range(n) for c in range(n)]
    edges = []
    for r in range(n):
        for c in range(n):
            u = r * n + c
            for v in ([u + 1] if c < n - 1 else []) + ([u + n] if r < n - 1 else []):
                if u in broken or v in broken:
                    continue
                edges += [(u, v, 50.0 + (u * 31 + v * 17) % 70), (v, u, 50.0 + (v * 31 + u * 17) % 70)]
    return nodes, edges


def dijkstra(edges, s):
    import heapq
    out = {}
    for u, v, w in edges:
        out.setdefault(u, []).append((v, w))
    best, heap = {}, [(0.0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = d
        for v, w in out.get(u, []):
            heapq.heappush(heap, (d + w, v))
    return best


def test_shortest_paths_match_dijkstra(spark):
    nodes, edges = grid(spark, 6, broken={14})
    edges.append((0, 1, 10.0))
    pairs = [(0, 35), (3, 20), (7, 8), (5, 5), (0, 14), (30, 2)]
    got = graph.shortest_paths(
        spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(edges, "u long, v long, length double")
    ).collect()
    weight = {}
    for u, v, w in edges:
        weight[u, v] = min(w, weight.get((u, v), 1e9))
    for r in got:
        want = dijkstra(edges, r["u"]).get(r["v"])
        assert r["dist"] == want
        if want is not None:
            assert sum(weight[p] for p in zip(r["path"], r["path"][1:])) == want


def test_map_match_follows_streets(spark):
    nodes, edges = grid(spark, 8)
    line = [(51 + 0.001 * i + 0.0001, 0.0002) for i in range(6)]
    named = {"a": line, "b": [(51.0, 0.0)], "c": [(51.0, 0.0), (51.0, 0.00001)]}
    nd = spark.createDataFrame(nodes + [(999, 51.0, 0.02)], "id long, lat double, lon double")
    ed = spark.createDataFrame(edges, "u long, v long, length double")
    for pad in (None, 400.0):
        routes_df, points = graph.map_match(line_df(spark, named), nd, ed, "k", 30.0, pad)
        got = {r["k"]: r for r in routes_df.collect()}
        path = [r["node"] for r in points.filter("k = 'a'").orderBy("seq").collect()]
        assert path[0] == 0 and path[-1] == 40 and len(set(path)) == len(path)
        assert got["a"]["unreachable_segments"] == 0 and got["a"]["length_m"] >= 250 and got["a"]["waypoints_used"] == 6
        assert got["b"]["length_m"] == 0 and got["b"]["waypoints_used"] == 1
        assert points.filter("k = 'b'").count() == 1
        assert got["c"]["snapped_pairs"] == 0 and got["c"]["length_m"] == 0


def test_stitch_drops_shared_heads_and_skips_gaps(spark):
    steps = spark.createDataFrame(
        [("a", 0, 1, 2, [1, 5, 2]), ("a", 1, 2, 2, [2]), ("a", 2, 2, 3, [2, 3]), ("a", 3, 3, 9, None), ("a", 4, 9, 4, [9, 4])],
        "k string, seq long, u long, v long, path array<long>",
    )
    got = graph.stitch_paths(steps, "k").orderBy("seq").collect()
    assert [r["node"] for r in got] == [1, 5, 2, 3, 9, 4] and [r["seq"] for r in got] == list(range(6))


def test_score_formulas(spark):
    row = spark.range(1).select(
        scores.reconstruction_confidence(F.lit(6), F.lit(30.0), F.lit(1.0), F.lit(1.0)).alias("full"),
        scores.reconstruction_confidence(F.lit(3), F.lit(30.0), F.lit(1.0), F.lit(1.0)).alias("three"),
        scores.fidelity_combine(F.lit(1.0), F.lit(float("inf"))).alias("inf"),
        scores.error_pct(F.lit(9.0), F.lit(10.0)).alias("err"),
    ).first()
    assert row["full"] == pytest.approx(1.0) and row["three"] == pytest.approx(0.05 ** 0.25)
    assert row["inf"] == pytest.approx(0.6) and row["err"] == pytest.approx(-10)


def outlines(spark):
    rows = [("box", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])]
    return spark.createDataFrame(rows, "shape string, seq long, x double, y double")


REQ = ("request_id long, shape string, lat double, lon double, distance_km double, waypoints int, iterations int,"
       "search_radius_km double, candidates int, scales int")


def test_requests_are_split_with_reasons(spark):
    rows = [
        (1, "box", 51.0, 0.0, 10.0, 40, 5, None, 5, 3), (2, "yak", 51.0, 0.0, 10.0, 40, 5, None, 5, 3),
        (3, "box", 95.0, 0.0, 0.0, 40, 5, 0.0, 5, 3), (4, "box", 51.0, 0.0, 50.0, 80, 10, 200.0, 15, 8),
    ]
    good, bad = routes.split_requests(spark.createDataFrame(rows, REQ), outlines(spark))
    assert {r["request_id"] for r in good.collect()} == {1, 4}
    assert {r["request_id"]: r["reasons"] for r in bad.collect()} == {
        2: ["shape"], 3: ["lat", "distance_km", "search_radius_km"]
    }


def echo_router(detour, far_fails=False):
    def route(waypoints):
        lengths = lines.line_length(waypoints, ["route_id"], ("lat", "lon"), lines.ground_step(geo.OUTLINE_RADIUS_M, False))
        routed = waypoints.join(lengths, "route_id").withColumn("distance_m", F.col("length") * detour).drop("length")
        if far_fails:
            routed = routed.filter(~F.col("route_id").endswith("/0"))
        return routed
    return route


def test_search_keeps_the_first_best_candidate(spark):
    rows = [(1, "box", 51.0, 0.0, 10.0, 40, 5, 10.0, 3, 2), (2, "box", 40.0, 5.0, 5.0, 20, 5, 1.0, 1, 1)]
    best, lost = routes.search_routes(spark.createDataFrame(rows, REQ), outlines(spark), echo_router(1.0))
    got = {r["request_id"]: r for r in best.collect()}
    assert got[1]["candidate_no"] == 0 and got[1]["fidelity"] < 1e-9 and lost.count() == 0
    best, lost = routes.search_routes(spark.createDataFrame(rows, REQ), outlines(spark), echo_router(1.0, True))
    assert {r["request_id"]: r["candidate_no"] for r in best.collect()} == {1: 1}
    assert [r["request_id"] for r in lost.collect()] == [2]


def test_rescaling_converges(spark):
    rows = [(1, "box", 51.0, 0.0, 10.0, 40, 8, None, 5, 3), (2, "box", 51.0, 0.0, 10.0, 40, 1, None, 5, 3)]
    best, lost = routes.rescale_iterate(spark.createDataFrame(rows, REQ), outlines(spark), echo_router(2.0))
    got = {r["request_id"]: r for r in best.collect()}
    assert got[1]["error"] < 0.03 and got[2]["iteration"] == 1 and got[2]["error"] > 0.3 and lost.count() == 0


def test_candidate_grid_values(spark):
    rows = [(1, "box", 51.0, 0.0, 10.0, 40, 5, 10.0, 5, 3)]
    grid_df = routes.candidate_grid(spark.createDataFrame(rows, REQ), routes.sampled_outlines(spark.createDataFrame(rows, REQ), outlines(spark)))
    got = grid_df.orderBy("candidate_no").collect()
    assert len(got) == 15 and got[0]["centre_lat"] == 51.0
    for r in got[3:]:
        assert abs(hav((51.0, 0.0), (r["centre_lat"], r["centre_lon"]), 6371.0) - 5.0) < 0.02
    assert got[2]["scale"] / got[0]["scale"] == pytest.approx(5.0)
