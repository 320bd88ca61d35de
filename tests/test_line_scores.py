"""Scores of many lines: what is shuffled, scored and left on disk."""

import math
import os
import random
from functools import partial

from pyspark.sql import functions as F

from routewright.operators import nearest, routes, similarity, traces
from routewright.session import shared_dir


def hav(a, b, radius):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * radius * math.asin(min(1.0, math.sqrt(h)))


def clouds(spark):
    """Points and targets of three keys: close ones, some far, some beyond the date line, and a key without targets."""
    rng = random.Random(3)
    centres = {"a": (51.0, 0.0), "b": (-10.0, 179.9995), "c": (89.99, 20.0)}
    src, dst = [], []
    for k, (lat, lon) in centres.items():
        for i in range(40):
            src.append((k, len(src), lat + rng.uniform(-0.004, 0.004), (lon + rng.uniform(-0.004, 0.004) + 180) % 360 - 180))
            dst.append((k, len(dst), lat + rng.uniform(-0.004, 0.004), (lon + rng.uniform(-0.004, 0.004) + 180) % 360 - 180))
        src.append((k, len(src), lat - 1.0, lon))
    src.append(("none", len(src), 51.0, 0.0))
    return src, dst, (spark.createDataFrame(src, "k string, src_id long, lat double, lon double"),
                      spark.createDataFrame(dst, "k string, t_id long, lat double, lon double"))


def test_nearest_within_a_key_matches_brute_force(spark):
    src, dst, (s, t) = clouds(spark)
    got = {r["src_id"]: (r["t_id"], r["distance"]) for r in nearest.nearest(s, t, ["k"]).collect()}
    assert len(got) == len(src) - 1
    for k, i, lat, lon in src[:-1]:
        d, best = min((round(hav((lat, lon), (a, b), 6371000.0), 6), j) for kk, j, a, b in dst if kk == k)
        assert abs(got[i][1] - d) < 1e-3 and got[i][0] == best


def test_points_of_a_key_are_shuffled_once(spark, monkeypatch):
    """What a point meets is folded where it was joined: nothing is shuffled by point."""
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    cut = nearest.cut_lineage
    monkeypatch.setattr(nearest, "cut_lineage", written)
    _, _, (s, t) = clouds(spark)
    nearest.nearest(s, t, ["k"], which=False)
    shuffled = [line for line in plans[0].splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and not any("src_id" in line.split("hashpartitioning")[1].split(")")[0] for line in shuffled)


def test_scores_leave_no_points_on_disk(spark):
    _, _, (s, t) = clouds(spark)
    a, b = (df.withColumn("seq", F.row_number().over(similarity.Window.partitionBy("k").orderBy("lat")) - 1) for df in (s, t))
    before = set(os.listdir(shared_dir(spark)))
    scores = {r["k"]: r["fidelity"] for r in similarity.shape_fidelity(a, b, "k").collect()}
    left = [f for f in set(os.listdir(shared_dir(spark))) - before if os.listdir(f"{shared_dir(spark)}/{f}")]
    assert len(left) == 1 and set(scores) == {"a", "b", "c", "none"} and math.isinf(scores["none"])


def test_a_tie_in_fidelity_goes_to_the_first_candidate(spark):
    scored = spark.createDataFrame([(1, 0, 0.3), (1, 1, 0.3 - 1e-15), (2, 0, 0.3), (2, 1, 0.2)], "request_id long, candidate_no int, fidelity double")
    assert {r["request_id"]: r["candidate_no"] for r in routes.best_route_by_fidelity(scored).collect()} == {1: 0, 2: 1}


def test_rescaling_scores_the_chosen_lines_alone(spark, monkeypatch):
    scored = []

    def score(ideal, snapped, key):
        found = similarity.shape_fidelity(ideal, snapped, key)
        scored.append(sorted(r[key] for r in found.collect()))
        return found

    monkeypatch.setattr(routes, "shape_fidelity", score)
    outlines = spark.createDataFrame([("box", 0, 0.0, 0.0), ("box", 1, 4.0, 0.0), ("box", 2, 4.0, 4.0)], "shape string, seq long, x double, y double")
    asked = spark.createDataFrame([(1, "box", 51.0, 0.0, 2.0, 10, 3)], "request_id long, shape string, lat double, lon double, distance_km double, waypoints int, iterations int")

    def router(waypoints):  # always 1 km: the error stays, and the first of equal errors is best
        return waypoints.withColumn("distance_m", F.lit(1000.0))

    best, lost = routes.rescale_iterate(asked, outlines, router)
    assert [(r["iteration"], r["distance_m"], r["fidelity"]) for r in best.collect()] == [(1, 1000.0, 0.0)]
    assert scored == [["1/1"]] and lost.isEmpty()


def test_scanlines_are_not_shuffled(spark, monkeypatch):
    """A segment is shuffled, its scanlines are not; areas are the same however few are made at a time."""
    rng = random.Random(5)
    walk = lambda k: [(k, n, 51 + n * 4e-4 + rng.uniform(0, 4e-4), rng.uniform(0, 1e-3)) for n in range(12)]
    schema = "k string, seq long, lat double, lon double"
    a, b = (spark.createDataFrame([r for k in "uvw" for r in walk(k)] + [("still", n, 51.0, 0.0) for n in (0, 1)] + more, schema)
            for more in ([("lone", 0, 51.0, 0.0)], [("gap", 0, 51.0, 0.0), ("gap", 1, None, 0.0)]))
    found = similarity.buffered_iou(a, b, "k")
    dealt = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("row" in line.split("hashpartitioning")[1] for line in dealt)
    whole = {r["k"]: r["iou"] for r in found.collect()}
    monkeypatch.setattr(similarity, "_band_areas", partial(similarity._band_areas, most=50))
    few = {r["k"]: r["iou"] for r in similarity.buffered_iou(a, b, "k").collect()}
    assert whole.keys() == few.keys() == {"u", "v", "w", "still", "lone", "gap"} and (whole["still"], whole["lone"], whole["gap"]) == (1.0, 0.0, 0.0)
    assert all(abs(whole[k] - few[k]) < 1e-12 for k in whole) and 0 < whole["u"] < 1


def test_pairs_of_equal_sizes_are_coupled_together(monkeypatch):
    rng = random.Random(7)
    line = lambda n: [rng.uniform(0, 9) for _ in range(n)]
    sizes = [(3, 5), (0, 2), (3, 5), (5, 3), (1, 1), (3, 5), (2, 0), (1, 4)]
    rows = [(line(n), line(n), line(m), line(m)) for n, m in sizes]
    calls, couple = [], similarity._frechet
    monkeypatch.setattr(similarity, "_COUPLED", 16)
    monkeypatch.setattr(similarity, "_frechet", lambda *arrays: (calls.append(arrays[0].shape), couple(*arrays))[1])
    got = list(similarity._frechet_batch(*(similarity.pd.Series(list(side)) for side in zip(*rows))))

    def coupled(ax, ay, bx, by):
        best = {}
        for i in range(len(ax)):
            for j in range(len(bx)):
                before = [best[q] for q in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if q in best]
                best[i, j] = max(min(before, default=0.0), float(similarity.np.hypot(ax[i] - bx[j], ay[i] - by[j])))
        return best.get((len(ax) - 1, len(bx) - 1), math.inf)

    assert got == [coupled(*row) for row in rows] and calls.count((3, 2)) == 1 and calls.count((3, 1)) == 1


def test_equal_places_are_snapped_once(spark, monkeypatch):
    searched, search = [], nearest.nearest

    def counted(src, *args):
        searched.append(src.count())
        return search(src, *args)

    monkeypatch.setattr(nearest, "nearest", counted)
    rows = [((r, n), 51.0 + n * 0.001, 0.0 if r else -0.0) for r in range(5) for n in range(3)] + [((9, 0), None, 0.0)]
    points = spark.createDataFrame(rows, "src_id struct<r:long,n:long>, lat double, lon double")
    nodes = spark.createDataFrame([(n, 51.0 + n * 0.001, 0.0001) for n in range(2)], "id long, lat double, lon double")
    got = {tuple(r["src_id"]): r["node"] for r in nearest.snap_to_nodes(points, nodes).collect()}
    assert got == {(r, n): min(n, 1) for r in range(5) for n in range(3)} and searched == [4]


def dense(line, step):
    """Points of a line as lists of (lat, lon); a vertex without a place is none, and nothing lies between it and the next."""
    out = line[:1]
    for a, b in zip(line, line[1:]):
        n = 1 if None in (*a, *b) else max(1, math.ceil(hav(a, b, 6371008.8) / step))
        out += [b if n == 1 else tuple(p + (q - p) * i / n for p, q in zip(a, b)) for i in range(1, n + 1)]
    return [p for p in out if None not in p]


def traced_lines():
    rng = random.Random(11)
    walk = lambda lat, lon, n, d: [(lat + rng.uniform(-d, d), (lon + rng.uniform(-d, d) + 180) % 360 - 180) for _ in range(n)]
    return {
        "near": (walk(51, 0, 9, 0.01), walk(51, 0, 12, 0.01)), "far": (walk(51, 0, 3, 0.01), walk(-20, 100, 4, 0.01)),
        "date line": (walk(-10, 179.9995, 5, 0.002), walk(-10, 179.9995, 4, 0.002)), "pole": (walk(89.99, 20, 3, 0.005), walk(89.99, -160, 3, 0.005)),
        "same": ([(51.0, 0.0), (51.01, 0.0)], [(51.0, 0.0), (51.01, 0.0)]), "gap": ([(51.0, 0.0), (None, 0.001), (51.01, 0.01)], [(51.0, 0.0), (51.0, None)]),
        "short": ([(51.0, 0.0)], walk(51, 0, 3, 0.01)), "round": ([(51.0, 0.0), (51.0, 1e-5)] * 4, [(51 + 0.01 * math.sin(t), 0.016 * math.cos(t)) for t in range(40)]),
    }


def mean_distances(step, **sizes):
    lines = traced_lines()
    rows = [[{"side": side, "seq": n, "lat": lat, "lon": lon} for side in (1, 0) for n, (lat, lon) in reversed(list(enumerate(pair[side])))]
            for pair in lines.values()]
    vertex = similarity.pa.struct([("side", "int32"), ("seq", "int64"), ("lat", "float64"), ("lon", "float64")])
    listed = similarity.pa.array(rows, similarity.pa.list_(vertex))
    batch = similarity.pa.RecordBatch.from_arrays([similarity.pa.array(list(lines)), listed], names=["k", "vertices"])
    return {r["k"]: (r["there_m"], r["back_m"]) for out in traces.mean_distances(iter([batch]), step) for r in out.to_pylist()}


def test_distances_of_traced_lines_match_brute_force(monkeypatch):
    found = mean_distances(25.0)
    for k, (a, b) in traced_lines().items():
        a, b = dense(a, 25.0), dense(b, 25.0)
        for got, src, dst in zip(found[k], (a, b), (b, a)):
            want = sum(min(hav(p, q, 6371008.8) for q in dst) for p in src) / len(src)
            assert abs(got - want) < 1e-6, (k, got, want)
    assert found["same"] == (0.0, 0.0)
    for name, size in {"_LEAF": 2, "_FAN": 2, "_DENSE": 40, "_PAIRS": 3, "_MEASURED": 2}.items():
        monkeypatch.setattr(traces, name, size)
    few = mean_distances(25.0)
    assert all(abs(x - y) < 1e-6 for k in found for x, y in zip(found[k], few[k]))


def test_points_between_vertices_are_neither_shuffled_nor_written(spark, monkeypatch):
    """The vertices of either line are shuffled once, by line; only the scores are written."""
    plans, cut = [], similarity.cut_lineage

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(similarity, "cut_lineage", written)
    monkeypatch.setattr(nearest, "cut_lineage", written)
    lines = traced_lines()
    schema = "k string, seq long, lat double, lon double"
    a, b = (spark.createDataFrame([(k, n, *p) for k, pair in lines.items() for n, p in enumerate(pair[side])] + more, schema)
            for side, more in ((0, [("lost", 0, 51.0, 0.0), (None, 0, 51.0, 0.0), (None, 1, 51.1, 0.0)]), (1, [(None, 0, 51.0, 0.0)])))
    got = [(r["k"], r["fidelity"]) for r in similarity.shape_fidelity(a, b, "k").collect()]
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning(k") == plans[0].count("Exchange") == 2 and "Generate" not in plans[0]
    assert sorted(str(k) for k, score in got if math.isinf(score)) == ["None", "None", "lost", "short"]
    scores = dict(got)
    assert scores["same"] == 0 and scores["far"] > 1000 and 0 < scores["gap"] < 1
