import random

import pytest
from pyspark.sql import functions as F

from routewright.operators import crossref, georef, labels, raster
from routewright.plans import jobs

FRAGMENT = "image_id long, fragment_no long, text string, conf double, x_min double, x_max double, y_min double, y_max double, x_center double, y_center double"


def fragment(image, no, text, x, y, w=40.0, h=10.0, conf=0.5):
    return (image, no, text, conf, float(x), x + w, float(y), y + h, x + w / 2, y + h / 2)


def plain_merge(rows):
    """Reading of the rule for one image, one list at a time."""
    items = sorted((r for r in rows if sum(c.isalpha() for c in r[2]) >= 2 and 2 * sum(c.isalpha() for c in r[2]) >= len(r[2].replace(" ", ""))),
                   key=lambda r: (r[9], r[8]))
    height = lambda r: max(r[7] - r[6], 4.0)
    out = []
    while items:
        band, rest = [items[0]], []
        for r in items[1:]:
            near = abs(r[9] - band[-1][9]) <= 0.7 * (height(band[-1]) + height(r)) / 2
            (band if near else rest).append(r)
        items = rest
        band.sort(key=lambda r: r[8])
        group = [band[0]]
        for r in band[1:]:
            if r[4] - group[-1][5] <= 1.5 * (height(group[-1]) + height(r)) / 2:
                group.append(r)
            else:
                out.append(group)
                group = [r]
        out.append(group)
    return sorted((" ".join(r[2] for r in g), round(sum(r[3] for r in g) / len(g), 6), min(r[4] for r in g), max(r[5] for r in g)) for g in out)


def test_merge_labels_matches_the_plain_rule(spark):
    rng = random.Random(11)
    rows = []
    for image in range(6):
        for no in range(40):
            text = rng.choice(["Elm", "Oak Rd", "12", "a1", "Ash", "X 77777"])
            rows.append(fragment(image, image * 100 + no, text + ("" if text in ("12", "X 77777") else chr(97 + no % 26)), rng.uniform(0, 500), rng.uniform(0, 150 + 700 * (image % 2)),
                                 rng.uniform(10, 60), rng.uniform(2, 16), rng.random()))
    got = {}
    for r in labels.merge_labels(spark.createDataFrame(rows, FRAGMENT)).collect():
        got.setdefault(r["image_id"], []).append((r["text"], round(r["conf"], 6), r["x_min"], r["x_max"]))
    for image in range(6):
        assert sorted(got[image]) == plain_merge([r for r in rows if r[0] == image])


def test_one_image_with_most_labels_is_spread_over_islands(spark):
    rng = random.Random(4)
    rows = [fragment(1, no, "Elm" + chr(97 + no % 26), rng.uniform(0, 900), 14 * (no % 600) + rng.uniform(0, 6), rng.uniform(10, 60), rng.uniform(2, 14), rng.random())
            for no in range(3000)]
    rows += [fragment(1, 5000 + no, "Slant", 30 * no, 9000 + 3.5 * no) for no in range(200)]
    rows += [fragment(2, 7000 + no, "Oak", 60 * no, 0.0) for no in range(20)]
    df = spark.createDataFrame(rows, FRAGMENT)
    heights = F.greatest(F.col("y_max") - F.col("y_min"), F.lit(labels.MIN_HEIGHT))
    sizes = labels._islands(df.withColumn("height", heights)).groupBy("image_id", "_island").count().collect()
    assert sum(r["count"] for r in sizes) == len(rows) and len(sizes) > 100
    assert max(r["count"] for r in sizes if r["image_id"] == 1) == 200
    want = {image: plain_merge([r for r in rows if r[0] == image]) for image in (1, 2)}
    for most in (10, 100):
        got = {}
        for r in labels.merge_labels(df, most).collect():
            got.setdefault(r["image_id"], []).append((r["text"], round(r["conf"], 6), r["x_min"], r["x_max"]))
        assert {image: sorted(found) for image, found in got.items()} == want


GAZ = "place_id long, name string, name_en string, lat double, lon double, city string, country string, importance double"


def gazetteer(spark):
    rows = [
        (1, "Elm Road", None, 51.000, 0.000, "Aton", "X", 3.0), (2, "Oak Lane", None, 51.004, 0.001, "Aton", "X", 3.0),
        (3, "Broomfield Way", "English Way", 51.002, 0.010, "Aton", "X", 3.0), (4, "Elm Road", None, 55.0, 3.0, "Bton", "X", 9.0),
        (5, "Oak Lane", None, 55.001, 3.001, "Bton", "X", 9.0), (6, "Ash Hill", None, 60.0, 5.0, "Cton", "Y", 1.0),
        (7, "Bay Row", None, 70.0, 5.0, "Cton", "Y", 1.0), (8, "Bay Row", None, 61.0, 9.0, "Dton", "Y", 0.5),
    ]
    return spark.createDataFrame(rows, GAZ)


def candidates(spark, named):
    rows = [(i, n.lower(), n, "road", n, c, 0.0, 0.0, k) for i, pairs in named.items() for k, (n, c) in enumerate(pairs)]
    return spark.createDataFrame(
        rows, "image_id long, name_key string, normalized string, suffix string, raw string, confidence double, band_y double, band_x double, part long"
    )


def test_lookup_limits_can_be_lifted(spark):
    rows = [(n, "Elm Road", None, 50.0 + n / 1000, 0.0, "Aton", "X", 1.0) for n in range(100)]
    places, asked = spark.createDataFrame(rows, GAZ), candidates(spark, {1: [("Elm Road", 0.9)]})
    assert crossref.match_streets(asked, places).count() == 40
    assert crossref.match_streets(asked, places, None, None, None).count() == 100
    clusters, matches = crossref.find_geocodes(asked, places, 1, hits_per_name=None, max_lookups=None, variants=None, max_hypotheses=None)
    assert matches.count() == 100 and clusters.first()["n_ways"] == 100


def test_clusters_prefer_more_names_and_variants_rescue_misreads(spark):
    named = {
        1: [("Elm Road", 0.9), ("Oak Lane", 0.8), ("Brocmfield Way", 0.7)], 2: [("Elm Road", 0.9), ("Nowhere Path", 0.8)],
        3: [("English Way", 0.9), ("Oak Lane", 0.2)], 4: [("Ash Hill", 0.9), ("Bay Row", 0.8)],
    }
    clusters, matches = crossref.find_geocodes(candidates(spark, named), gazetteer(spark), min_streets=2)
    got = {r["image_id"]: r for r in clusters.collect()}
    assert got[1]["city"] == "Aton" and got[1]["n_names"] == 3 and got[1]["streets"] == ["Brocmfield Way", "Elm Road", "Oak Lane"]
    assert got[1]["confidence"] == pytest.approx(0.95) and 2 not in got
    assert got[3]["city"] == "Aton" and got[3]["n_ways"] == 2
    # Ash Hill and Bay Row never stand close to each other, but both are in Cton.
    assert got[4]["city"] == "Cton" and got[4]["n_names"] == 2 and got[4]["lat"] == pytest.approx(65.0)
    spelled = {(r["image_id"], r["street"]): r["spelling"] for r in matches.collect()}
    assert spelled[1, "Brocmfield Way"] == "Broomfield Way"
    one, _ = crossref.find_geocodes(candidates(spark, named), gazetteer(spark), min_streets=2, two_pass=False)
    assert 4 not in {r["image_id"] for r in one.collect()}


def test_lookups_are_limited_to_the_most_confident(spark):
    named = {1: [("Elm Road", 0.1), ("Oak Lane", 0.9)]}
    matches = crossref.match_streets(candidates(spark, named), gazetteer(spark), max_lookups=1)
    assert {r["street"] for r in matches.collect()} == {"Oak Lane"}
    capped = crossref.match_streets(candidates(spark, named), gazetteer(spark), hits_per_name=1)
    assert {r["city"] for r in capped.collect()} == {"Bton"}


def mask(spark, pixels, image=1):
    return spark.createDataFrame([(image, x, y) for x, y in sorted(pixels)], "image_id long, x int, y int")


def test_close_seals_a_gap_and_keeps_the_border(spark):
    row = {(x, y) for x in range(10) for y in (0, 1, 2) if x != 4}
    sizes = spark.createDataFrame([(1, 10, 6)], "image_id long, width int, height int")
    got = {(r["x"], r["y"]) for r in raster.morph_close(mask(spark, row), sizes).collect()}
    assert got >= row | {(4, 1)} and (4, 0) in got and max(y for _, y in got) == 2


def test_components_and_area_limit(spark):
    blob = {(x, y) for x in range(5, 20) for y in range(5, 20)}
    diagonal = {(20 + i, 20 + i) for i in range(5)}
    pin = {(x, y) for x in range(30, 33) for y in range(2, 5)}
    got = {(r["x"], r["y"]) for r in raster.largest_component(mask(spark, blob | diagonal | pin), 200).collect()}
    assert got == blob | diagonal
    assert raster.largest_component(mask(spark, pin), 200).count() == 0


def test_strokes_become_lines(spark):
    bar = {(x, y) for x in range(5, 60) for y in range(10, 13)}
    ell = {(x, y) for x in range(5, 8) for y in range(5, 50)} | {(x, y) for x in range(5, 50) for y in range(47, 50)}
    ring = {(x, y) for x in range(10, 50) for y in range(10, 50)} - {(x, y) for x in range(13, 47) for y in range(13, 47)}
    rows = mask(spark, bar, 1).union(mask(spark, ell, 2)).union(mask(spark, ring, 3))
    got = {}
    for r in raster.stroke_to_polyline(rows).orderBy("image_id", "seq").collect():
        got.setdefault(r["image_id"], []).append((r["x"], r["y"]))
    assert len(got[1]) >= 50 and {y for _, y in got[1]} == {11} and abs(got[1][0][0] - got[1][-1][0]) >= 50
    assert len(got[2]) >= 75 and len(got[3]) >= 120
    for line in got.values():
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(line, line[1:]))
        assert len(set(line)) == len(line)


def test_grey_images_have_no_stroke(spark):
    rows = [(1, x, y, 120, 120, 120) for x in range(20) for y in range(20)] + [(2, 0, 0, 30, 30, 220), (2, 1, 0, 220, 60, 30), (2, 2, 0, 200, 30, 200)]
    pixels = spark.createDataFrame(rows, "image_id long, x int, y int, b int, g int, r int")
    assert {(r["image_id"], r["x"]) for r in raster.stroke_mask(pixels).collect()} == {(2, 0), (2, 2)}


def test_label_batch_marks_every_attempt(spark):
    rows = []
    for no, (text, y) in enumerate([("Elm Rd", 0), ("Oak Ln", 50), ("Broomfield Way", 100)]):
        rows.append(fragment(1, no, text, 10, y, conf=0.9))
    rows += [fragment(2, 20, "hello", 10, 0), fragment(3, 30, "Elm Rd", 10, 0, conf=0.9)]
    work = [(i, f"T{i}", "c", f"u{i}") for i in (1, 2, 3, 4)]
    from routewright import schemas
    base = spark.createDataFrame([], schemas.CATALOGUE)
    catalogue = base.unionByName(spark.createDataFrame(work, "id long, title string, category string, image_url string"), allowMissingColumns=True)
    failures = spark.createDataFrame([(4, "fetch: gone")], "image_id long, error string")
    after, outcomes = jobs.label_geocode_batch(catalogue, spark.createDataFrame(rows, FRAGMENT), gazetteer(spark), "now", failures=failures)
    got = {r["id"]: r for r in outcomes.collect()}
    assert got[1]["cluster_city"] == "Aton" and got[1]["matched"] == 3 and got[1]["streets_json"].startswith('["Elm Road"')
    assert got[2]["candidates"] == 0 and got[3]["candidates"] == 1 and got[3]["cluster_lat"] is None and got[4]["error"] == "fetch: gone"
    state = {r["id"]: r["geocode_source"] for r in after.collect()}
    assert state == {1: "ocr", 2: "ocr-failed", 3: "ocr-failed", 4: "ocr-failed"}
    assert after.filter("ocr_attempted_at IS NULL").count() == 0


def test_reconstruction_reaches_gpx_and_names_first_failures(spark, tmp_path):
    """A known map: pixel (x, y) lies 10 m per pixel east and south of (51, 0); the stroke follows a street grid."""
    import math

    lat_of = lambda y: 51.0 - math.degrees(10.0 * y / 6371000.0)
    lon_of = lambda x: math.degrees(10.0 * x / (6371000.0 * math.cos(math.radians(51.0))))
    stroke = {(x, y) for x in range(10, 90) for y in (20, 21, 22)} | {(x, y) for x in (88, 89, 90) for y in range(20, 90)}
    pixels = []
    for image in (1, 2, 3, 4):
        for x in range(100):
            for y in range(100):
                ink = (x, y) in stroke and image != 2
                pixels.append((image, x, y, *((30, 40, 220) if ink else (200, 200, 200))))
    spots = [("Elm Rd", 20, 15), ("Oak Ln", 80, 30), ("Ash Hill", 50, 60), ("Bay Row", 15, 80), ("Fir Path", 70, 75), ("Yew Close", 35, 40)]
    fragments, places = [], []
    for no, (name, x, y) in enumerate(spots):
        fragments.append(fragment(1, no, name, x - 10, y - 5, w=20.0, conf=0.95))
        full = name.replace(" Rd", " Road").replace(" Ln", " Lane")
        places.append((no, full, None, lat_of(y), lon_of(x), "Aton", "X", 1.0))
    fragments += [fragment(3, 50, "Elm Rd", 0, 0), fragment(4, 60, "hello", 0, 0), fragment(2, 70, "Elm Rd", 0, 0)]
    nodes, edges = [], []
    for i in range(11):
        for j in range(11):
            nodes.append((i * 11 + j, lat_of(i * 10 + 1), lon_of(j * 10 - 1)))
            for di, dj in ((0, 1), (1, 0)):
                if i + di < 11 and j + dj < 11:
                    u, v = i * 11 + j, (i + di) * 11 + j + dj
                    edges += [(u, v, 100.0), (v, u, 100.0)]
    work = spark.createDataFrame([(i, f"T{i}", "c", f"u{i}", 1.0) for i in (1, 2, 3, 4, 5)], "id long, title string, category string, image_url string, lat double")
    from routewright import schemas
    catalogue = spark.createDataFrame([], schemas.CATALOGUE).unionByName(work, allowMissingColumns=True)
    after, outcomes = jobs.reconstruct_batch(
        catalogue, spark.createDataFrame(pixels, "image_id long, x int, y int, b int, g int, r int"),
        spark.createDataFrame(fragments, FRAGMENT), spark.createDataFrame(places, GAZ),
        spark.createDataFrame(nodes, "id long, lat double, lon double"), spark.createDataFrame(edges, "u long, v long, length double"),
        "now", folder=str(tmp_path), min_confidence=0.5,
    )
    got = {r["id"]: r for r in outcomes.collect()}
    assert got[1]["failure"] is None and got[1]["gpx_path"] == "gpx/route_00001.gpx" and got[1]["n_gcps"] == 6
    assert got[1]["confidence"] > 0.5 and "<rtept" in (tmp_path / "gpx" / "route_00001.gpx").read_text()
    assert got[2]["failure"].startswith("contour") and got[3]["failure"].startswith("crossref")
    assert got[4]["failure"].startswith("ocr") and got[5]["failure"].startswith("fetch")
    assert after.filter("reconstruction_attempted_at IS NULL").count() == 0
    funnel = {r["stage"]: r["n"] for r in jobs.batch_funnel(outcomes).collect()}
    assert funnel == {"fetch": 1, "contour": 1, "ocr": 1, "crossref": 1, "shipped": 1}
