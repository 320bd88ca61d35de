import json

import pytest
from pyspark.sql import functions as F

from routewright import dims, schemas
from routewright.operators import catalogue as cat
from routewright.operators import search
from routewright.plans import jobs
from routewright.sources import readers


def tile(position, title, url, category="mammals"):
    return (position, title, url, None, category, "https://site.example.org/p", "2024-01-01")


TILES = ("position long, title string, image_url string, thumbnail_url string, category string, page_url string, "
         "scraped_at string")
HITS = "key string, lat double, lon double, country string"


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], schemas.CATALOGUE)


def index(spark, rows, old, hits=(("leeds, united kingdom", 53.8, -1.5, "United Kingdom"), ("ulan bator", 47.9, 106.9, "Mongolia"))):
    return jobs.index_batch(spark.createDataFrame(rows, TILES), spark.createDataFrame(list(hits), HITS), old)


def test_index_geocodes_and_demotes_misses(spark, empty):
    rows = [tile(0, "LEEDS GOAT", "u0"), tile(1, "Goat, Ulan Bator", "u1"), tile(2, "OSLO GOAT", "u2"), tile(3, "GOAT", "u3")]
    out, counts = index(spark, rows, empty)
    got = {r["image_url"]: r for r in out.collect()}
    assert [got[f"u{i}"]["id"] for i in range(4)] == [1, 2, 3, 4]
    assert got["u0"]["lat"] == 53.8 and got["u0"]["geocode_confidence"] == 1.0 and got["u0"]["subcategory"] == "GOAT"
    assert got["u1"]["country"] == "Mongolia" and got["u1"]["geocode_confidence"] == 0.5
    assert got["u2"]["lat"] is None and got["u2"]["geocode_confidence"] == 0.25
    assert got["u3"]["city"] is None and tuple(counts.first()) == (4, 2)


def test_reindex_keeps_ids_and_reconstruction_but_resets_labels(spark, empty):
    first, _ = index(spark, [tile(0, "LEEDS GOAT", "u0"), tile(1, "GOAT", "u1")], empty)
    update = spark.createDataFrame([(2, 1.0, 2.0, 0.8, '["A"]', "t", "Town", None)],
                                   "id long, lat double, lon double, confidence double, streets_json string, attempted_at string, city string, country string")
    labelled = cat.apply_label_geocode(first, update)
    done = cat.apply_reconstruction(labelled, spark.createDataFrame([(2, "gpx/x", 0.9, "t", None)], "id long, gpx_path string, confidence double, attempted_at string, failure string"))
    got = {r["image_url"]: r for r in done.collect()}
    assert (got["u1"]["geocode_source"], got["u1"]["city"], got["u1"]["gpx_path"]) == ("ocr", "Town", "gpx/x")
    again, _ = index(spark, [tile(0, "OLD GOAT", "u1"), tile(1, "NEWER GOAT", "u1"), tile(2, "GOAT", "u9")], done)
    got = {r["image_url"]: r for r in again.collect()}
    assert len(got) == 3 and got["u9"]["id"] == 3 and got["u1"]["id"] == 2 and got["u1"]["title"] == "NEWER GOAT"
    assert got["u1"]["lat"] is None and got["u1"]["geocode_source"] == "title" and got["u1"]["gpx_path"] == "gpx/x"
    assert got["u0"]["lat"] == 53.8
    fresh = cat.catalogue_rows(cat.parse_titles(spark.createDataFrame([tile(0, "GOAT", "u1")], TILES)).withColumns(
        {"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")}))
    kept = cat.upsert_catalogue(fresh, done, preserve_labels=True).filter("image_url = 'u1'").first()
    assert kept["lat"] == 1.0 and kept["geocode_source"] == "ocr" and kept["ocr_streets"] == '["A"]'


def test_failed_label_attempt_is_marked(spark, empty):
    rows, _ = index(spark, [tile(0, "GOAT", "u0"), tile(1, "GOAT", "u1")], empty)
    update = spark.createDataFrame([(1, None, None, 0.0, "[]", "t", None, None)],
                                   "id long, lat double, lon double, confidence double, streets_json string, attempted_at string, city string, country string")
    after = cat.apply_label_geocode(rows, update)
    assert after.filter("id = 1").first()["geocode_source"] == "ocr-failed"
    assert [r["id"] for r in cat.needs_label_geocode(after).collect()] == [2]
    assert [r["id"] for r in cat.needs_label_geocode(after, retry_attempted=True, limit=1).collect()] == [1]
    assert cat.needs_label_geocode(after, categories=["birds"]).count() == 0


def test_evolve_schema_is_additive_and_idempotent(spark):
    old = spark.createDataFrame([(1, "x")], "id long, title string")
    once = cat.evolve_schema(old)
    assert once.first()["geocode_source"] == "title" and cat.evolve_schema(once).columns == once.columns


def test_empty_reports(spark):
    outcomes = spark.createDataFrame([], "id long, candidates long, cluster_lat double, error string")
    assert tuple(cat.label_geocode_summary(outcomes).first()) == (0, 0, 0.0, 0, 0, 0)
    none = spark.createDataFrame([], "gpx_path string, failure string, confidence double")
    assert tuple(cat.reconstruction_summary(none).first()) == (0, 0, None, None, None)


def test_summary_orders_failures(spark):
    rows = [(None, "ocr: a", 0.0), (None, "ocr: b", 0.0), (None, None, 0.2), ("gpx/1", None, 0.8), (None, "georef: x", 0.0)]
    got = cat.reconstruction_summary(spark.createDataFrame(rows, "gpx_path string, failure string, confidence double")).first()
    assert [tuple(m) for m in got["failure_modes"]] == [("ocr", 2), ("georef", 1), ("unknown", 1)]
    assert got["ship_rate"] == 0.2 and got["mean_confidence"] == 0.2


def test_category_resolution_order(spark):
    terms = [("Dog",), ("dog ",), ("BIRDS",), ("zzz",), (None,), ("",), ("yak",)]
    table = spark.createDataFrame([("yak", "special")], "term string, slug string")
    got = cat.resolve_category(spark.createDataFrame(terms, "t string"), "t", table).collect()
    assert {r["t"]: r["resolved"] for r in got} == {
        "Dog": "cats-dogs", "dog ": "cats-dogs", "BIRDS": "birds", "zzz": None, None: None, "": None, "yak": "special"
    }


def points(spark):
    rows = [(1, "mammals", 53.80, -1.50), (2, "mammals", 53.81, -1.50), (3, "birds", 53.80, -1.51), (4, "mammals", 51.5, 0.0),
            (5, "mammals", None, None), (6, "mammals", 0.0, 179.99), (7, "mammals", 0.0, -179.99)]
    rows += [(100 + i, "birds", 60.0, 10.0) for i in range(30)]
    return spark.createDataFrame(rows, "id long, category string, lat double, lon double")


def test_radius_search(spark):
    q = [(1, 53.8, -1.5, 30.0, None), (2, 53.8, -1.5, 30.0, "birds"), (3, 53.8, -1.5, 0.0, None), (4, 0.0, 180.0, 5.0, None),
         (5, 60.0, 10.0, 1.0, None), (6, 53.0, -1.0, 400.0, "mammals"), (7, 10.0, 10.0, 20000.0, None)]
    queries = spark.createDataFrame(q, "query_id int, lat double, lon double, radius_km double, category string")
    def run(**kw):
        out = {}
        for r in search.radius_search(queries, points(spark), 5, **kw).orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append(r["id"])
        return out
    got = run()
    assert got[1] == [1, 3, 2] and got[2] == [3] and 3 not in got and got[5] == [100, 101, 102, 103, 104]
    assert got[4] == [6] and got[6] == [2, 1, 4] or got[6] == [1, 2, 4]
    assert run(exact=True)[4] == [6, 7]
    one = search.search_near(points(spark), 53.8, -1.5, 30.0, limit=2)
    assert [r["id"] for r in one.collect()] == [1, 3]
    assert search.search_near(points(spark), 53.8, -1.5, 0).count() == 0


def test_equal_searches_are_made_once_and_meet_spots(spark, monkeypatch):
    """Many equal queries over crowded spots with ties; results as by brute force, probes as many as distinct queries."""
    rows = [(n, (None, "birds", "cats")[n % 3], 53.0 + n % 7 / 100, 1.0 + n % 5 / 100) for n in range(600)]
    asked = [(n, 53.0 + n % 2 / 50, 1.02, 2.0 + n % 3, (None, "birds")[n % 2]) for n in range(60)]
    catalogue = spark.createDataFrame(rows, "id long, category string, lat double, lon double")
    queries = spark.createDataFrame(asked, "query_id long, lat double, lon double, radius_km double, category string")
    probed, explode = [], search.geo.explode_cells

    def counted(df, *args):
        probed.append(df.count())
        return explode(df, *args)

    monkeypatch.setattr(search.geo, "explode_cells", counted)
    for limit in (4, 70):
        probed.clear()
        hits = search.radius_search(queries, catalogue, limit, True)
        want = queries.alias("q").join(catalogue.alias("c"), F.col("q.category").isNull() | (F.col("q.category") == F.col("c.category"))).withColumn(
            "d", search.geo.haversine(F.col("q.lat"), F.col("q.lon"), F.col("c.lat"), F.col("c.lon"), search.geo.SEARCH_RADIUS_KM)
        ).filter("d <= radius_km").groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, limit).alias("best"))
        got = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "distance_km", "id"))).alias("best"))
        assert {r[0]: [(i + 1, *x) for i, x in enumerate(r[1])] for r in want.collect()} == {r[0]: [tuple(x) for x in r[1]] for r in got.collect()}
        assert sum(probed) == 6


def test_search_pushes_its_box_to_the_scan(spark, tmp_path):
    points(spark).write.parquet(str(tmp_path / "p"))
    found = search.search_near(spark.read.parquet(str(tmp_path / "p")), 53.8, -1.5, 30.0, "birds")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(lat" in pushed and "EqualTo(category,birds)" in pushed


def test_tiles_follow_the_first_link_to_an_address(spark):
    html = ('<a href="https://cdn.x/1"><img src="/a" alt="One &amp; two"></a><a href="/local"><img alt="No"></a>'
            "<A class='t' HREF='https://cdn.x/2'>\n<img alt=' ' data-src='/b'></A><a href='https://cdn.x/2'><img alt='Late'></a>"
            '<a href="https://cdn.x/3"><img alt="SITE"></a><a href="https://cdn.x/4">text</a><a href="https://cdn.x/5"><img data-src="/c" alt="Five"></a>')
    pages = spark.createDataFrame([(1, "c", "p", html)], "page_id int, category string, page_url string, html string")
    got = readers.extract_tiles(pages, "cdn.x", "Site", "now").orderBy("pos").collect()
    assert [(r["title"], r["image_url"], r["thumbnail_url"]) for r in got] == [
        ("One & two", "https://cdn.x/1", "/a"), ("Five", "https://cdn.x/5", "/c")
    ]


def test_tile_lines_skip_blanks_and_fail_on_garbage(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text(json.dumps({"title": "A", "image_url": "u"}) + "\n\n" + json.dumps({"title": "B"}) + "\n")
    assert [r["title"] for r in readers.read_tiles(spark, str(good)).orderBy("position").collect()] == ["A", "B"]
    bad = tmp_path / "bad.json"
    bad.write_text('{"title": "A"}\n{"title": \n')
    with pytest.raises(Exception):
        readers.read_tiles(spark, str(bad)).collect()


def test_unreadable_cache_is_empty(spark, tmp_path):
    path = tmp_path / "cache.json"
    path.write_text("{not json")
    hits, negatives = readers.read_place_cache(spark, str(path))
    assert hits.count() == 0 and negatives.count() == 0


def test_index_batch_takes_cities_as_rows(spark):
    tiles = spark.createDataFrame([tile(0, "HARE ULAN BATOR", "u1"), tile(1, "OWL OSLO", "u2")], TILES)
    old = spark.createDataFrame([], schemas.CATALOGUE)
    cities = spark.createDataFrame([("Ulan Bator", "Mongolia")], "name string, country string")
    found = {}
    for given in (None, cities):
        after, _ = jobs.index_batch(tiles, None, old, given)
        found[given is None] = sorted((r["image_url"], r["city"], r["country"]) for r in after.collect())
    assert found[True] == [("u1", None, None), ("u2", "Oslo", "Norway")]
    assert found[False] == [("u1", "Ulan Bator", "Mongolia"), ("u2", None, None)]
