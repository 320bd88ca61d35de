"""Tables that grow with the input are merged, never sent through the driver as broadcasts, however small their files are."""

from pyspark.sql import functions as F

from routewright import schemas
from routewright.operators import crossref, georef, labels
from routewright.plans import jobs
from routewright.session import cut_lineage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_merged(spark):
    left = cut_lineage(spark.range(1000).withColumn("v", F.lit("x")))
    right = cut_lineage(spark.range(900))
    exploded = left.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(9)))).groupBy("id").agg(F.max("n").alias("n"))
    for joined in (left.join(right, "id"), exploded.join(right, "id", "left_anti"), spark.range(50).join(left, "id", "left_semi")):
        assert "Broadcast" not in plan(joined)
    assert left.join(right, "id").count() == 900


def test_clusters_are_merged_with_their_points(spark):
    points = spark.createDataFrame([(1, 51.0, 0.0), (1, 51.001, 0.0), (2, 51.0, 0.0)], "image_id long, lat double, lon double")
    found = crossref.single_link_clusters(points, 3.0)
    assert "Broadcast" not in plan(found) and found.count() == 3


def test_indexed_tiles_are_parsed_and_written_once(spark):
    tiles = spark.createDataFrame([(0, "OSLO Hare", "misc", "u0", "p", "s"), (1, "Hare", "misc", "u1", "p", "s")],
                                  "position long, title string, category string, image_url string, page_url string, scraped_at string")
    hits = spark.createDataFrame([("oslo, norway", 1.0, 2.0, "Norway")], "key string, lat double, lon double, country string")
    rows, counts = jobs.index_batch(tiles, hits, spark.createDataFrame([], schemas.CATALOGUE))
    assert "regexp" not in plan(counts) and counts.collect()[0].asDict() == {"rows": 2, "geocoded": 1} and rows.count() == 2


def test_street_lookups_are_merged(spark, tmp_path):
    asked = spark.createDataFrame(
        [(1, "elm road", "Elm Road", 0.9, 0.0, 0.0, 1)], "image_id long, name_key string, normalized string, confidence double, band_y double, band_x double, part long")
    places = spark.createDataFrame([(1, "Elm Road", None, 51.0, 0.0, "Aton", "X", 1.0)],
                                   "place_id long, name string, name_en string, lat double, lon double, city string, country string, importance double")
    asked.write.parquet(f"{tmp_path}/asked")
    places.write.parquet(f"{tmp_path}/places")
    found = crossref.match_streets(spark.read.parquet(f"{tmp_path}/asked"), spark.read.parquet(f"{tmp_path}/places"))
    joins = [line for line in plan(found).splitlines() if "Join" in line and "LeftSemi" not in line]
    assert all("SortMergeJoin" in line for line in joins[:2]) and found.count() == 1


def test_fits_are_merged_with_their_pixels(spark):
    rows = [(1, float(x), float(y), 51.5 - y / 1e5, x / 6e4, f"L{x}", 0.5) for x, y in ((10, 10), (200, 30), (90, 250), (300, 310), (20, 200))]
    gcps = spark.createDataFrame(rows, "image_id long, x_px double, y_px double, lat double, lon double, label string, weight double")
    fits, _ = georef.fit_affine(gcps)
    placed = georef.project_pixels(gcps.select("image_id", "label", F.col("x_px").alias("x"), F.col("y_px").alias("y")), fits)
    located = georef.locate_pixels(gcps.select("image_id", "label", "lat", "lon"), fits)
    for df in (fits, placed, located):
        assert "Broadcast" not in plan(df)
    assert placed.count() == located.count() == 5


def test_steps_of_a_fit_are_written_apart(spark):
    """One join per written step: memory of a task adds up over the joins and aggregations that share its stage."""
    rows = [(1, float(x), float(y), 51.5 - y / 1e5, x / 6e4, f"L{x}", 0.5) for x, y in ((10, 10), (200, 30), (90, 250), (300, 310), (20, 200))]
    gcps = spark.createDataFrame(rows, "image_id long, x_px double, y_px double, lat double, lon double, label string, weight double")
    fits, _ = georef.fit_affine(gcps)
    plain, _ = georef.fit_affine(gcps.drop("label"), drop_outliers=False)
    assert plan(fits).count("SortMergeJoin") == 1 and plan(plain).count("SortMergeJoin") == 1
    assert [r["n_anchors"] for r in fits.collect() + plain.collect()] == [5, 5]


def test_texts_are_parsed_before_they_meet_labels(spark):
    rows = [(i, text, 0.9, 1.0, 2.0, 2.0, 1.0, 1) for i in range(40) for text in ("Elm Road", "13", None)]
    found = labels.parse_labels(spark.createDataFrame(
        rows, "image_id long, text string, conf double, x_center double, y_center double, band_y double, band_x double, part long"))
    assert "regexp_extract" not in plan(found) and found.filter("normalized = 'Elm Road'").count() == found.count() == 40


def test_hits_are_dealt_by_image(spark):
    """Hits are many times the rows they come from: as many tasks as a shuffle has hold them, not as many as the names are worth."""
    asked = spark.range(50).selectExpr("id AS image_id", "'elm road' AS name_key", "'Elm Road' AS normalized", "0.9D AS confidence",
                                       "0D AS band_y", "0D AS band_x", "1L AS part")
    places = spark.range(30).selectExpr("id AS place_id", "'Elm Road' AS name", "CAST(NULL AS STRING) AS name_en", "51D AS lat", "0D AS lon",
                                        "concat('City ', id % 7) AS city", "'X' AS country", "1D AS importance")
    found = crossref.match_streets(asked, places)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.count() == 50 * 30
    checked = crossref.verify_city_hypotheses(crossref.city_hypotheses(found), asked, found, places)
    assert checked.count() == 50 * 30 and plan(checked).count("regexp_replace") == 0


def test_clusters_are_scored_in_one_shuffle(spark):
    rows = [(1, 7, street, 0.5, n, 51.0, 0.0, "Aton", "X") for n, street in enumerate(("Elm Road", "Oak Lane", "Elm Road"))]
    clustered = spark.createDataFrame(rows, "image_id long, component long, street string, confidence double, hit_no int, lat double, "
                                            "lon double, city string, country string")
    scored = crossref.score_clusters(clustered, 2)
    assert plan(scored).count("Exchange hashpartitioning") == 1 and [(r["n_names"], r["n_ways"]) for r in scored.collect()] == [(2, 3)]
