"""Images located by the city check are merged with their work rows, not broadcast."""

from routewright.operators import crossref


def test_clusters_of_both_passes_are_merged(spark):
    asked = spark.createDataFrame(
        [(1, "elm road", "Elm Road", 0.9, 0.0, 0.0, 1), (1, "oak lane", "Oak Lane", 0.8, 1.0, 0.0, 1)],
        "image_id long, name_key string, normalized string, confidence double, band_y double, band_x double, part long")
    places = spark.createDataFrame(
        [(1, "Elm Road", None, 51.0, 0.0, "Aton", "X", 1.0), (2, "Oak Lane", None, 51.5, 0.0, "Aton", "X", 1.0)],
        "place_id long, name string, name_en string, lat double, lon double, city string, country string, importance double")
    clusters, _ = crossref.find_geocodes(asked, places, 2, 3.0)
    joined = spark.range(5).withColumnRenamed("id", "image_id").join(clusters.select("image_id", "city"), "image_id", "left")
    last = [line for line in joined._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line][0]
    assert "SortMergeJoin" in last
    assert [r["city"] for r in joined.filter("image_id = 1").collect()] == ["Aton"]
