import datetime as dt

import pytest
from pyspark.sql import functions as F

from routewright import schemas
from routewright.operators.lines import as_points
from routewright.sinks import writers
from routewright.sources import readers
from routewright.streaming import jobs as streams

LINE = "id long, line array<struct<lat:double,lon:double>>"


def rows(spark, *lines):
    return spark.createDataFrame([(i, [tuple(p) for p in line]) for i, line in enumerate(lines)], LINE)


def test_route_document_skips_bad_points_and_may_be_empty(spark):
    nan = float("nan")
    df = rows(spark, [(51.5, -0.1), (nan, 0.0), (91.0, 0.0), (1e-7, 179.0)], [])
    text = F.lit("A & <B>")
    docs = [r[0] for r in df.orderBy("id").select(writers.gpx_route(F.col("line"), text, text, text, F.array(F.lit("k1"), F.lit("k2")))).collect()]
    assert docs[0].count("<rtept") == 2 and 'lat="51.5" lon="-0.1"' in docs[0] and 'lat="0.0000001"' in docs[0]
    assert "<keywords>k1, k2</keywords>" in docs[0] and "<name>A &amp; &lt;B&gt;</name>" in docs[0]
    assert "<rte>" in docs[1] and "<rtept" not in docs[1]


def test_empty_lines_are_an_error_for_full_documents(spark):
    name = F.lit("n")
    for document in (writers.gpx_route_and_track(F.col("line"), name, name, "t"), writers.kml_line(F.col("line"), name, name)):
        with pytest.raises(Exception, match="line is empty"):
            rows(spark, []).select(document).collect()


def test_documents_round_trip_through_files(spark, tmp_path):
    df = rows(spark, [(51.123456, -0.25), (51.5, 0.75)], [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)])
    name = F.concat(F.lit("n"), F.col("id").cast("string"))
    for sub, document in (("g", writers.gpx_route_and_track(F.col("line"), name, name, "2024-01-01T00:00:00Z")), ("k", writers.kml_line(F.col("line"), name, name))):
        out = df.select("id", F.concat(F.lit(f"{sub}/"), name, F.lit(".xml")).alias("path"), document.alias("body"))
        assert writers.write_documents(out, str(tmp_path)).count() == 2
    want = sorted([[(51.123456, -0.25), (51.5, 0.75)], [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]])
    for found in (readers.read_gpx(spark, str(tmp_path / "g")), readers.read_gpx(spark, str(tmp_path / "g"), "trk"), readers.read_kml(spark, str(tmp_path / "k"))):
        assert sorted([(p["lat"], p["lon"]) for p in r["line"]] for r in found.collect()) == want
    assert {r["name"] for r in readers.read_gpx(spark, str(tmp_path / "g")).collect()} == {"n0", "n1"}


def test_kml_style_and_order(spark):
    doc = rows(spark, [(51.5, -0.1)]).select(writers.kml_line(F.col("line"), F.lit("a"), F.lit("b"))).first()[0]
    assert "<coordinates>-0.100000,51.500000,0</coordinates>" in doc and "<color>ffe8731a</color>" in doc and "<width>4</width>" in doc


def test_geojson_flips_order(spark):
    df = rows(spark, [(51.5, -0.1), (52.0, 0.5)]).withColumn("j", writers.to_geojson(F.col("line")))
    assert df.first()["j"] == '{"type":"LineString","coordinates":[[-0.1,51.5],[0.5,52.0]]}'
    assert [tuple(p) for p in df.select(readers.from_geojson(F.col("j"))).first()[0]] == [(51.5, -0.1), (52.0, 0.5)]


def test_only_good_routes_are_shipped(spark):
    df = spark.createDataFrame([(7, "<gpx/>", 0.6), (8, "<gpx/>", 0.59), (9, None, 0.9), (123456, "x", 0.9)], "id long, gpx_xml string, confidence double")
    assert {r["id"]: r["gpx_path"] for r in writers.shippable(df).collect()} == {7: "gpx/route_00007.gpx", 123456: "gpx/route_123456.gpx"}


def test_routing_answers_split(spark):
    bodies = ['{"code":"Ok","routes":[{"geometry":{"coordinates":[[2.0,1.0],[4.0,3.0]]},"distance":5,"duration":6}]}',
              '{"code":"NoRoute","message":"m"}', '{"code":"Ok","routes":[]}', "oops"]
    routes, rejects = readers.parse_routing_responses(spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string"))
    only = routes.first()
    assert [tuple(p) for p in only["line"]] == [(1.0, 2.0), (3.0, 4.0)] and only["distance_m"] == 5.0
    assert {r["request_id"]: (r["code"], r["message"]) for r in rejects.collect()} == {1: ("NoRoute", "m"), 2: ("Ok", ""), 3: (None, "")}


def test_failed_calls_are_not_negatives(spark):
    df = spark.createDataFrame([("a", "A", "[]"), ("b", "B", "<html>"), ("c", "C", '[{"lat":"1","lon":"2"}]')], "key string, raw_query string, body string")
    hits, negatives = readers.parse_place_responses(df)
    assert [(r["key"], r["display_name"]) for r in hits.collect()] == [("c", "C")] and [r["key"] for r in negatives.collect()] == ["a"]


TILE = "title string, image_url string, thumbnail_url string, category string, page_url string, scraped_at string"


def test_streamed_index_equals_replay(spark, tmp_path):
    source, changes, checkpoint = (str(tmp_path / p) for p in ("in", "changes", "cp"))
    hits = spark.createDataFrame([("leeds, united kingdom", 53.8, -1.5, "United Kingdom")], "key string, lat double, lon double, country string")
    base = spark.createDataFrame([], schemas.CATALOGUE)

    def arrive(*named):
        spark.createDataFrame([(t, u, None, "c", "p", "s") for t, u in named], TILE).coalesce(1).write.mode("append").json(source)
        streams.stream_index(spark.readStream.schema(TILE).json(source), hits, changes, checkpoint).awaitTermination()
        return {r["image_url"]: r for r in streams.current_catalogue(base, streams.read_changes(spark, changes)).collect()}

    arrive(("LEEDS GOAT", "u1"), ("GOAT", "u2"))
    got = arrive(("BETTER GOAT", "u2"), ("LEEDS OWL", "u3"))
    assert len(got) == 3 and got["u2"]["title"] == "BETTER GOAT" and got["u1"]["lat"] == 53.8
    assert {got[u]["id"] for u in got} == {1, 2, 3} and got["u3"]["id"] == 3
    again = arrive()
    assert {u: r["id"] for u, r in again.items()} == {u: r["id"] for u, r in got.items()}


def test_share_stream_agrees_with_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    data = [(f"s{i:03}", start + dt.timedelta(hours=(i * 37) % 300), f"{{\"n\": {i}}}") for i in range(400)]
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "cp"))
    for part in (data[:150], data[150:]):
        spark.createDataFrame(part, "share_id string, created_at timestamp, payload string").write.mode("append").parquet(source)
    stream = spark.readStream.schema("share_id string, created_at timestamp, payload string").option("maxFilesPerTrigger", 3).parquet(source)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = streams.stream_shares(stream, "30 days", cap=50).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    now = F.lit(max(t for _, t, _ in data))
    all_rows = spark.createDataFrame(data, "share_id string, created_at timestamp, payload string")
    want = [(r["share_id"], r["payload"]) for r in streams.live_shares(all_rows, now, cap=50).collect()]
    emitted = spark.read.option("basePath", out).parquet(out)
    got = [(r["share_id"], r["payload"]) for r in streams.merge_shards(emitted, now, cap=50).collect()]
    assert got == want and len(got) == 50
    asked = spark.createDataFrame([(want[3][0],), ("s999",), ], "share_id string")
    assert [(r["share_id"], r["payload"]) for r in streams.find_shares(emitted, asked, now, cap=50).collect()] == [want[3]]
    assert streams.live_shares(all_rows, F.lit(dt.datetime(2024, 3, 1))).count() == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from routewright.session import shared_dir

    nothing = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: nothing, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=context, conf=nothing))


def test_attempts_are_recorded_once(spark, tmp_path):
    rows = [(i % 5, i % 2, dt.datetime(2024, 1, 1, i % 24), f"o{i % 2}") for i in range(40)]
    source, ledger, checkpoint = (str(tmp_path / p) for p in ("in", "ledger", "cp"))
    schema = "id long, attempt_no int, attempted_ts timestamp, outcome string"
    spark.createDataFrame(rows, schema).write.parquet(source)
    streams.stream_attempts(spark.readStream.schema(schema).parquet(source), ledger, checkpoint, "2 days").awaitTermination()
    kept = spark.read.option("basePath", ledger).parquet(ledger)
    assert kept.count() == 10
    latest = streams.latest_attempts(kept.drop("batch_id")).collect()
    assert len(latest) == 5
