import datetime as dt
import json
import os
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from routewright import schemas
from routewright.operators import catalogue as cat
from routewright.streaming import jobs as streams
from routewright.streaming import store

TILE = "title string, image_url string, thumbnail_url string, category string, page_url string, scraped_at string"
OUTCOME = "id long, attempt_no int, attempted_ts timestamp, attempted_at string, gpx_path string, confidence double, failure string"


@pytest.fixture()
def place(spark, tmp_path):
    """A catalogue under a store that tiles stream into: (arrive, root, changes)."""
    source, changes, checkpoint, root = (str(tmp_path / p) for p in ("in", "changes", "cp", "store"))

    def arrive(*named):
        spark.createDataFrame([(t, u, None, "c", "p", "s") for t, u in named], TILE).coalesce(1).write.mode("append").json(source)
        streams.stream_index(spark.readStream.schema(TILE).json(source), None, changes, checkpoint).awaitTermination()

    return arrive, root, changes


def shown(df, *cols):
    return {r["image_url"]: tuple(r[c] for c in ("id", "title", *cols)) for r in df.collect()}


def outcome(i, no, hour, path=None, failure=None):
    at = dt.datetime(2024, 1, 1, hour)
    return (i, no, at, at.isoformat(), path, 0.9 if path else 0.1, failure)


def test_compaction_leaves_the_same_catalogue_and_reads_less(spark, place):
    arrive, root, changes = place
    assert store.load_catalogue(spark, root).count() == 0 and store.pointer(spark, root)["version"] == 0
    arrive(("Goat", "u1"), ("Owl", "u2"))
    arrive(("Better Owl", "u2"), ("Cat", "u3"))
    base = spark.createDataFrame([], schemas.CATALOGUE)
    want = shown(streams.current_catalogue(base, streams.read_changes(spark, changes)))
    assert shown(store.load_catalogue(spark, root, changes)) == want and want["u2"][1] == "Better Owl"
    assert store.compact_changes(spark, root, changes) == 1 == store.compact_changes(spark, root, changes)
    assert shown(store.load_catalogue(spark, root, changes)) == want == shown(store.load_catalogue(spark, root))
    files = store.load_catalogue(spark, root, changes).inputFiles()
    assert files and all("/snapshots/" in f for f in files)
    arrive(("Dog", "u4"), ("Best Owl", "u2"))
    held = store.pointer(spark, root)["batches"]["changes"]
    plan = streams.read_changes(spark, changes, held, store.last_batch(spark, changes))._jdf.queryExecution().executedPlan().toString()
    assert held == 1 and re.search(r"PartitionFilters: \[[^]]*batch_id#\d+ > 1\)", plan), plan
    got = shown(store.load_catalogue(spark, root, changes))
    assert got["u2"] == (want["u2"][0], "Best Owl") and got["u4"][0] == 4
    assert store.compact_changes(spark, root, changes) == 2
    store.expire(spark, root, keep=1, changes=changes)
    assert shown(store.load_catalogue(spark, root, changes)) == got and len(os.listdir(f"{root}/snapshots")) == 1
    arrive(("Fox", "u5"))
    assert len(store.load_catalogue(spark, root, changes).collect()) == 5


def test_a_job_that_dies_before_the_switch_changes_nothing(spark, place, monkeypatch):
    arrive, root, changes = place
    arrive(("Goat", "u1"))
    store.compact_changes(spark, root, changes)
    arrive(("Owl", "u2"))
    want = shown(store.load_catalogue(spark, root, changes))

    def die(text, *args, **kwargs):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "json", SimpleNamespace(loads=json.loads, dumps=die))
    with pytest.raises(KeyboardInterrupt):
        store.compact_changes(spark, root, changes)
    monkeypatch.undo()
    assert store.pointer(spark, root)["version"] == 1 and len(os.listdir(f"{root}/snapshots")) == 2
    assert shown(store.load_catalogue(spark, root, changes)) == want
    assert store.compact_changes(spark, root, changes) == 2
    assert shown(store.load_catalogue(spark, root, changes)) == want == shown(store.load_catalogue(spark, root))
    store.expire(spark, root, keep=1)
    assert len(os.listdir(f"{root}/snapshots")) == 1


def test_an_unfinished_batch_waits(spark, place):
    arrive, root, changes = place
    arrive(("Goat", "u1"))
    arrive(("Owl", "u2"))
    os.remove(f"{changes}/batch_id=1/_SUCCESS")
    assert store.last_batch(spark, changes) == 0 and set(shown(store.load_catalogue(spark, root, changes))) == {"u1"}


def test_replayed_attempts_change_nothing(spark, place):
    arrive, root, changes = place
    arrive(("Goat", "u1"), ("Owl", "u2"))
    rows = [outcome(1, 0, 3, failure="ocr: none"), outcome(1, 1, 5, "gpx/1"), outcome(2, 0, 4, failure="fetch: lost"), outcome(99, 0, 1, "gpx/99")]
    first = spark.createDataFrame(rows, OUTCOME)
    kind = ("rebuild", 0, first, cat.apply_reconstruction, "reconstruction_attempted_at", changes)
    assert store.merge_attempts(spark, root, *kind) == 1
    state = shown(store.load_catalogue(spark, root, changes), "gpx_path", "reconstruction_failure")
    assert state == {"u1": (1, "Goat", "gpx/1", None), "u2": (2, "Owl", None, "fetch: lost")}
    assert store.merge_attempts(spark, root, *kind) == 1
    assert store.pointer(spark, root)["batches"] == {"changes": 0, "rebuild": 0}
    late = spark.createDataFrame([outcome(1, 2, 4, failure="old news"), outcome(2, 1, 6, "gpx/2")], OUTCOME)
    assert store.merge_attempts(spark, root, "rebuild", 1, late, cat.apply_reconstruction, "reconstruction_attempted_at", changes) == 2
    state = shown(store.load_catalogue(spark, root, changes), "gpx_path", "reconstruction_failure")
    assert state == {"u1": (1, "Goat", "gpx/1", None), "u2": (2, "Owl", "gpx/2", None)}


def test_streamed_attempts_reach_the_catalogue(spark, place, tmp_path):
    arrive, root, changes = place
    arrive(("Goat", "u1"), ("Owl", "u2"))
    source = str(tmp_path / "attempts")
    rows = [outcome(1, 0, 3, "gpx/1"), outcome(1, 0, 3, "gpx/1"), outcome(2, 0, 4, failure="fetch: lost")]
    spark.createDataFrame(rows, OUTCOME).write.parquet(source)
    for _ in range(2):
        store.stream_attempts_to_catalogue(
            spark.readStream.schema(OUTCOME).parquet(source), root, "rebuild", str(tmp_path / "cp2"), cat.apply_reconstruction,
            "reconstruction_attempted_at", changes=changes).awaitTermination()
    state = shown(store.load_catalogue(spark, root, changes), "gpx_path", "reconstruction_failure")
    assert state == {"u1": (1, "Goat", "gpx/1", None), "u2": (2, "Owl", None, "fetch: lost")}


def test_a_silent_shard_loses_its_shares(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "cp"))
    schema, start = "share_id string, created_at timestamp, payload string", dt.datetime(2024, 1, 1)
    shard = {i: spark.range(1).select(F.pmod(F.xxhash64(F.lit(i)), F.lit(64))).first()[0] for i in ("a", "b", "c")}
    assert shard["a"] != shard["b"]

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    def arrive(*rows):
        spark.createDataFrame([(i, start + dt.timedelta(days=d), "{}") for i, d in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        streams.stream_shares(stream).writeStream.outputMode("update").foreachBatch(keep).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        emitted = spark.read.option("basePath", out).parquet(out)
        latest = emitted.groupBy("shard").agg(F.max("version").alias("version"))
        return {r["share_id"] for r in emitted.join(latest, ["shard", "version"]).collect()} - {None}, emitted

    assert arrive(("a", 0), ("b", 1))[0] == {"a", "b"}
    held, emitted = arrive(("c", 9))
    assert held == {"c"}
    assert streams.merge_shards(emitted, F.lit(start + dt.timedelta(days=9))).select("share_id").first()[0] == "c"
    assert arrive(("a", 10))[0] == {"a", "c"}
