"""The catalogue as numbered snapshots that streams fold their batches into.

``root/pointers/<number>`` is a small JSON file that names a snapshot folder and, for every stream, the last batch the
snapshot holds. A fold writes a whole snapshot under a name of its own and then moves the next pointer into place, so
readers see the old state or the new one and never half; a job that dies in between leaves a folder nobody reads. A batch
whose number the pointer already holds is skipped, so replays change nothing. One job at a time may fold.

A fold reads and writes the catalogue once, whatever number of batches it takes in: fold change logs and attempts at
long intervals. Reads in between merge only the batches after the snapshot.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from routewright import schemas
from routewright.session import drop_path
from routewright.streaming.jobs import current_catalogue, latest_attempts, read_changes

CHANGES = "changes"


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def _pointers(spark: SparkSession, root: str) -> list[str]:
    return [n for n in _names(spark, f"{root}/pointers") if n.isdigit()]


def pointer(spark: SparkSession, root: str) -> dict:
    """``version``, ``snapshot`` (None before the first) and ``batches``: the last batch of each stream in the snapshot."""
    numbers = _pointers(spark, root)
    if not numbers:
        return {"version": 0, "snapshot": None, "batches": {}}
    return json.loads(spark.read.text(f"{root}/pointers/{numbers[-1]}", wholetext=True).first()[0])


def last_batch(spark: SparkSession, changes: str) -> int:
    """Highest number of a change batch that was written to its end, -1 for none."""
    fs, _ = _files(spark, changes)
    done = [-1]
    for name in _names(spark, changes):
        if name.startswith("batch_id=") and fs.exists(_files(spark, f"{changes}/{name}/_SUCCESS")[1]):
            done.append(int(name.removeprefix("batch_id=")))
    return max(done)


def load_catalogue(spark: SparkSession, root: str, changes: str | None = None, base: DataFrame | None = None) -> DataFrame:
    """The newest snapshot, or ``base`` before the first, with the change batches after it merged in."""
    return _state(spark, pointer(spark, root), changes, base, None if changes is None else last_batch(spark, changes))


def _state(spark: SparkSession, at: dict, changes: str | None, base: DataFrame | None, upto: int | None) -> DataFrame:
    if at["snapshot"] is not None:
        known = spark.read.schema(schemas.CATALOGUE).parquet(at["snapshot"])
    else:
        known = base if base is not None else spark.createDataFrame([], schemas.CATALOGUE)
    held = at["batches"].get(CHANGES, -1)
    if changes is None or upto <= held:
        return known
    return current_catalogue(known, read_changes(spark, changes, held, upto))


def _publish(spark: SparkSession, root: str, at: dict, rows: DataFrame, batches: dict) -> int:
    snapshot = f"{root}/snapshots/{uuid.uuid4().hex}"
    rows.select(*schemas.CATALOGUE_COLUMNS).write.parquet(snapshot)
    version = at["version"] + 1
    fs, staged = _files(spark, f"{root}/pointers/.{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps({"version": version, "snapshot": snapshot, "batches": {**at["batches"], **batches}}).encode()))
    out.close()
    target = _files(spark, f"{root}/pointers/{version:012d}")[1]
    if fs.exists(target) or not fs.rename(staged, target):
        raise RuntimeError(f"another job published version {version} of {root}")
    return version


def compact_changes(spark: SparkSession, root: str, changes: str, base: DataFrame | None = None) -> int:
    """Fold the finished change batches into a new snapshot; returns the version readers see from now on."""
    at, upto = pointer(spark, root), last_batch(spark, changes)
    if upto <= at["batches"].get(CHANGES, -1):
        return at["version"]
    return _publish(spark, root, at, _state(spark, at, changes, base, upto), {CHANGES: upto})


def expire(spark: SparkSession, root: str, keep: int = 2, changes: str | None = None) -> None:
    """Delete pointers and snapshots but for the newest ``keep``, and the change batches the oldest of those holds."""
    numbers = _pointers(spark, root)
    kept = [json.loads(spark.read.text(f"{root}/pointers/{n}", wholetext=True).first()[0]) for n in numbers[-keep:]]
    if not kept:
        return
    for number in numbers[:-keep]:
        drop_path(spark, f"{root}/pointers/{number}")
    used = {at["snapshot"].rsplit("/", 1)[1] for at in kept}
    for name in set(_names(spark, f"{root}/snapshots")) - used:
        drop_path(spark, f"{root}/snapshots/{name}")
    if changes is not None:
        held = kept[0]["batches"].get(CHANGES, -1)
        for name in _names(spark, changes):
            if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) <= held:
                drop_path(spark, f"{changes}/{name}")


def merge_attempts(
    spark: SparkSession, root: str, stream: str, batch_id: int, outcomes: DataFrame,
    apply: Callable[[DataFrame, DataFrame], DataFrame], mark: str, changes: str | None = None, base: DataFrame | None = None,
) -> int:
    """Fold one batch of attempt outcomes of ``stream`` into the catalogue; returns the version that holds it.

    ``apply`` is :func:`catalogue.apply_label_geocode` or :func:`catalogue.apply_reconstruction`, ``mark`` the column it
    stamps. Of several outcomes of an id the last counts, and none older than the attempt the catalogue has. Outcomes of
    unknown ids change nothing.
    """
    at = pointer(spark, root)
    if at["batches"].get(stream, -1) >= batch_id:
        return at["version"]
    upto = None if changes is None else last_batch(spark, changes)
    known = _state(spark, at, changes, base, upto)
    before = known.select("id", F.col(mark).alias("_before"))
    newer = latest_attempts(outcomes).join(before, "id").filter(
        F.col("_before").isNull() | (F.col("_before") <= F.col("attempted_at"))).drop("_before")
    batches = {stream: batch_id} if changes is None else {stream: batch_id, CHANGES: max(upto, at["batches"].get(CHANGES, -1))}
    return _publish(spark, root, at, apply(known, newer), batches)


def stream_attempts_to_catalogue(
    outcomes: DataFrame, root: str, stream: str, checkpoint: str, apply: Callable[[DataFrame, DataFrame], DataFrame], mark: str,
    lateness: str = "1 hour", changes: str | None = None, base: DataFrame | None = None, **trigger,
) -> StreamingQuery:
    """Every attempt (id, attempt_no, attempted_ts, attempted_at, outcome columns) once into the catalogue under ``root``."""
    unique = outcomes.withWatermark("attempted_ts", lateness).dropDuplicatesWithinWatermark(["id", "attempt_no"])

    def fold(batch: DataFrame, batch_id: int) -> None:
        merge_attempts(batch.sparkSession, root, stream, batch_id, batch, apply, mark, changes, base)

    return unique.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()
