"""Structured Streaming jobs: incremental catalogue, attempt ledger, live shares."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from routewright.operators import catalogue as cat

# Life of a share and how many may live at once.
SHARE_TTL = timedelta(days=7)
SHARE_CAP = 1024
_SHARDS = 64


def _append_batch(path: str, prepare):
    """foreachBatch sink: each micro-batch owns one partition and rewrites it when retried."""
    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def stream_index(tiles: DataFrame, hits: DataFrame | None, changes: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Parse and geocode arriving tiles into a change log.

    A micro-batch costs what it holds: rows are appended under their batch number, and :func:`current_catalogue` merges
    the log by key. Tiles may carry their own ``position`` in the batch. Re-delivered tiles and retried batches leave the same catalogue.
    """
    def prepare(batch: DataFrame) -> DataFrame:
        placed = batch if "position" in batch.columns else batch.withColumn("position", F.monotonically_increasing_id())
        parsed = cat.parse_titles(placed)
        if hits is None:
            geocoded = parsed.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})
        else:
            geocoded = cat.geocode_titles(parsed, hits)
        return cat.catalogue_rows(geocoded)

    return (
        tiles.writeStream.foreachBatch(_append_batch(changes, prepare)).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_changes(spark: SparkSession, changes: str, after: int | None = None, upto: int | None = None) -> DataFrame:
    """Change log with one ``position`` that orders rows over all batches; ``after`` and ``upto`` prune batches unread."""
    rows = spark.read.option("basePath", changes).parquet(changes)
    if after is not None:
        rows = rows.filter(F.col("batch_id") > after)
    if upto is not None:
        rows = rows.filter(F.col("batch_id") <= upto)
    order = F.expr("CAST(batch_id AS DECIMAL(19, 0)) * CAST(9223372036854775808 AS DECIMAL(19, 0)) + position")
    return rows.withColumn("position", order).drop("batch_id")


def current_catalogue(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Snapshot: the last compacted catalogue with the change log merged in by key."""
    return cat.upsert_catalogue(changes, base)


def stream_attempts(attempts: DataFrame, ledger: str, checkpoint: str, lateness: str = "1 hour", **trigger) -> StreamingQuery:
    """Every attempt (id, attempted_ts, outcome columns) once into a ledger; late duplicates are dropped."""
    unique = attempts.withWatermark("attempted_ts", lateness).dropDuplicatesWithinWatermark(["id", "attempt_no"])
    return (
        unique.writeStream.foreachBatch(_append_batch(ledger, lambda batch: batch))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def latest_attempts(ledger: DataFrame) -> DataFrame:
    """Last attempt of each id."""
    rows = ledger.groupBy("id").agg(
        F.max_by(F.struct(*ledger.columns), F.struct("attempted_ts", "attempt_no")).alias("_a")
    )
    return rows.select("_a.*")


def live_shares(events: DataFrame, now, ttl: timedelta = SHARE_TTL, cap: int = SHARE_CAP) -> DataFrame:
    """Shares (share_id, created_at, payload) alive at ``now`` (a value or column), newest first, at most ``cap``."""
    moment = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    age = moment - F.col("created_at")
    return (
        events.filter((F.col("created_at") <= moment) & (age <= F.lit(ttl)))
        .orderBy(F.desc("created_at"), "share_id").limit(cap)
    )


def stream_shares(events: DataFrame, lateness: str = "1 hour", ttl: timedelta = SHARE_TTL, cap: int = SHARE_CAP) -> DataFrame:
    """Streaming twin of :func:`live_shares`: emits the surviving shares of a shard whenever it changes.

    Ids and payloads are text; of shares with one id the newest stands. State is split by a hash of the id into shards. Each keeps its newest ``cap`` shares, so together they always
    hold the newest ``cap`` overall; :func:`merge_shards` picks those. Rows of a shard share its version number.

    A share expires when the watermark, or a newer share of its shard, is ``ttl`` past it: every shard sets an event-time
    timer for its oldest share, so a shard without new events loses its shares too. A shard left empty emits one row of nulls.
    """
    texts = events.withColumn("share_id", F.col("share_id").cast("string")).withColumn("payload", F.col("payload").cast("string"))
    keyed = texts.withWatermark("created_at", lateness).withColumn(
        "shard", F.pmod(F.xxhash64("share_id"), F.lit(_SHARDS)).cast("int")
    )
    ttl_ms = int(ttl.total_seconds() * 1e3)

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, ids, stamps, payloads = state.get if state.exists else (0, [], [], [])
        held = {i: (s, p) for i, s, p in zip(ids, stamps, payloads)}
        watermark_ns = state.getCurrentWatermarkMs() * 1_000_000
        if not state.hasTimedOut:
            for pdf in batches:
                nanos = pdf["created_at"].astype("datetime64[ns]").astype("int64")
                for share_id, stamp, payload in zip(pdf["share_id"], nanos, pdf["payload"]):
                    if share_id not in held or held[share_id][0] <= stamp:
                        held[share_id] = (int(stamp), payload)
                held = _alive(held, watermark_ns, ttl_ms, cap)
        held = _alive(held, watermark_ns, ttl_ms, cap)
        version += 1
        state.update((version, list(held), [s for s, _ in held.values()], [p for _, p in held.values()]))
        if held:
            # Timers count whole milliseconds: the first one past the oldest share's life.
            state.setTimeoutTimestamp(min(s for s, _ in held.values()) // 1_000_000 + ttl_ms + 2)
        shown = held or {None: (pd.NaT, None)}
        yield pd.DataFrame({
            "shard": key[0], "version": version, "share_id": pd.Series(list(shown), dtype=object),
            "created_at": pd.to_datetime([s for s, _ in shown.values()]), "payload": pd.Series([p for _, p in shown.values()], dtype=object),
        })

    return keyed.select("shard", "share_id", "created_at", "payload").groupBy("shard").applyInPandasWithState(
        keep, "shard int, version long, share_id string, created_at timestamp, payload string",
        "version long, ids array<string>, stamps array<long>, payloads array<string>", "update", GroupStateTimeout.EventTimeTimeout,
    )


def _alive(held: dict, watermark_ns: int, ttl_ms: int, cap: int) -> dict:
    """The newest ``cap`` of the shares that neither the watermark nor the newest of them has outlived."""
    newest = max([watermark_ns, *(stamp for stamp, _ in held.values())])
    ids = sorted((i for i, (stamp, _) in held.items() if newest - stamp <= ttl_ms * 1_000_000), key=lambda i: (-held[i][0], i))
    return {i: held[i] for i in ids[:cap]}


def merge_shards(emitted: DataFrame, now, ttl: timedelta = SHARE_TTL, cap: int = SHARE_CAP) -> DataFrame:
    """Live shares from the latest version of every shard."""
    latest = emitted.groupBy("shard").agg(F.max("version").alias("version"))
    return live_shares(emitted.join(latest, ["shard", "version"]).select("share_id", "created_at", "payload"), now, ttl, cap)


def find_shares(emitted: DataFrame, asked: DataFrame, now, ttl: timedelta = SHARE_TTL, cap: int = SHARE_CAP) -> DataFrame:
    """Live shares with the ids in ``asked`` (share_id)."""
    return merge_shards(emitted, now, ttl, cap).join(asked.select(F.col("share_id").cast("string")), "share_id", "left_semi")
