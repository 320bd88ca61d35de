"""Session helpers: where loops cut lineage and where jobs stage files."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only on a local master, where driver and executors are one process, a fresh local folder stands in for a missing
    setting; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
        sc.setCheckpointDir(current)
    return current


def staging_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other job uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_LOOPS = threading.local()


@contextmanager
def staged_rounds(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`cut_lineage` writes inside are deleted at the end, but for the newest one.

    For loops whose every round replaces the table of the round before it.
    """
    loops = _LOOPS.__dict__.setdefault("open", [])
    loops.append([])
    try:
        yield
    finally:
        for path in loops.pop()[:-1]:
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from the written table.

    Later steps survive executor loss without recomputing, loop plans stay short, and each reader fetches only the
    columns it needs. Files are packed far smaller than their rows, so joins are planned by :func:`as_large`.
    """
    path = staging_path(df.sparkSession, "stage")
    for loop in _LOOPS.__dict__.get("open", [])[-1:]:
        loop.append(path)
    df.write.parquet(path)
    return as_large(df.sparkSession.read.schema(df.schema).parquet(path))


def as_large(df: DataFrame) -> DataFrame:
    """Rows that grow with the input: joins of them, also after steps of one input, merge and never pass through the driver.

    Spark plans by the size of the files, of which a few packed MB can be some hundred MB of rows, more after an explode.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` to as many tasks as a shuffle has, also where they are few bytes.

    Spark plans the number of tasks by the bytes that go in. Rows that become many more, or that cost much each, would
    otherwise all be worked on by the few tasks that their packed bytes are worth.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
