"""Running values over long ordered groups.

A plain window sorts a whole group in one task. Here a group is cut into chunks of the order column: a window runs
inside each chunk, one total per chunk is carried over by a second, far smaller window, and the two are combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096

_RUN = {
    "sum": (F.sum, lambda inner, carried: F.coalesce(inner, F.lit(0)) + F.coalesce(carried, F.lit(0))),
    "max": (F.max, lambda inner, carried: F.greatest(inner, carried)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda inner, carried: F.coalesce(inner, carried)),
}


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, how: str, name: str,
    chunk_of: Column, inclusive: bool = True,
) -> DataFrame:
    """Add ``name`` = running sum, max or last non-null of ``value``; ``chunk_of`` must not decrease along the order."""
    over, combine = _RUN[how]
    staged = df.withColumn("_chunk", chunk_of).withColumn("_value", value)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    whole = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    scanned = staged.select("*", over("_value").over(upto).alias("_inner"))
    totals = (
        staged.select(*keys, "_chunk", over("_value").over(whole).alias("_total"),
                      F.row_number().over(inner).alias("_first"))
        .filter("_first = 1").drop("_first")
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_chunk", over("_total").over(before).alias("_carried"))
    return (
        scanned.join(carried, [*keys, "_chunk"])
        .withColumn(name, combine(F.col("_inner"), F.col("_carried")))
        .drop("_chunk", "_value", "_inner", "_carried")
    )


def number_rows(df: DataFrame, position: str, name: str, start: Column | int = 0, chunk: int = 65536) -> DataFrame:
    """Dense numbers ``start+1 ..`` in the order of an integer position column, without a single-task sort."""
    numbered = running(
        df, [], [position], F.lit(1), "sum", name, F.floor(F.col(position) / chunk)
    )
    return numbered.withColumn(name, (F.col(name) + start).cast("long"))


def segments(points: DataFrame, keys: Sequence[str], cols: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Each point with its successor in ``next`` (NULL at the end of the line).

    ``seq`` is dense from 0. The first point of a chunk is also sent to the chunk before it, so every consecutive pair
    meets in one bounded window group.
    """
    own = F.floor(F.col("seq") / chunk)
    chunks = F.when((F.col("seq") % chunk == 0) & (F.col("seq") > 0), F.array(own - 1, own)).otherwise(F.array(own))
    spread = points.select(*keys, "seq", *cols, F.explode(chunks).alias("_chunk"))
    following = F.lead(F.struct("seq", *cols)).over(Window.partitionBy(*keys, "_chunk").orderBy("seq"))
    is_copy = F.col("seq") == (F.col("_chunk") + 1) * chunk
    return spread.withColumn("next", following).filter(~is_copy).drop("_chunk")
