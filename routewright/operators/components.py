"""Connected components of keyed graphs by alternating star contraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewright.session import as_large, cut_lineage, staged_rounds


def connected_components(
    nodes: DataFrame, links: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """(keys..., node, component): component = smallest node id of the connected part within the key.

    Each round points all neighbours of a node at the smallest one, first the larger neighbours and then the smaller,
    until every node hangs on its component's smallest node. Minima are taken by aggregation, so a node with very many
    neighbours is combined map-side. Rounds grow with the logarithm of the graph's length.
    """
    keys = list(keys)
    edges = links.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    checksum = None
    with staged_rounds(nodes.sparkSession):
        edges = cut_lineage(edges)
        while True:
            now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first())
            if now == checksum or not now[0]:
                break
            checksum = now
            both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
            # Larger neighbours of u move to u's smallest neighbour.
            wide = as_large(
                edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("x")).join(low, [*keys, "u"])
                .select(*keys, F.col("x").alias("u"), F.col("low").alias("v")).distinct()
            )
            # Smaller neighbours of u, and u itself, move to the smallest of them.
            least = wide.groupBy(*keys, "u").agg(F.min("v").alias("low"))
            edges = cut_lineage(
                wide.join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("low").alias("v"))
                .unionByName(least.select(*keys, "u", F.col("low").alias("v")))
                .filter("u > v").distinct()
            )
    roots = edges.select(*keys, F.col("u").alias("node"), F.col("v").alias("_root"))
    return nodes.join(roots, [*keys, "node"], "left").select(
        *keys, "node", F.coalesce("_root", "node").alias("component")
    )
