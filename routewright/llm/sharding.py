"""Shards of bounded size by extendible hashing.

A row's place in the directory is the beginning of its key's hash, bit by bit. The whole table is one bucket at depth 0;
only a bucket over the byte limit splits on its next bit, so neighbours in the directory may differ in depth. A shard is a
bucket that fits.

The splits follow from byte sums of hash prefixes. Prefixes of a first width are summed in one pass, all depths up to it
come from those sums, and only rows of prefixes that are still too large are read again with more bits.

A row's key is its doc_id; rows without one use their text. Rows of one key cannot be split: a shard of the greatest depth
may be over the limit, and its ``shard_bytes`` says so. Null texts have no bytes. Rows that repeat come out repeated. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routewright.session import cut_lineage

#: Bits of a hash: fifteen hexadecimal digits of an MD5 sum.
HASH_BITS = 60
#: Bits that the first pass looks beyond an even split, and that each further pass adds.
SPARE_BITS, MORE_BITS = 4, 8


def _prefix(bits: int):
    return F.expr(f"shiftright(hash, {HASH_BITS - bits})")


def _hash() -> Column:
    """The hash of a row's key."""
    text = F.col("text").cast("string")
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text "), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def assign(docs: DataFrame, max_bytes: int) -> DataFrame:
    """``doc_id, shard, depth, n_bytes, shard_bytes`` of every row; ``shard`` is the hash prefix as bits."""
    return _assign(docs, max_bytes).drop("hash")


def _assign(docs: DataFrame, max_bytes: int) -> DataFrame:
    """The assignment with the ``hash`` of each row."""
    text = F.col("text").cast("string")
    rows = cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        _hash().alias("hash")))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    low, high = 0, min(HASH_BITS, max(1, (total // max_bytes).bit_length() + SPARE_BITS))
    placed = None
    while True:
        cells = rows.groupBy(_prefix(high).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        depths = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        depths = depths.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        sums = depths.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"))
        fit = depths.join(sums, ["depth", "prefix"]).where((F.col("shard_bytes") <= max_bytes) | (F.col("depth") == HASH_BITS))
        directory = cut_lineage(fit.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf")))
        here = rows.withColumn("cell", _prefix(high))
        found = here.join(directory, "cell").select(
            "doc_id", F.lpad(F.conv(F.col("leaf.prefix").cast("string"), 10, 2), F.col("leaf.depth"), F.lit("0")).alias("shard"),
            F.col("leaf.depth").alias("depth"), "n_bytes", F.col("leaf.shard_bytes").alias("shard_bytes"), "hash")
        placed = found if placed is None else placed.unionByName(found)
        if high == HASH_BITS:
            break
        rest = here.join(directory, "cell", "left_anti").drop("cell")
        if rest.isEmpty():
            break
        rows, low, high = cut_lineage(rest), high + 1, min(HASH_BITS, high + MORE_BITS)
    return placed


def write_shards(docs: DataFrame, max_bytes: int, path: str) -> DataFrame:
    """Write all columns of the rows, one folder for each shard, and give the assignment."""
    placed = cut_lineage(_assign(docs, max_bytes))
    names = placed.select(F.col("hash").alias("shard_hash"), F.col("shard").alias("shard_bits")).distinct()
    joined = docs.join(names, _hash() == F.col("shard_hash")).drop("shard_hash")
    folder = F.concat(F.lit("b"), "shard_bits")
    joined.withColumn("shard_bits", folder).repartition("shard_bits").write.partitionBy("shard_bits").parquet(path)
    return placed.drop("hash")
