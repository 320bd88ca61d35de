"""Near duplicates by SetSketch registers: banded, estimated jointly by likelihood, then verified on full shingle sets.

Registers are exponentially spaced truncated minima: for the smallest of exponential draws x over a set, floor(1 - log_b x).
They merge by maximum, and two sets agree in a register with a probability near their Jaccard similarity. Bands of
registers give candidate pairs, the joint likelihood of the registers and the exact set sizes estimates similarity, and
what may reach the threshold is verified on the texts.

Hot buckets are never expanded into all their pairs. Exact copies fold into one representative first. Then every member
of a bucket meets the bucket's smallest one; what is verified there joins components. Buckets whose members are still in
several components are compared block by block in tasks: first by registers, which tells the members that agree with one
of another component often enough, then with the full sets of those. Every such pair is verified there, unless links found
before already join it, and only links leave the task.

A document's set is its distinct k-word shingles; with fewer words, the whole sequence; without words, or with a null
text, it is empty and linked with nothing. Rows that repeat a doc_id are one node with the links of all its texts. Rows
without a doc_id are copied through with no component and kept. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewright.llm import graph
from routewright.llm.wordhash import blocks, mix, sequence_hashes, shingle_sets
from routewright.session import cut_lineage


@dataclass(frozen=True)
class SetSketch:
    """Sketch and search parameters. With 24 bands of 6, a pair at 0.85 is missed once in about 80,000."""

    words: int = 5
    percent: int = 85
    bands: int = 24
    width: int = 6
    base: float = 1.1
    rate: float = 20.0
    #: Standard errors below the threshold down to which estimates are verified.
    slack: float = 4.0
    #: Members of a bucket, and shingles of their sets, that one task compares with as many others.
    block: int = 1024
    block_shingles: int = 1 << 20

    @property
    def registers(self) -> int:
        return self.bands * self.width

    @property
    def least_estimate(self) -> float:
        t = self.percent / 100
        return t - self.slack * math.sqrt(t * (1 - t) / self.registers)

    def sketch(self, sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Registers (rows x registers, one byte each) of consecutive non-empty sets of hashes."""
        out = np.empty((len(bounds) - 1, self.registers), np.uint64)
        draw, step = mix(sets ^ np.uint64(0xA0761D6478BD642F)), mix(sets + np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)
        for n in range(self.registers):
            draw += step
            out[:, n] = np.minimum.reduceat(draw, bounds[:-1])
        smallest = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**64) / self.rate
        return np.clip(np.floor(1 - np.log(smallest) / math.log(self.base)), 0, 255).astype(np.uint8)

    def keys(self, registers: np.ndarray) -> np.ndarray:
        """Bucket keys (rows x bands): the band above, its register values below, so equal keys mean equal registers."""
        rows = len(registers)
        wide = np.zeros((rows, self.bands, 8), np.uint8)
        wide[:, :, 0] = np.arange(self.bands) >> 8
        wide[:, :, 1] = np.arange(self.bands) & 255
        wide[:, :, 2:8] = registers.reshape(rows, self.bands, self.width)
        return wide.reshape(rows, -1).view(">i8").astype(np.int64)

    def registers_of(self, keys: np.ndarray) -> np.ndarray:
        return keys.reshape(len(keys), self.bands).astype(">i8").view(np.uint8).reshape(len(keys), self.bands, 8)[:, :, 2:8].reshape(
            len(keys), -1)

    def estimate(self, above: np.ndarray, below: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Most likely similarity of pairs of sets with ``n`` and ``m`` elements, from how many registers are larger or smaller."""
        share_n = (n / (n + m))[:, None]
        share_m = 1 - share_n
        most = np.minimum(share_n / share_m, share_m / share_n)
        grid = most * np.linspace(0, 1, 101)[None, :]
        scale, log_base = (self.base - 1) / self.base, math.log(self.base)
        up = np.maximum(-np.log1p(-np.maximum(share_n - share_m * grid, 0) * scale) / log_base, 1e-9)
        down = np.maximum(-np.log1p(-np.maximum(share_m - share_n * grid, 0) * scale) / log_base, 1e-9)
        same = np.maximum(1 - up - down, 1e-9)
        equal = self.registers - above - below
        score = above[:, None] * np.log(up) + below[:, None] * np.log(down) + equal[:, None] * np.log(same)
        return grid[np.arange(len(grid)), score.argmax(1)]

    def possible(self, one: np.ndarray, two: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Estimates of row pairs; -1 where the sizes alone rule the threshold out."""
        out = np.full(len(n), -1.0)
        fits = np.flatnonzero(100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))
        if len(fits):
            a, b = one[fits], two[fits]
            out[fits] = self.estimate((a > b).sum(1), (a < b).sum(1), n[fits].astype(float), m[fits].astype(float))
        return out


def sketch_documents(docs: DataFrame, params: SetSketch = SetSketch()) -> DataFrame:
    """``doc_id, n_shingles, copy_a, copy_b, keys``: the set size, two hashes of the word sequence and the bucket keys (null for empty sets)."""
    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets, bounds = shingle_sets(block, params.words)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                keys: list = [None] * len(sizes)
                if len(full):
                    found = params.keys(params.sketch(sets, np.append(bounds[:-1][full], bounds[-1])))
                    for n, row in zip(full.tolist(), found):
                        keys[n] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.rows.start, len(block.rows)), pa.array(sizes, pa.int64()),
                     pa.array(sequence_hashes(block, 1).view(np.int64)), pa.array(sequence_hashes(block, 2).view(np.int64)),
                     pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "copy_a", "copy_b", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, copy_a long, copy_b long, keys array<long>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _rows(columns: list[pa.Array], keep) -> pa.RecordBatch:
    kept = pa.array(np.flatnonzero(keep))
    return pa.RecordBatch.from_arrays([c.take(kept) for c in columns], ["a", "b"])


def _estimated(pairs: DataFrame, nodes: DataFrame, params: SetSketch) -> DataFrame:
    """Pairs (a, b) of nodes whose joint estimate may reach the threshold."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                one, two = (params.registers_of(_matrix(batch.column(n), params.bands)) for n in (2, 3))
                n, m = (batch.column(i).to_numpy() for i in (4, 5))
                yield _rows(batch.columns[:2], params.possible(one, two, n, m) >= params.least_estimate)

    for c in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("keys").alias(f"keys_{c}")), c)
    return pairs.select("a", "b", "keys_a", "keys_b", "n_a", "n_b").mapInArrow(run, "a long, b long").distinct()


def verify(pairs: DataFrame, docs: DataFrame, params: SetSketch = SetSketch()) -> DataFrame:
    """Pairs (a, b) of doc_ids for which the full shingle sets of their texts reach the threshold."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = pa.concat_arrays([part.column(2), part.column(3)]).dictionary_encode()
                sets = []
                for block in blocks(texts.dictionary):
                    hashes, bounds = shingle_sets(block, params.words)
                    sets += [hashes[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                which = texts.indices.to_pylist()
                keep = []
                for i, j in zip(which[: part.num_rows], which[part.num_rows:]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    keep.append(0 < params.percent * (len(sets[i]) + len(sets[j]) - both) <= 100 * both)
                yield _rows(part.columns[:2], keep)

    pairs = cut_lineage(pairs)
    wanted = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                        .where("text is not null").join(wanted, "doc_id", "left_semi"))
    for c in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")), c)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _first_candidates(members: DataFrame) -> DataFrame:
    """Every member of a bucket with the bucket's smallest node."""
    lowest = members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").drop("last")
    return members.join(lowest, "key").where("a < node").select("a", F.col("node").alias("b")).distinct()


def _split_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their component."""
    labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = labelled.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"),
        F.sum("n").alias("shingles")).where("low < high")
    return labelled.select("key", "node", "component").join(several.select("key", "size", "shingles"), "key")


def _sets(nodes: DataFrame, docs: DataFrame, params: SetSketch) -> DataFrame:
    """``node, shingles``: the full sets of some nodes, as bytes of sorted hashes."""
    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1)):
                hashes, bounds = shingle_sets(block, params.words)
                sets = [hashes[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.rows.start, len(block.rows)), pa.array(sets, pa.binary())], ["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.join(nodes, "node", "left_semi").mapInArrow(run, "node long, shingles binary")


def _grouped(batches, handle, names: list[str]):
    """``handle`` each run of rows with equal (key, i, j) in a sorted stream of batches; a run may go on over batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([*held, batch])
        key = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()]
        yield from _handled((whole.slice(x, y - x) for x, y in zip(cuts, cuts[1:])), handle, names)
        held = whole.slice(cuts[-1]).to_batches()
    if held:
        yield from _handled([pa.Table.from_batches(held)], handle, names)


def _handled(groups, handle, names: list[str]):
    out = [handle(g.combine_chunks()) for g in groups if g.num_rows > 1]
    if out:
        yield from pa.concat_tables(out).select(names).combine_chunks().to_batches()


class _Group:
    """Members of one bucket, or of two of its blocks, and which pairs of two components agree often enough."""

    def __init__(self, rows: pa.Table, params: SetSketch):
        self.params = params
        self.left, self.right = (np.flatnonzero(rows.column(c).to_numpy()) for c in ("left", "right"))
        self.node, self.component, self.n = (rows.column(c).to_numpy() for c in ("node", "component", "n"))
        self.band = int(rows.column("key")[0].as_py()) >> 48
        self.registers = params.registers_of(_matrix(rows.column("keys").combine_chunks(), params.bands))
        self.least = math.floor(params.least_estimate * params.registers)
        self.within = len(self.left) == rows.num_rows == len(self.right)

    def likely(self, one: int) -> np.ndarray:
        """Members after ``one`` that may be linked with it, most alike first; a pair counts in its first common bucket."""
        n, others = self.n, self.right[self.right > one] if self.within else self.right
        others = others[(self.component[others] != self.component[one])
                        & (100 * np.minimum(n[others], n[one]) >= self.params.percent * np.maximum(n[others], n[one]))]
        if not len(others):
            return others
        same = self.registers[others] == self.registers[one]
        agree = same.sum(1)
        first = same.reshape(len(others), self.params.bands, self.params.width).all(2).argmax(1)
        good = np.flatnonzero((agree >= self.least) & (first == self.band))
        return others[good[np.argsort(-agree[good], kind="stable")]]


_BLOCK_ROWS = "key long, i int, j int, left boolean, right boolean, node long, component long, n long, keys array<long>"


def _likely_rows(split: DataFrame, nodes: DataFrame, params: SetSketch) -> DataFrame:
    """Block rows of the members that may be linked with one of another component."""
    blocks_of = F.greatest(F.ceil(F.col("size") / params.block), F.ceil(F.col("shingles") / params.block_shingles)).cast("int")
    rows = split.withColumn("mine", F.pmod(F.xxhash64("node"), blocks_of).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks_of - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                       (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"), "node", "component")
    rows = rows.join(nodes.select("node", "n", "keys"), "node").select(*[c.split()[0] for c in _BLOCK_ROWS.split(", ")])
    names = rows.columns

    def handle(group: pa.Table) -> pa.Table:
        members, found = _Group(group, params), np.zeros(group.num_rows, bool)
        for one in members.left.tolist():
            others = members.likely(one)
            found[others] = True
            found[one] |= len(others) > 0
        return group.filter(pa.array(found))

    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return rows.mapInArrow(lambda batches: _grouped(batches, handle, names), _BLOCK_ROWS)


def _block_links(rows: DataFrame, sets: DataFrame, params: SetSketch) -> DataFrame:
    """Verified links (a, b) that join the components of each group of block rows."""
    def handle(group: pa.Table) -> pa.Table:
        members = _Group(group, params)
        node, component = members.node.tolist(), members.component.tolist()
        full = [np.frombuffer(s.as_py(), np.uint64) for s in group.column("shingles")]
        parent: dict[int, int] = {}
        found: list[tuple[int, int]] = []

        def root(c):
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        for one in members.left.tolist():
            for two in members.likely(one).tolist():
                x, y = root(component[one]), root(component[two])
                if x != y:
                    both = len(np.intersect1d(full[one], full[two], assume_unique=True))
                    if 100 * both >= params.percent * (len(full[one]) + len(full[two]) - both):
                        parent[x] = y
                        found.append((node[one], node[two]))
        return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})

    rows = rows.join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return rows.mapInArrow(lambda batches: _grouped(batches, handle, ["a", "b"]), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, params: SetSketch = SetSketch()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row: the smallest doc_id it is linked with, and if it is its own."""
    sketched = cut_lineage(sketch_documents(docs, params))
    full = sketched.where("doc_id is not null and n_shingles > 0")
    copies = full.groupBy("copy_a", "copy_b").agg(F.min("doc_id").alias("node"))
    copies = cut_lineage(copies)
    nodes = full.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "copy_a", "copy_b", "keys").join(
        copies, ["node", "copy_a", "copy_b"], "left_semi").dropDuplicates(["node", "copy_a", "copy_b"])
    nodes = cut_lineage(nodes.select("node", "n", "keys"))
    members = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").drop("size")
    members = cut_lineage(members.join(shared, "key", "left_semi"))

    likely = _estimated(_first_candidates(members), nodes, params)
    links = cut_lineage(verify(likely, docs, params))
    split = _split_buckets(members, graph.components(links))
    rows = cut_lineage(_likely_rows(split, nodes, params))
    sets = cut_lineage(_sets(cut_lineage(rows.select("node").distinct()), docs, params))
    links = links.union(cut_lineage(_block_links(rows, sets, params)))
    # rows that repeat a doc_id with other words are one node
    owners = full.select("doc_id", "copy_a", "copy_b").join(copies, ["copy_a", "copy_b"])
    same = owners.where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    repeated = full.groupBy("doc_id").agg(F.min("copy_a").alias("x"), F.max("copy_a").alias("y")).where("x < y").select("doc_id")
    links = links.union(same.join(repeated.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b"))
    labels = cut_lineage(graph.components(links))
    named = copies.join(labels, "node", "left").select("copy_a", "copy_b", F.coalesce("component", "node").alias("component_id"))
    found = sketched.drop("keys").join(named, ["copy_a", "copy_b"], "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(linked, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
