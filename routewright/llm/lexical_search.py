"""Ranked lexical search by Block-Max MaxScore over an inverted index in segments.

Documents are cut, as they stand in the input, into segments of bounded text. One pass over the texts writes the index: for
every segment and term one row with its postings, a block for each stretch of ``BLOCK`` documents (place in the stretch and
frequency, a byte each), and the block's maximal pairs of frequency and document length, from which the best score of the
block follows exactly once the statistics of all documents are known. Nothing but the postings of query terms is shuffled.

A query is answered segment by segment. Its lists are ordered by their global bounds; as long as the bounds of the first
ones together stay under the heap's worst score, these lists are non-essential. Stretches of documents whose block maxima
cannot reach that score are passed over. In the others the essential lists are read and their documents become candidates;
block maxima of the non-essential lists, from the strongest on, reject candidates before a block of those lists is decoded.
The heaps of all segments are merged at the end, by score and then doc_id.

Terms are maximal runs of letters and digits of ASCII and of all characters beyond it, with A-Z in lower case. A document
without terms, or with a null text, counts nowhere. Rows that repeat a doc_id are documents of their own; rows without one
are too, and come last among equal scores. Rows that repeat an item_id are one item with the smallest text; a null item_id is
an item of its own. Very long texts make a segment of their own. Other columns are not read, whatever their names. An empty
table on either side gives an empty result. Terms are told apart by a 64-bit hash inside a segment and by themselves beyond.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routewright.llm.wordhash import blocks
from routewright.session import cut_lineage

#: Bytes between terms: ASCII but letters and digits.
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Documents of a block; a place in it takes one byte.
BLOCK = 256
#: Bytes of text in a segment.
SEGMENT_BYTES = 16 << 20
#: Items that are searched together.
ITEMS_TOGETHER = 1000
#: Up to so many terms of all items are sent to the index where it lies; more of them are joined by shuffling both.
SENT_TERMS = 200_000
_LARGE = 255

_INDEX = ("segment long, term string, df long, block array<int>, n_postings array<int>, n_pairs array<int>, pair_tf array<int>, "
          "pair_n array<int>, places binary, tfs binary, large array<int>, doc_ids array<long>, lengths array<int>")


# --- index ------------------------------------------------------------------------------------------------------

class _Segment:
    """Terms of consecutive documents, gathered block of texts by block."""

    def __init__(self):
        self.doc_ids: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.spelling: dict[int, bytes] = {}
        self.size = 0

    def add(self, block, ids: list[int | None]) -> None:
        counts = np.diff(block.first)
        full = np.flatnonzero(counts)
        number = np.full(len(counts), -1, np.int64)
        number[full] = len(self.doc_ids) + np.arange(len(full))
        self.doc_ids += [ids[n] for n in full.tolist()]
        self.lengths.append(counts[full])
        self.size += len(block.data)
        if not len(full):
            return
        doc = np.repeat(number, counts)
        order = np.lexsort((doc, block.hashes))
        hashes, doc = block.hashes[order], doc[order]
        starts = np.ones(len(order), bool)
        starts[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(starts)
        self.tfs.append(np.diff(np.append(at, len(order))))
        self.hashes.append(hashes[at])
        self.docs.append(doc[at])
        terms = at[np.append(True, hashes[at][1:] != hashes[at][:-1])]
        spelling, data = self.spelling, block.data
        for value, word in zip(hashes[terms].tolist(), order[terms].tolist()):
            if value not in spelling:
                spelling[value] = data[block.starts[word]:block.ends[word]].tobytes()

    def rows(self, segment: int) -> pa.RecordBatch:
        """A row for each term, and one without a term for the documents."""
        lengths = np.concatenate(self.lengths)
        hashes, docs, tfs = (np.concatenate(x) for x in (self.hashes, self.docs, self.tfs))
        order = np.argsort(hashes, kind="stable")  # documents stay in order within a term
        hashes, docs, tfs = hashes[order], docs[order], tfs[order]
        new_term = np.append(True, hashes[1:] != hashes[:-1])
        new_block = new_term | np.append(True, docs[1:] // BLOCK != docs[:-1] // BLOCK)
        term_at, block_at = np.flatnonzero(new_term), np.flatnonzero(new_block)
        n_postings = np.diff(np.append(block_at, len(docs)))
        keep, owner = _maximal_pairs(np.cumsum(new_block) - 1, tfs, lengths[docs])
        n_pairs = np.bincount(owner, minlength=len(block_at))
        block_bounds = np.append(np.searchsorted(block_at, term_at), len(block_at))
        pair_bounds = np.concatenate(([0], np.cumsum(n_pairs)))[block_bounds]
        posting_bounds = np.append(term_at, len(docs))
        large_at = np.flatnonzero(tfs >= _LARGE)
        large_bounds = np.searchsorted(large_at, posting_bounds)

        def lists(values: np.ndarray, bounds: np.ndarray, kind=None) -> pa.Array:
            kind = kind or pa.int32()
            own = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
            return pa.concat_arrays([own, pa.nulls(1, own.type)])

        def binaries(values: np.ndarray) -> pa.Array:
            data = values.astype(np.uint8).tobytes()
            own = pa.Array.from_buffers(pa.binary(), len(term_at), [None, pa.py_buffer(posting_bounds.astype(np.int32).tobytes()), pa.py_buffer(data)])
            return pa.concat_arrays([own, pa.nulls(1, pa.binary())])

        terms = [self.spelling[h].decode("utf-8", "replace") for h in hashes[term_at].tolist()]
        count = len(terms)
        empty = np.zeros(count + 1, np.int32)
        last = np.append(empty, len(lengths))
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(count + 1, segment)), pa.array([*terms, None], pa.string()),
            pa.array(np.append(np.diff(posting_bounds), len(lengths)), pa.int64()),
            lists(docs[block_at] // BLOCK, block_bounds), lists(n_postings, block_bounds), lists(n_pairs, block_bounds),
            lists(tfs[keep], pair_bounds), lists(lengths[docs[keep]], pair_bounds), binaries(docs % BLOCK),
            binaries(np.minimum(tfs, _LARGE)), lists(tfs[large_at], large_bounds),
            pa.ListArray.from_arrays(pa.array(last, pa.int32()), pa.array(self.doc_ids, pa.int64())),
            pa.ListArray.from_arrays(pa.array(last, pa.int32()), pa.array(lengths, pa.int32())),
        ], [c.split()[0] for c in _INDEX.split(", ")])


def _maximal_pairs(block: np.ndarray, tfs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(postings whose frequency beats every shorter document of their block, block of each): one of them has its best score."""
    order = np.lexsort((-tfs, lengths, block))
    owner, tf = block[order].astype(np.int64), tfs[order].astype(np.int64)
    highest = np.maximum.accumulate(owner << 40 | tf)
    beats = np.ones(len(order), bool)
    beats[1:] = (owner[1:] << 40 | tf[1:]) > highest[:-1]
    return order[beats], owner[beats]


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all documents, written to the shared folder: for each segment a row a term and one row of documents."""
    def run(batches):
        from pyspark import TaskContext

        segment, number = _Segment(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in blocks(batch.column(1), _BETWEEN):
                if segment.size and segment.size + len(block.data) > SEGMENT_BYTES:
                    if segment.hashes:
                        yield segment.rows(number)
                        number += 1
                    segment = _Segment()
                segment.add(block, batch.column(0).slice(block.rows.start, len(block.rows)).to_pylist())
        if segment.hashes:
            yield segment.rows(number)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return cut_lineage(rows.mapInArrow(run, _INDEX))


# --- scores -----------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Statistics:
    """Documents with terms, and all their terms with repeats."""

    documents: int
    terms: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def length_part(self, n: np.ndarray) -> np.ndarray:
        return 100 - 75 + (75 * n.astype(np.int64) * self.documents) // max(self.terms, 1)


def _gain(tf: np.ndarray, part: np.ndarray) -> np.ndarray:
    """What one unit of weight gives; it grows with the frequency and falls with the length."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * part)


def index_statistics(index: DataFrame) -> Statistics:
    row = index.where("term is null").select(
        F.col("df"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).agg(F.sum("df"), F.sum("n")).first()
    return Statistics(row[0] or 0, row[1] or 0)


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, times`` of every item."""
    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1), _BETWEEN):
                row = block.row_of_word() + block.rows.start
                words = [block.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(block.starts.tolist(), block.ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(words, pa.string())], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    each = rows.groupBy("item_id").agg(F.min("text").alias("text"))
    return each.mapInArrow(run, "item_id long, term string").groupBy("item_id", "term").agg(F.count("*").alias("times"))


# --- search -----------------------------------------------------------------------------------------------------

class _List:
    """One term's postings in a segment, decoded block by block when they are needed."""

    def __init__(self, row: dict, weight: int, parts: np.ndarray, stats: Statistics):
        self.weight, self.parts = weight, parts
        self.blocks, self.sizes = np.array(row["block"], np.int64), np.array(row["n_postings"], np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))
        gains = _gain(np.array(row["pair_tf"], np.int64), stats.length_part(np.array(row["pair_n"], np.int64)))
        first = np.concatenate(([0], np.cumsum(row["n_pairs"])[:-1])).astype(np.int64)
        self.best = weight * np.maximum.reduceat(gains, first)
        self.row = row
        self.decoded = np.zeros(len(self.blocks), bool)
        self.docs = self.gains = None

    def postings(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores of one occurrence in the item) in the blocks that are marked."""
        if self.docs is None:
            self.docs = np.zeros(self.bounds[-1], np.int64)
            self.gains = np.zeros(self.bounds[-1], np.int64)
        if (missing := wanted & ~self.decoded).any():
            which = np.flatnonzero(np.repeat(missing, self.sizes))
            places, tfs = (np.frombuffer(self.row[c], np.uint8) for c in ("places", "tfs"))
            tf = tfs[which].astype(np.int64)
            if self.row["large"]:
                at = np.cumsum(tfs == _LARGE) - 1
                tf = np.where(tf == _LARGE, np.array(self.row["large"], np.int64)[np.maximum(at[which], 0)], tf)
            docs = np.repeat(self.blocks, self.sizes)[which] * BLOCK + places[which]
            self.docs[which], self.gains[which] = docs, self.weight * _gain(tf, self.parts[docs])
            self.decoded |= missing
        if wanted.all():
            return self.docs, self.gains
        which = np.repeat(wanted, self.sizes)
        return self.docs[which], self.gains[which]


def search_segment(lists: list[_List], times: np.ndarray, n_docs: int, order: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``top`` best of a segment for one item, equal scores by ``order``.

    Stretches of documents are visited from the most promising on, a few more at a time as the heap fills.
    """
    stretches = -(-n_docs // BLOCK)
    best = np.zeros((len(lists), stretches), np.int64)
    for n, postings in enumerate(lists):
        best[n, postings.blocks] = postings.best * times[n]
    by_bound = np.argsort(best.max(1), kind="stable")  # weakest list first
    bounds = np.cumsum(best.max(1)[by_bound])
    held_docs, held_scores, worst = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    promise = best.sum(0)
    queue = np.argsort(-promise, kind="stable")
    done, step = 0, 1
    while done < stretches:
        visit = queue[done:done + step]
        done, step = done + step, step * 2
        visit = visit[promise[visit] >= worst]
        if not len(visit):
            break
        inside = np.zeros(stretches, bool)
        inside[visit] = True
        scores = np.zeros(stretches * BLOCK, np.int64)
        essential = int(np.searchsorted(bounds, worst, side="left"))  # lists before it cannot reach the worst score together
        for n in by_bound[essential:].tolist():
            docs, gains = lists[n].postings(inside[lists[n].blocks])
            scores[docs] += gains * times[n]
        candidates = np.flatnonzero(scores)
        rest = np.cumsum(best[by_bound[:essential]], 0)
        for at in range(essential - 1, -1, -1):
            candidates = candidates[scores[candidates] + rest[at, candidates // BLOCK] >= worst]
            if not len(candidates):
                break
            n = int(by_bound[at])
            needed = np.zeros(stretches, bool)
            needed[candidates // BLOCK] = True
            wanted = needed[lists[n].blocks]
            if wanted.any():
                docs, gains = lists[n].postings(wanted)
                scores[docs] += gains * times[n]
        candidates = candidates[scores[candidates] >= worst]
        docs = np.concatenate((held_docs, candidates))
        found = np.concatenate((held_scores, scores[candidates]))
        chosen = np.lexsort((order[docs], -found))[:top]
        held_docs, held_scores = docs[chosen], found[chosen]
        if len(chosen) == top:
            worst = max(worst, int(held_scores[-1]))
    return held_docs, held_scores


def search(index: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``top`` best documents of each item."""
    spark = index.sparkSession
    stats = index_statistics(index)
    asked = cut_lineage(item_terms(items))
    groups = max(1, -(-asked.select("item_id").distinct().count() // ITEMS_TOGETHER))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int"))
    # items of a part by term, and the documents that hold the term
    sent = F.broadcast if asked.count() <= SENT_TERMS else lambda df: df
    by_term = asked.groupBy("part", "term").agg(F.collect_list(F.struct("item_id", "times")).alias("uses"))
    frequency = index.select("term", "df").join(sent(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(
        F.sum("df").alias("all_df"))
    by_term = sent(cut_lineage(by_term.join(frequency, "term")))
    columns = [c.split()[0] for c in _INDEX.split(", ")]
    matched = index.where("term is not null").join(by_term, "term").select(*columns, "part", "uses", "all_df")
    parts = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    documents = index.where("term is null").select(*columns, parts.alias("part")).select(
        "*", F.lit(None).cast("array<struct<item_id:bigint,times:bigint>>").alias("uses"), F.lit(None).cast("long").alias("all_df"))

    def run(key, group):
        rows = group.to_pylist()
        docs = next(r for r in rows if r["term"] is None)
        lengths = np.array(docs["lengths"], np.int64)
        parts, ids = stats.length_part(lengths), docs["doc_ids"]
        # equal scores go by doc_id, rows without one last
        order = np.empty(len(ids), np.int64)
        order[sorted(range(len(ids)), key=lambda n: (ids[n] is None, ids[n] or 0))] = np.arange(len(ids))
        lists, uses = [], {}
        for row in sorted((r for r in rows if r["term"] is not None), key=lambda r: r["term"]):
            weight = stats.weight(row["all_df"])
            if weight > 0:
                for use in row["uses"]:
                    uses.setdefault(use["item_id"], []).append((len(lists), use["times"]))
                lists.append(_List(row, weight, parts, stats))
        out = []
        for item, terms in uses.items():
            found, scores = search_segment([lists[n] for n, _ in terms], np.array([t for _, t in terms], np.int64), len(ids), order, top)
            out += [(item, ids[d], s) for d, s in zip(found.tolist(), scores.tolist())]
        return pa.table({name: pa.array([r[n] for r in out], pa.int64()) for n, name in enumerate(("item_id", "doc_id", "score"))})

    heaps = matched.unionByName(documents).groupBy("segment", "part").applyInArrow(run, "item_id long, doc_id long, score long")
    ranked = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
