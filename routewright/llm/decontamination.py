"""Benchmark items in documents, exact or with some words changed.

Texts become lower-case words. An item that may have e edits is cut into windows side by side, about one for each two edits
(and of 16 words at most), so one of them has a single edit at most. Windows of the same size start at every word of a
passage. Both are walked at random: at each step the word under the pointer is written down, and a hash of step and word
tells whether the pointer moves on, so that after an edit the two walks meet again soon and edit distance becomes Hamming
distance. A key is a few sampled places of one walk. Walks are repeated until a window with one edit, of the kind and at the
place that is hardest to find, shares a key with its item's with probability ``target_recall``; how many that takes for a
window size is measured once on random words by fixed seeds. Passages and items that share a key are candidates, and an exact
edit distance over words decides.

By the q-gram lemma a window that begins with its item keeps all but two of the item's word bigrams for each edit (an
inserted word breaks one and pushes one out, any other edit breaks two), so windows with too few benchmark bigrams are
passed over before keys are looked for. That never loses a match. The filters of bigrams and of keys are Bloom bitmaps of
fixed size, whatever the number of items. Equal passages of many documents are verified once.

Items with fewer than ``least_words`` words are too short to tell a leak and are not searched; null texts have no words.
Rows that repeat a doc_id or an item_id count as one. Rows without an id are not reported. Other columns are not read. An
empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewright.llm.wordhash import blocks, mix
from routewright.session import cut_lineage

#: Bytes between words: ASCII but letters and digits.
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_WORDS = regex.compile(r"[0-9a-z\x80-\U0010FFFF]+").findall


@dataclass(frozen=True)
class LeakSearch:
    #: Edited words by words of the item.
    edit_rate: float = 0.2
    least_words: int = 8
    #: Ratio of one window size to the next; an item is searched by the largest size that it fills.
    size_step: float = 1.2
    bitmap_bits: int = 1 << 24
    #: Least probability that a window of an item with one edit shares a key with the item's.
    target_recall: float = 0.999
    #: Places of a walk that make a key, among its first steps: so many for each word of the window.
    samples: int = 3
    steps_a_word: float = 1.5
    longest_piece: int = 16

    def window(self, words: int) -> int:
        """The window size of an item."""
        size = self.least_words
        while (following := max(size + 1, int(size * self.size_step))) <= words:
            size = following
        return size

    def edits(self, words: int) -> int:
        return int(self.edit_rate * words + 1e-9)

    def window_edits(self, window: int) -> int:
        """Most edits of any item that is searched by this window size."""
        return self.edits(max(window, math.ceil(window * self.size_step) - 1))

    def pieces(self, words: int) -> int:
        """Windows of an item, so many that one has no more than one of its edits."""
        return max(-(-(self.edits(words) + 1) // 2), -(-words // self.longest_piece))

    def piece(self, words: int) -> int:
        """Words of each of the windows of an item."""
        return words // self.pieces(words)


def _plain(data: np.ndarray) -> np.ndarray:
    """General punctuation (three-byte dashes, quotes, dots) becomes blanks."""
    lead = np.flatnonzero(data[:-2] == 0xE2) if len(data) > 2 else np.zeros(0, np.int64)
    lead = lead[(data[lead + 1] == 0x80) | (data[lead + 1] == 0x81)]
    for n in range(3):
        data[lead + n] = 0x20
    return data


def _blocks(column: pa.Array):
    return blocks(column, _BETWEEN, _plain)


def _bigram_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes[:-1] * np.uint64(3) + hashes[1:]) & np.uint64(bits - 1)).astype(np.int64)


def _key_places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys & np.uint64(bits - 1)).astype(np.int64)


@dataclass(frozen=True)
class Walks:
    """Random walks over windows of one size: for each a salt for every step, and the steps that its key samples."""

    size: int
    salts: np.ndarray
    picks: np.ndarray

    @staticmethod
    def drawn(size: int, count: int, params: LeakSearch) -> Walks:
        random = np.random.default_rng([size, 11])
        steps = max(params.samples, int(params.steps_a_word * size))
        picks = np.stack([np.sort(random.choice(steps, params.samples, replace=False)) for _ in range(count)])
        return Walks(size, random.integers(0, 1 << 63, (count, steps), dtype=np.uint64), picks)

    def first(self, count: int) -> Walks:
        return Walks(self.size, self.salts[:count], self.picks[:count])

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """Keys (windows x walks) of rows of word hashes; 0 stands for no word."""
        rows, size = np.arange(len(windows)), windows.shape[1]
        padded = np.concatenate((windows, np.zeros((len(windows), 1), np.uint64)), 1)
        out = np.empty((len(windows), len(self.picks)), np.uint64)
        for walk, (salts, picks) in enumerate(zip(self.salts, self.picks.tolist())):
            place = np.zeros(len(windows), np.int64)
            key = np.full(len(windows), self.size << 32 | walk, np.uint64)
            for step in range(picks[-1] + 1):
                word = padded[rows, np.minimum(place, size)]
                if step in picks:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + word)
                place += (mix(word ^ salts[step]) >> np.uint64(63)).astype(np.int64)
            out[:, walk] = key
        return out


def edited_windows(size: int, trials: int, random: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """(windows, texts around them with one edit) of random words, for every kind and place of the edit."""
    words = lambda *shape: random.integers(1, 1 << 63, shape, dtype=np.uint64)
    out = []
    for place in range(size):
        for kind in range(3):
            window = words(trials, size)
            if kind == 0:
                held = window.copy()
                held[:, place] = words(trials)
            else:
                held = np.delete(window, place, 1) if kind == 1 else np.insert(window, place, words(trials), axis=1)
            out.append((window, np.concatenate((words(trials, 2), held, words(trials, size)), 1)))
    return out


@lru_cache(maxsize=64)
def walks_for(size: int, params: LeakSearch) -> Walks:
    """As many walks as the target recall takes for the kind and place of an edit that they find least often."""
    if size < 2:
        return Walks.drawn(size, 1, params)
    trial = Walks.drawn(size, 32, params)
    shares = []
    for window, text in edited_windows(size, 60, np.random.default_rng(size)):
        keys = trial.keys(window)
        shares.append(np.any([trial.keys(text[:, n:n + size]) == keys for n in range(5)], 0).mean())
    found = min(max(min(shares), 0.01), 0.99)
    return Walks.drawn(size, math.ceil(math.log(1 - params.target_recall) / math.log(1 - found)), params)


def words_of(text: str) -> list[str]:
    """Words of a normalised passage."""
    return _WORDS(text)


def edit_distance_within(item: list[str], passage: list[str]) -> tuple[int, int]:
    """(fewest word edits between the item and any part of the passage, where that part ends), by bit vectors."""
    m = len(item)
    where: dict[str, int] = {}
    for n, word in enumerate(item):
        where[word] = where.get(word, 0) | 1 << n
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for n, word in enumerate(passage, 1):
        equal = where.get(word, 0)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        if score < best:
            best, end = score, n
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
    return best, end


def items_table(benchmark: DataFrame, params: LeakSearch) -> DataFrame:
    """``item_id, item, n_words, window, piece, keys, places``: the normalised item, its windows' keys and its bigrams' places in the bitmap."""
    def run(batches):
        for batch in batches:
            for block in _blocks(batch.column(1)):
                ids = batch.column(0).slice(block.rows.start, len(block.rows)).to_pylist()
                out = []
                for row, item in enumerate(ids):
                    a, b = int(block.first[row]), int(block.first[row + 1])
                    if b - a >= params.least_words:
                        window, hashes = params.window(b - a), block.hashes[a:b]
                        piece = params.piece(b - a)
                        count = params.pieces(b - a)
                        keys = np.unique(walks_for(piece, params).keys(hashes[:count * piece].reshape(count, piece)))
                        text = bytes(block.data[block.starts[a]:block.ends[b - 1]]).decode("utf-8", "replace")
                        out.append((item, text, b - a, window, piece, keys.view(np.int64), np.unique(_bigram_places(hashes, params.bitmap_bits))))
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in enumerate(kinds)],
                                                 ["item_id", "item", "n_words", "window", "piece", "keys", "places"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    return rows.where("item_id is not null").mapInArrow(
        run, "item_id long, item string, n_words int, window int, piece int, keys array<long>, places array<long>")


def passages(docs: DataFrame, windows: list[int], pieces: list[int], bitmaps, params: LeakSearch) -> DataFrame:
    """``doc_id, passage, keys``: merged neighbourhoods of windows that hold enough benchmark bigrams, with their keys that items have."""
    walks = [walks_for(size, params) for size in pieces]

    def run(batches):
        flags, marked = (np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").view(bool) for bits in bitmaps.value)
        for batch in batches:
            for block in _blocks(batch.column(1)):
                ids, texts, keys = [], [], []
                n = len(block.hashes)
                if n >= 2:
                    row = block.row_of_word()
                    last = np.repeat(block.first[1:], np.diff(block.first))  # end of the word's row
                    flagged = flags[_bigram_places(block.hashes, params.bitmap_bits)] & (row[1:] == row[:-1])
                    sums = np.concatenate(([0], np.cumsum(flagged)))
                    starts, stops, marks = [], [], []
                    for window in windows:
                        edits = params.window_edits(window)
                        stop = np.minimum(np.arange(n) + window, last)
                        held = sums[np.maximum(stop - 1, np.arange(n))] - sums[:n]
                        good = np.flatnonzero((held >= max(1, window - 1 - 2 * edits)) & (stop - np.arange(n) >= window - edits))
                        if len(good):
                            starts.append(good - edits)
                            stops.append(stop[good] + 2 * edits + math.ceil(window * (params.size_step - 1)))
                            marks.append(good)
                    if starts:
                        at = np.concatenate(marks)
                        low = np.maximum(np.concatenate(starts), block.first[row[at]])
                        high = np.minimum(np.concatenate(stops), last[at])
                        order = np.argsort(low, kind="stable")
                        at, low, high = at[order], low[order], high[order]
                        reach = np.maximum.accumulate(high)
                        cuts = np.flatnonzero((low[1:] >= reach[:-1])) + 1
                        begins, ends = low[np.append(0, cuts)], reach[np.append(cuts - 1, len(at) - 1)]
                        steps = np.zeros(n + 1, np.int64)
                        np.add.at(steps, begins, 1)
                        np.add.at(steps, ends, -1)
                        inside = np.cumsum(steps[:-1]) > 0
                        runs = []  # (places of windows whose key an item may have, the keys)
                        for walk in walks:
                            size = walk.size
                            stop = np.minimum(np.arange(n) + size, last)
                            held = sums[np.maximum(stop - 1, np.arange(n))] - sums[:n]
                            place = np.flatnonzero(inside & (held >= max(1, size - 4)) & (stop - np.arange(n) >= size - 1))
                            words = place[:, None] + np.arange(size)
                            words = np.where(words < last[place][:, None], block.hashes[np.minimum(words, n - 1)], np.uint64(0))
                            found = walk.keys(words)
                            possible = marked[_key_places(found.ravel(), params.bitmap_bits)].reshape(found.shape)
                            runs.append((np.repeat(place, possible.sum(1)), found[possible]))
                        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                            begin, end = int(low[a]), int(reach[b - 1])
                            here = np.unique(np.concatenate([key[slice(*np.searchsorted(place, (begin, end)))] for place, key in runs]))
                            if not len(here):
                                continue
                            ids.append(block.rows.start + int(row[begin]))
                            texts.append(bytes(block.data[block.starts[begin]:block.ends[end - 1]]).decode("utf-8", "replace"))
                            keys.append(here.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(texts, pa.string()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "passage", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    return rows.where("doc_id is not null").mapInArrow(run, "doc_id long, passage string, keys array<long>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakSearch = LeakSearch()) -> DataFrame:
    """``doc_id, item_id, n_words, edits`` of every document and item that it holds within the edit limit."""
    def check(batches):
        for batch in batches:
            keep, edits = [], []
            for n, (item, passage) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                words = words_of(item)
                distance, _ = edit_distance_within(words, words_of(passage))
                if distance <= params.edits(len(words)):
                    keep.append(n)
                    edits.append(distance)
            kept = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(edits, pa.int32())],
                                             ["passage_id", "item_id", "edits"])

    spark = docs.sparkSession
    items = cut_lineage(items_table(benchmark, params))
    # a few sizes, whatever the item count
    sizes = items.select("window", "piece").distinct().collect()
    windows, pieces = sorted({r["window"] for r in sizes}), sorted({r["piece"] for r in sizes})
    bitmaps = []
    for place in (F.explode("places"), F.explode(F.transform("keys", lambda key: key.bitwiseAND(params.bitmap_bits - 1)))):
        bitmap = np.zeros(params.bitmap_bits, bool)
        places = items.select(place.alias("place")).distinct().toArrow()  # no more than the bits of the bitmap
        bitmap[places.column(0).to_numpy()] = True
        bitmaps.append(np.packbits(bitmap, bitorder="little").tobytes())
    shared = spark.sparkContext.broadcast(bitmaps)
    found = passages(docs, windows, pieces, shared, params).withColumn("passage_id", F.md5("passage"))
    found = cut_lineage(found)
    different = found.groupBy("passage_id").agg(F.first("passage").alias("passage"), F.first("keys").alias("keys"))
    different = cut_lineage(different)
    keyed = items.select("item_id", F.explode("keys").alias("key"))
    candidates = different.select("passage_id", F.explode("keys").alias("key")).join(keyed, "key").select("passage_id", "item_id").distinct()
    pairs = candidates.join(items.select("item_id", "item"), "item_id").join(different.select("passage_id", "passage"), "passage_id")
    held = pairs.select("passage_id", "item_id", "item", "passage").mapInArrow(check, "passage_id string, item_id long, edits int")
    named = found.select("doc_id", "passage_id").join(held, "passage_id").groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
    sizes = items.groupBy("item_id").agg(F.max("n_words").alias("n_words"))
    return named.join(sizes, "item_id").select("doc_id", "item_id", "n_words", "edits")
