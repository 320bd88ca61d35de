"""Periodic runs of words by maximal pairs.

A run is a stretch of words that repeats with a smallest period q at least ``least_exponent`` times and that no word next
to it continues. It is exactly the maximal pair of its start s and s + q: from there the same words follow up to the end of
the run, the words before differ (or one is the text's first), and what they share is ``least_exponent`` - 1 periods or
more. So the search lists maximal pairs whose distance is small against what they share, and extends nothing.

Positions are ordered by the words that follow (ranks of 1, 2, 4, ... words refine each other; positions that share fewer
words with any other than a run needs leave early), and the intervals of common prefixes are built from the deepest up.
Every interval keeps its positions in order, with the word to the left of each as its class. Where an interval of m
common words takes in a child, a pair is looked for only between a position and its neighbours on the other side: occurrences
of the same m words closer than m / (least_exponent - 1) are spaced by one period and, but for the first, are of one class,
so a pair of two classes is one of neighbours. The smaller side always moves into the larger one.

A null or empty text, or one of fewer words than a run needs, has no run. Words are compared as they are. Rows that repeat,
or that have no doc_id, are texts of their own. Other columns are not read, whatever their names. Very long texts are
searched whole, in one task each: time grows as n log n, memory as n. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewright.llm.bpe import runs_of_text

#: Characters of text searched together.
BLOCK_CHARS = 1 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"


@dataclass(frozen=True)
class RunSearch:
    least_length: int = 24
    #: Length by period.
    least_exponent: int = 3

    @property
    def least_shared(self) -> int:
        """Words that the two positions of a run's pair share at least."""
        return max(1, -(-self.least_length * (self.least_exponent - 1) // self.least_exponent))


class WordNumbers(dict):
    """Words to numbers in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _regrouped(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by both keys, new rank of each in that order, which ones share their keys with another).

    Ranks are places of groups among all; a group of ``first`` is divided within its own places.
    """
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    place = np.arange(len(a))
    outer, inner = np.ones(len(a), bool), np.ones(len(a), bool)
    outer[1:] = a[1:] != a[:-1]
    inner[1:] = outer[1:] | (b[1:] != b[:-1])
    begin = np.maximum.accumulate(np.where(inner, place, 0)) - np.maximum.accumulate(np.where(outer, place, 0))
    alone = inner & np.append(inner[1:], True)
    return order, a + begin, ~alone


def shared_prefixes(numbers: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order of the words that follow them, words that each shares with the next one).

    ``first`` holds the first position of each text and the end of the last; positions of different texts share nothing.
    Only positions that share about ``least`` words with another are listed.
    """
    n = len(numbers)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = np.repeat(first[1:], np.diff(first))
    rank = np.full(n + 1, -1, np.int32)
    order = np.lexsort((numbers, row))
    changes = np.ones(n, bool)
    changes[1:] = (row[order][1:] != row[order][:-1]) | (numbers[order][1:] != numbers[order][:-1])
    rank[order] = np.maximum.accumulate(np.where(changes, np.arange(n), 0))
    active = order[~(changes & np.append(changes[1:], True))] if n else order
    levels, reach, chosen = [rank.copy()], 1, active if least < 2 else None
    while len(active):
        following = active + reach
        second = np.where(following < end[active], rank[np.minimum(following, n)], -1)
        order, ranks, shared = _regrouped(rank[active], second)
        active = active[order]
        rank[active] = ranks
        active = active[shared]
        levels.append(rank.copy())
        reach *= 2
        if chosen is None and 2 * reach > least:
            chosen = active
    if chosen is None or not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ordered = chosen[np.argsort(rank[chosen], kind="stable")]
    one, two = ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64)
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level][one] == levels[level][two]
        one[same] += 1 << level
        two[same] += 1 << level
    return ordered, np.append(one - ordered[:-1], 0)


def maximal_pairs(positions: list[int], shared: list[int], left: dict[int, int], params: RunSearch) -> dict[tuple[int, int], int]:
    """(start, length) of all runs with their smallest period, from intervals of common prefixes built bottom up.

    ``left`` is the class of each position: the word before it.
    """
    least, repeats, shortest = params.least_shared, params.least_exponent - 1, params.least_length
    found: dict[tuple[int, int], int] = {}

    def pair(one: int, two: int, common: int) -> None:
        if one > two:
            one, two = two, one
        period = two - one
        if period * repeats <= common and period + common >= shortest and left[one] != left[two]:
            key = (one, period + common)
            if found.get(key, period + 1) > period:
                found[key] = period

    def merged(common: int, one: list[int], two: list[int]) -> list[int]:
        if len(one) < len(two):
            one, two = two, one
        places = []
        for position in two:
            at = bisect_left(one, position)
            if at:
                pair(one[at - 1], position, common)
            if at < len(one):
                pair(position, one[at], common)
            places.append(at)
        if len(two) == 1:
            one.insert(places[0], two[0])
        elif len(two) * 8 > len(one):
            one += two
            one.sort()
        else:
            for at, position in zip(reversed(places), reversed(two)):
                one.insert(at, position)
        return one

    depths: list[int] = []
    members: list[list[int]] = []
    for position, common in zip(positions, shared):
        # the position's own leaf, then every interval that ends with it
        done = [position]
        while depths and depths[-1] > common:
            done = merged(depths.pop(), members.pop(), done)
        if depths and depths[-1] == common:
            members[-1] = merged(common, members[-1], done)
        elif common >= least:
            depths.append(common)
            members.append(done)
    return found


def _block_runs(words: list[list[bytes]], params: RunSearch) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start and period."""
    numbering = WordNumbers()
    flat = np.array([n for text in words for n in map(numbering.__getitem__, text)], np.int64)
    first = np.concatenate(([0], np.cumsum([len(text) for text in words]))).astype(np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    order, shared = shared_prefixes(flat, first, params.least_shared)
    if len(order):
        before = flat[order - 1]
        before[np.isin(order, first[:-1])] = -1
        found = maximal_pairs(order.tolist(), shared.tolist(), dict(zip(order.tolist(), before.tolist())), params)
        if found:
            starts = np.array([s for s, _ in found], np.int64)
            rows = np.searchsorted(first, starts, side="right") - 1
            for (start, length), row, period in zip(found, rows.tolist(), found.values()):
                out[row].append((start - int(first[row]), length, period))
            for row in set(rows.tolist()):
                out[row].sort(key=lambda run: (run[0], run[2]))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words but for those that any run holds after its first period, joined by a blank."""
    if runs:
        steps = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            steps[start + period] += 1
            steps[start + length] -= 1
        inside = np.cumsum(steps[:-1]) > 0
        words = [word for word, drop in zip(words, inside.tolist()) if not drop]
    return b" ".join(words).decode("utf-8")


def find_runs(docs: DataFrame, params: RunSearch = RunSearch()) -> DataFrame:
    """``doc_id, n_words, runs array<struct<start, length, period>>, collapsed`` of every whole text.

    Runs are by start, then period, counted in words from 0. ``collapsed`` is the text with one period left of each run.
    """
    kinds = [pa.int64(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]

    def run(batches):
        for batch in batches:
            counts, runs, collapsed = [], [], []
            for texts in runs_of_text(batch.column(1), BLOCK_CHARS):
                words = [text.encode("utf-8").split() if text else [] for text in texts]
                found = _block_runs(words, params)
                counts += map(len, words)
                runs += [[{"start": s, "length": n, "period": p} for s, n, p in each] for each in found]
                collapsed += map(_collapsed, words, found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, kind) for v, kind in zip((counts, runs, collapsed), kinds))],
                ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def summarise(found: DataFrame) -> DataFrame:
    """``doc_id``, the number of runs, the run of the greatest exponent and digests of all runs and of the collapsed text."""
    best = F.expr(f"""aggregate(runs, cast(null as {RUN}), (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period
        OR (r.length * b.period = b.length * r.period AND (r.start < b.start OR (r.start = b.start AND r.period < b.period)))
        THEN r ELSE b END)""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
