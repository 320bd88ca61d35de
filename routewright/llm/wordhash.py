"""Word and shingle hashes of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer text is a block of its own, hashed piece by piece.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


@dataclass
class Block:
    """Words of consecutive rows: byte ranges, hashes, and the first word of each row (one entry more than rows)."""

    rows: range
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    begin = 0
    while begin < len(starts):
        stop = max(begin + 1, int(np.searchsorted(ends, starts[begin] + BLOCK_BYTES, side="right")))
        origin, limit = int(starts[begin]), int(ends[stop - 1])
        piece = data[origin:limit].astype(np.uint64) + np.uint64(1)
        piece *= _powers(_BASE, len(piece))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(piece, dtype=np.uint64)))
        low, high = starts[begin:stop] - origin, ends[begin:stop] - origin
        out[begin:stop] = (sums[high] - sums[low]) * _powers(_BASE_INVERSE, len(piece) + 1)[low] + (high - low).astype(np.uint64)
        begin = stop
    return mix(out)


def blocks(column: pa.Array, is_space: np.ndarray = IS_SPACE, clean=None) -> Iterator[Block]:
    """Rows of a non-null string column in blocks of about ``BLOCK_BYTES``; words are runs of bytes outside ``is_space``.

    A-Z are lower-cased; ``clean`` may then change bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offset_buffer, data_buffer = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offset_buffer, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    everything = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(column):
        stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BLOCK_BYTES, side="right")) - 1)
        data = everything[offsets[begin]:offsets[stop]]
        data = TO_LOWER[data]
        if clean is not None:
            data = clean(data)
        places = offsets[begin:stop + 1] - offsets[begin]
        inside = ~is_space[data]
        opens, closes = np.ones(len(data), bool), np.ones(len(data), bool)
        if len(data):
            opens[1:] = ~inside[:-1]
            closes[:-1] = ~inside[1:]
            opens[places[:-1][places[:-1] < len(data)]] = True
            closes[places[1:][places[1:] > 0] - 1] = True
        starts, ends = np.flatnonzero(inside & opens), np.flatnonzero(inside & closes) + 1
        yield Block(range(begin, stop), data, starts, ends, _hash_words(data, starts, ends), np.searchsorted(starts, places))
        begin = stop


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes row by row, bounds of the rows in them); a row of fewer than ``k`` words has one shingle."""
    h, counts = block.hashes, np.diff(block.first)
    row = block.row_of_word()
    if len(h) >= k:
        joined = np.zeros(len(h) - k + 1, np.uint64)
        for n in range(k):
            joined = mix(joined + np.uint64(n + 1)) * np.uint64(3) + h[n:len(h) - k + 1 + n]
        whole = row[: len(joined)] == row[k - 1:]
        joined, owner = mix(joined)[whole], row[: len(joined)][whole]
    else:
        joined, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(counts)))))
    short = np.flatnonzero((counts > 0) & (counts < k)).tolist()
    sets, sequences = [], (sequence_hashes(block, 0x5B) if short else None)
    short = set(short)
    for n in range(len(counts)):
        if n in short:
            sets.append(sequences[n:n + 1])
        else:
            sets.append(np.unique(joined[bounds[n]:bounds[n + 1]]))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def sequence_hashes(block: Block, seed: int) -> np.ndarray:
    """One hash for the word sequence of each row; 0 for rows without words."""
    counts = np.diff(block.first)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        place = np.arange(len(block.hashes)) - np.repeat(block.first[:-1], counts)
        each = mix(block.hashes + mix(place.astype(np.uint64) + np.uint64(seed << 32)))
        out[full] = mix(np.add.reduceat(each, block.first[:-1][full]) + np.uint64(seed))
    return out
