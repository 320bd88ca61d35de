"""Token ids in directly addressable files.

Ids are split into byte-wide chunks. Level 0 holds the low byte of every id, level 1 the next byte of those that go on,
and so on. A continuation bitmap on each level tells which ids go on, and its rank directory (ones before every 512th
place) says where: any id is read from one byte of each of its levels, without decoding a block.

A file is a Parquet part with one row for each run of documents: ``shard, run, n_ids``, the doc_ids, the id counts, and
the coded ids. Shards follow each other in ascending doc_id order, runs within shards too.

Null and empty texts have no ids but the end id. Rows without a doc_id come first; rows that repeat one are ordered by
text. Other columns are not read. An empty table gives files without rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routewright.llm.bpe import runs_of_text, shared_vocabulary

#: Entries after which a worker's cache starts anew; it only saves work.
CACHE_CHUNKS = 1_200_000
#: Ids after which a run of documents ends; a longer document is a run of its own.
RUN_IDS = 1 << 19
_MAGIC = b"DAC1"
_BLOCK_BITS = 512


class Addressable:
    """Ids coded in levels; reads any place or range."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        #: (bytes, bitmap as 64-bit words, ones before each block) by level
        self.levels = levels

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    @classmethod
    def encode(cls, ids: np.ndarray) -> Addressable:
        """Of unsigned 32-bit integers."""
        rest, levels = ids.astype(np.uint32), []
        while len(rest) or not levels:
            goes_on = rest > 255
            padded = np.zeros(-(-len(rest) // _BLOCK_BITS) * _BLOCK_BITS, bool)
            padded[: len(rest)] = goes_on
            ones = padded.reshape(-1, _BLOCK_BITS).sum(1, dtype=np.uint32)
            before = np.concatenate(([0], np.cumsum(ones))).astype(np.uint32)
            levels.append((rest.astype(np.uint8), np.packbits(padded, bitorder="little").view("<u8"), before))
            rest = rest[goes_on] >> np.uint32(8)
        return cls(levels)

    def to_bytes(self) -> bytes:
        out = [_MAGIC, struct.pack("<I", len(self.levels))]
        for chunk, bitmap, before in self.levels:
            out += [struct.pack("<Q", len(chunk)), chunk.tobytes(), bitmap.astype("<u8").tobytes(), before.astype("<u4").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Addressable:
        if data[:4] != _MAGIC:
            raise ValueError("not a run of coded ids")
        place, levels = 8, []
        for _ in range(struct.unpack_from("<I", data, 4)[0]):
            (n,) = struct.unpack_from("<Q", data, place)
            blocks = -(-n // _BLOCK_BITS)
            place += 8
            chunk = np.frombuffer(data, np.uint8, n, place)
            bitmap = np.frombuffer(data, "<u8", blocks * 8, place + n)
            before = np.frombuffer(data, "<u4", blocks + 1, place + n + blocks * 64)
            levels.append((chunk, bitmap, before))
            place += n + blocks * 64 + 4 * (blocks + 1)
        return cls(levels)

    @staticmethod
    def _rank(bitmap: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before each place: the directory's count, and what the block's words hold up to there."""
        block, word, bit = at >> 9, at >> 6 & 7, (at & 63).astype(np.uint64)
        out = before[block].astype(np.int64)
        for n in range(8):
            words = bitmap[np.minimum(block * 8 + n, len(bitmap) - 1)]
            masked = np.where(n < word, words, np.where(n == word, words & ((np.uint64(1) << bit) - np.uint64(1)), np.uint64(0)))
            out += np.bitwise_count(masked)
        return out

    def at(self, places) -> np.ndarray:
        """Ids at any places, in any order."""
        places = np.asarray(places, np.int64)
        if len(places) and not (0 <= places.min() and places.max() < len(self)):
            raise IndexError("a place outside the run")
        out, open_ = np.zeros(len(places), np.uint32), np.arange(len(places))
        for level, (chunk, bitmap, before) in enumerate(self.levels):
            out[open_] |= chunk[places].astype(np.uint32) << np.uint32(8 * level)
            on = (bitmap[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            open_, places = open_[on], self._rank(bitmap, before, places[on]) if on.any() else places[:0]
            if not len(open_):
                break
        return out

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids of the places from start to stop; each level is entered once through its directory."""
        out, open_ = np.zeros(stop - start, np.uint32), np.arange(stop - start)
        for level, (chunk, bitmap, before) in enumerate(self.levels):
            if start >= stop:
                break
            out[open_] |= chunk[start:stop].astype(np.uint32) << np.uint32(8 * level)
            first = start >> 6
            bits = np.unpackbits(bitmap[first:(stop - 1 >> 6) + 1].view(np.uint8), bitorder="little")
            on = bits[start - (first << 6):][: stop - start].view(bool)
            start = int(self._rank(bitmap, before, np.array([start]))[0])
            open_ = open_[on]
            stop = start + len(open_)
        return out


class LibraryIds(dict):
    """Ids of texts by the tokenizers library; each piece between white space is encoded once and kept as bytes."""

    def __init__(self, content: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(content)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._tokens = self._tokenizer.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = self._piece(piece)
        return ids

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():  # such letters are their own byte letters
            if piece.isalpha():
                lower = piece.lower()
                return self[lower] if lower != piece else array("I", [t.id for t in self._tokens(piece)]).tobytes()
            if len(piece) > 1 and piece[-1] in ".,!?;:" and piece[:-1].isalpha():
                return self[piece[:-1].lower()] + self[piece[-1]]
        return array("I", self._tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, but not to the library
            return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.split()))

    def trim(self) -> None:
        if len(self) > CACHE_CHUNKS:
            self.clear()


@lru_cache(maxsize=2)
def _library(content: str) -> LibraryIds:
    return LibraryIds(content)


_FILE = "shard int, run int, n_ids long, doc_ids binary, has_id binary, counts binary, coded binary"


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> None:
    """Encode every whole text, append ``end_id``, and write the files in ascending doc_id order."""
    shared = shared_vocabulary(docs.sparkSession, vocabulary)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        library, shard = _library(shared.value), TaskContext.get().partitionId()
        number, ids, coded, size = 0, [], [], 0

        def packed():
            counts = np.array([len(c) // 4 for c in coded], "<i8")
            values = [shard, number, int(counts.sum()), np.array([i or 0 for i in ids], "<i8").tobytes(),
                      np.array([i is not None for i in ids], np.uint8).tobytes(), counts.tobytes(),
                      Addressable.encode(np.frombuffer(b"".join(coded), "<u4")).to_bytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)],
                                              ["shard", "run", "n_ids", "doc_ids", "has_id", "counts", "coded"])

        for batch in batches:
            names, row = batch.column(0).to_pylist(), 0
            for texts in runs_of_text(batch.column(1)):
                for text in texts:
                    tokens = library.encode(text or "") + end
                    if coded and size + len(tokens) // 4 > RUN_IDS:
                        yield packed()
                        number, ids, coded, size = number + 1, [], [], 0
                    ids.append(names[row])
                    coded.append(tokens)
                    size += len(tokens) // 4
                    row += 1
                library.trim()
        if coded:
            yield packed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, _FILE).write.option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files; start counts the ids of all documents before it."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], "<i8")
                begins = np.concatenate(([0], np.cumsum(counts)))
                coded = Addressable.from_bytes(row["coded"])
                ids = memoryview(coded.range(0, len(coded)).astype("<u4").tobytes())
                crc = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(begins.tolist(), begins[1:].tolist())]
                have = np.frombuffer(row["has_id"], np.uint8).astype(bool)
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["shard"]), pa.int32()), pa.array(np.full(n, row["run"]), pa.int32()),
                     pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=~have), pa.array(begins[:-1], pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                    ["shard", "run", "doc_id", "within", "n_tokens", "ids_crc32"])

    files = spark.read.schema(_FILE).parquet(path)
    sizes = files.select("shard", "run", "n_ids")
    # one row for each shard, as many as the writing job had partitions
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    runs = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("shard", "run", F.coalesce(F.sum("n_ids").over(runs), F.lit(0)).alias("in_shard")).join(shards, "shard")
    found = files.mapInArrow(run, "shard int, run int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return found.join(begins, ["shard", "run"]).select(
        "doc_id", (F.col("before") + F.col("in_shard") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
