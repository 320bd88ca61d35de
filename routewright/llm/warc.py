"""WARC archives of pages: a deterministic sharded writer, and a reader that checks every digest.

Records are cut into shards by ranges of page_id whose bounds follow from exact byte sums, never from samples or from how
Spark dealt the rows; inside a shard they are sorted, and files roll when their compressed size would pass a limit. So the
same pages give the same files, byte for byte, on any cluster. Headers, record ids and digests are made anew from the
payload. Files are written under temporary names of their own attempt; which of them count is told by a table that Spark
commits, a second job gives these their names, and the manifest, written last, is all that readers look at. A lost executor
or a second attempt leaves a file that nobody names.

Of records with equal payloads of ``least_copy`` bytes or more, the one with the largest page_id is a response and the
others are revisits of it, without the payload. The verdict travels to the writer as a row that sorts before its record, so
the payloads are shuffled once.

A null html is an empty payload. Rows that repeat page_id and payload are records of their own: if the group's response is
among them, it is the first by url. Pages without a page_id come first and have no such header; where no copy has one, the
first by url is the response and the others refer to null. A page_id that fills more than a shard is divided by payload digest; rows alike in both
are written by one task. Other columns are not read. An empty table gives an archive without files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routewright.session import cut_lineage, drop_path

#: Slots of page_ids whose bytes are summed: some for each shard, within these bounds.
_SLOTS_A_SHARD, _LEAST_SLOTS, _MOST_SLOTS = 16, 1 << 10, 1 << 18
_COPY_SALTS = 16
_RECORD_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-record")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "file string, shard int, records long, bytes long, sha256 string"


@dataclass(frozen=True)
class WarcFiles:
    #: Payload bytes of a shard, which one task writes.
    shard_bytes: int = 32 << 20
    #: Compressed bytes of a file; one record may be larger.
    file_bytes: int = 16 << 20
    least_copy: int = 1000
    level: int = 6
    #: Pages carry no time of their own.
    date: str = "2000-01-01T00:00:00Z"


def _prepared(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("digest"))


def _copies(narrow: DataFrame, params: WarcFiles) -> DataFrame:
    """``page_id, digest, keeper`` of the pages that share a payload; a payload of very many pages is joined in parts."""
    long_enough = narrow.where(F.col("n_bytes") >= params.least_copy)
    groups = long_enough.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where("n > 1").drop("n")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_COPY_SALTS - 1))))
    salted = long_enough.select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(_COPY_SALTS)).cast("int").alias("salt"))
    return salted.join(groups, ["digest", "salt"]).select("page_id", "digest", "keeper").distinct()


def _shards(narrow: DataFrame, params: WarcFiles) -> tuple[int, int, list[tuple[int, int, int]]]:
    """(smallest page_id, ids in a slot, (slot, first shard, shards) of each slot): a bounded table however many pages there are."""
    low, high, total = narrow.agg(F.min("page_id"), F.max("page_id"), F.sum("n_bytes")).first()
    low, high = (0, 0) if low is None else (low, high)
    slots = min(max(_SLOTS_A_SHARD * ((total or 0) // params.shard_bytes + 1), _LEAST_SLOTS), _MOST_SLOTS)
    width = max(1, -(-(high - low + 1) // slots))
    sums = narrow.groupBy(_slot(low, width).alias("slot")).agg(F.sum("n_bytes").alias("n")).orderBy("slot").collect()
    out, shard, filled = [], 0, 0
    for slot, n in sums:
        if filled and filled + n > params.shard_bytes:
            shard, filled = shard + 1, 0
        parts = max(1, -(-n // params.shard_bytes))
        out.append((slot, shard, parts))
        filled += n
        if parts > 1:
            shard, filled = shard + parts, 0
    return low, width, out


def _slot(low: int, width: int) -> Column:
    # exact for every difference of two longs
    place = ((F.col("page_id").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)"))
    return F.when(F.col("page_id").isNull(), F.lit(-1)).otherwise(F.floor(place)).cast("int")


def _uri(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:") and "://" not in full else full


def _safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c.group()):02X}", url)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_RECORD_IDS, f'{page_id}/{digest}/{number}')}>"


def _record(headers: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    lines = [f"{name}: {value}" for name, value in headers if value is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return gzip.compress(head.encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n", level, mtime=0)


def page_record(page_id, url, payload: bytes, digest: str, number: int, revisits: bool, keeper, params: WarcFiles) -> bytes:
    """One compressed record; ``number`` counts the records before it with the same page_id and payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    return _record([
        ("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", record_id(page_id, digest, number)),
        ("WARC-Date", params.date), ("WARC-Target-URI", _safe(url) if url else f"urn:page:{page_id}"),
        ("WARC-Profile", _PROFILE if revisits else None), ("WARC-Refers-To", record_id(keeper, digest, 0) if revisits else None),
        ("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", page_id), ("X-Refers-To-Page-Id", keeper if revisits else None), ("X-Payload-Length", len(payload)),
    ], block, params.level)


class _Files:
    """The files of one shard after another, each under a temporary name."""

    def __init__(self, folder: str, params: WarcFiles):
        from pyarrow import fs

        self.params, self.out, self.done = params, None, []
        self.filesystem, self.root = fs.FileSystem.from_uri(folder)
        self.shard, self.number = None, 0

    def _begin(self) -> None:
        self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.temporary = f"_temporary/{uuid.uuid4().hex}.warc.gz"
        self.out = self.filesystem.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
        self.hash, self.size, self.records = hashlib.sha256(), 0, 0
        fields = b"software: routewright\r\nformat: WARC File Format 1.1\r\n"
        self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name, 0)), ("WARC-Date", self.params.date),
                           ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], fields, self.params.level))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.end()
            self.shard, self.number = shard, 0
        elif self.records and self.size + len(data) > self.params.file_bytes:
            self.end()
            self.number += 1
        if self.out is None:
            self._begin()
        self._put(data)
        self.records += 1

    def end(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.done.append((self.name, self.shard, self.records, self.size, self.hash.hexdigest(), self.temporary))


def write_archive(pages: DataFrame, folder: str, params: WarcFiles = WarcFiles()) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``folder``; returns the manifest ``file, shard, records, bytes, sha256``."""
    spark = pages.sparkSession
    folder = _uri(spark, folder)
    rows = _prepared(pages)
    narrow = cut_lineage(rows.select("page_id", "n_bytes", "digest"))
    low, width, slots = _shards(narrow, params)
    count = slots[-1][1] + slots[-1][2] if slots else 1
    # at most one row for each of the slots
    places = F.broadcast(spark.createDataFrame(slots, "slot int, shard int, parts int"))
    # the first bits of the digest divide a slot that fills several shards
    part = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.col("parts") / F.lit(1 << 32)).cast("int")
    verdicts = _copies(narrow, params).select(
        "page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "keeper")
    records = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("keeper"))
    placed = verdicts.union(records).withColumn("slot", _slot(low, width)).join(places, "slot").withColumn("shard", F.col("shard") + part)
    order = ["shard", "page_id", "digest", "kind", "url"]
    sorted_rows = placed.select("shard", "page_id", "digest", "kind", "url", "payload", "keeper").repartitionById(count, F.col("shard"))
    sorted_rows = sorted_rows.sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]):
        files = _Files(folder, params)
        files.filesystem.create_dir(f"{files.root}/_temporary", recursive=True)
        last, number, copied, keeper = None, 0, False, None
        for batch in batches:
            ids, digests, kinds, keepers = (batch.column(n).to_pylist() for n in (1, 2, 3, 6))
            shards, urls, payloads = batch.column(0).to_pylist(), batch.column(4), batch.column(5)
            for n, key in enumerate(zip(ids, digests)):
                if key != last:
                    last, number, copied = key, 0, False
                if kinds[n] == 0:
                    copied, keeper = True, keepers[n]
                    continue
                page_id, digest = key
                revisits = copied and (keeper != page_id or number > 0)
                data = page_record(page_id, urls[n].as_py(), payloads[n].as_py(), digest, number, revisits, keeper, params)
                files.add(shards[n], data)
                number += 1
        files.end()
        columns = list(zip(*files.done)) or [()] * 6
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         ["file", "shard", "records", "bytes", "sha256", "temporary"])

    # what Spark commits here names one attempt of every task
    written = cut_lineage(sorted_rows.mapInArrow(write, _MANIFEST + ", temporary string"))

    def name(batches: Iterator[pa.RecordBatch]):
        from pyarrow import fs

        filesystem, root = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(f"{root}/data", recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{root}/{row['temporary']}", f"{root}/data/{row['file']}"
                if filesystem.get_file_info(source).type == fs.FileType.File:
                    filesystem.move(source, target)
                elif filesystem.get_file_info(target).size != row["bytes"]:
                    raise OSError(f"{row['file']} is not whole")
            yield batch.select(["file", "shard", "records", "bytes", "sha256"])

    written.mapInArrow(name, _MANIFEST).write.parquet(f"{folder}/manifest")
    drop_path(spark, f"{folder}/_temporary")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def members(stream) -> Iterator[bytes]:
    """Decompressed gzip members of a file-like object, one at a time."""
    rest, decoder, parts = b"", zlib.decompressobj(31), []
    while True:
        rest = rest or stream.read(1 << 20)
        if not rest:
            if parts or decoder.unconsumed_tail:
                raise EOFError("the archive ends inside a record")
            return
        parts.append(decoder.decompress(rest))
        rest = b""
        if decoder.eof:
            yield b"".join(parts)
            rest, decoder, parts = decoder.unused_data, zlib.decompressobj(31), []


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record; its length and digest must hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    block = rest[:size]
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n" or headers.get("WARC-Block-Digest", _sha1(block)) != _sha1(block):
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return headers, block


_READ = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, "
         "file string")


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _read_row(headers: dict[str, str], block: bytes, file: str) -> tuple:
    digest, size = headers["WARC-Payload-Digest"], int(headers["X-Payload-Length"])
    if headers["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or _sha1(payload) != digest:
            raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
    digest = base64.b32decode(digest.removeprefix("sha1:")).hex()
    return (_number(headers.get("X-Page-Id")), headers["WARC-Target-URI"], size, digest, headers["WARC-Type"],
            _number(headers.get("X-Refers-To-Page-Id")), headers["WARC-Record-ID"], file)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, file`` of every page record that the manifest names."""
    folder = _uri(spark, folder)
    kinds = [pa.int64() if field.endswith("long") else pa.string() for field in _READ.split(", ")]
    names = [field.split()[0] for field in _READ.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names)

    def read(batches: Iterator[pa.RecordBatch]):
        from pyarrow import fs

        filesystem, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, found = [], 0
                with filesystem.open_input_stream(f"{root}/data/{file}", compression=None) as stream:
                    for data in members(stream):
                        headers, block = parse_record(data)
                        if headers["WARC-Type"] in ("response", "revisit"):
                            rows.append(_read_row(headers, block, file))
                            found += 1
                            if len(rows) == 5000:
                                yield table(rows)
                                rows = []
                if found != expected:
                    raise ValueError(f"{file} holds {found} records, not {expected}")
                yield table(rows)

    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("file", "records")
    count = max(1, files.count())
    spread = files.repartition(min(count, 10_000), "file")
    return spread.mapInArrow(read, _READ)
