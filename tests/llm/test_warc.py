"""WARC archives: round trip, copies, rolling, same bytes whatever the partitions, nulls, ties, repeated rows, clashing columns, recovery."""

import collections
import gzip
import hashlib
import os

import pytest

from routewright.llm import queries, warc
from routewright.llm.warc import WarcFiles
from routewright.session import staging_path

SCHEMA = "page_id long, url string, html string, shard int, digest string, keeper long"
SMALL = WarcFiles(shard_bytes=8000, file_bytes=3000, least_copy=20)


def pages(spark, rows, partitions=3):
    return spark.createDataFrame([(i, u, h, -1, "x", -2) for i, u, h in rows], SCHEMA).repartition(partitions)


def page_rows():
    long = "<p>copy</p>" * 30
    out = [(n, f"http://h/{n}", f"<p>{hashlib.md5(str(n).encode()).hexdigest() * (n % 60)}</p>") for n in range(200)]
    out += [(1000 + n, f"http://c/{n}", long) for n in range(40)] + [(2000, "u", "short"), (2001, "u", "short"), (2002, "a b\r\nc", "é" * 30), (2003, None, None)]
    return out


def expected(rows, least=20):
    keepers = {}
    for page_id, _, html in rows:
        if len((html or "").encode()) >= least:
            keepers[html] = max(keepers.get(html, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        keeper = keepers.get(html, page_id)
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if keeper == page_id else "revisit", None if keeper == page_id else keeper))
    return sorted(out)


def digest_columns(df):
    return df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def files_of(path):
    folder = f"{path.removeprefix('file://')}/data"
    return {name: open(f"{folder}/{name}", "rb").read() for name in sorted(os.listdir(folder)) if not name.startswith(".")}


def test_round_trip_and_same_bytes_whatever_the_partitions(spark):
    rows, seen = page_rows(), []
    for partitions in (1, 7):
        path = staging_path(spark, "warc-test")
        manifest = warc.write_archive(pages(spark, rows, partitions), path, SMALL).collect()
        got = warc.read_archive(spark, path)
        assert sorted(map(tuple, digest_columns(got).collect())) == expected(rows)
        found = files_of(path)
        assert {m.file: (m.bytes, m.sha256) for m in manifest} == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in found.items()}
        assert sum(m.records for m in manifest) == len(rows) and len({m.shard for m in manifest}) > 3
        assert all(m.bytes <= SMALL.file_bytes or m.records == 1 for m in manifest)
        assert not os.path.exists(f"{path}/_temporary")
        seen.append(found)
        ids = {r.record_id for r in got.collect()}
        assert len(ids) == len(rows)
    assert seen[0] == seen[1]


def test_records_are_sorted_and_standard(spark):
    path = staging_path(spark, "warc-test")
    warc.write_archive(pages(spark, page_rows()), path, SMALL)
    order, referred, ids = [], set(), {}
    for data in files_of(path).values():
        kinds = []
        for text in gzip.decompress(data).split(b"WARC/1.1\r\n")[1:]:
            headers, _ = warc.parse_record(b"WARC/1.1\r\n" + text)
            kinds.append(headers["WARC-Type"])
            if "X-Page-Id" in headers:
                order.append(int(headers["X-Page-Id"]))
                ids[headers["WARC-Record-ID"]] = headers["WARC-Type"]
                referred |= {headers["WARC-Refers-To"]} if "WARC-Refers-To" in headers else set()
                assert "\r" not in headers["WARC-Target-URI"]
        assert kinds[0] == "warcinfo" and kinds.count("warcinfo") == 1
    assert order == sorted(order)
    assert referred and all(ids[i] == "response" for i in referred)


def test_null_and_repeated_ids_and_a_hot_page(spark):
    long = "z" * 40
    rows = [(None, "b", long), (None, "a", long), (5, "x", long), (5, "y", long), (5, None, "other" * 9), (None, None, None)]
    rows += [(7, f"u{n}", f"{n}" * 900) for n in range(1, 60)]
    path = staging_path(spark, "warc-test")
    manifest = warc.write_archive(pages(spark, rows), path, SMALL).collect()
    got = digest_columns(warc.read_archive(spark, path)).collect()
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id != 7)
    assert kinds == {(None, "revisit", 5): 2, (5, "response", None): 2, (5, "revisit", 5): 1, (None, "response", None): 1}
    assert sum(r.page_id == 7 and r.record_type == "response" for r in got) == 59
    assert len({m.shard for m in manifest}) > 3  # the one page_id is divided by digest

    path = staging_path(spark, "warc-test")
    warc.write_archive(pages(spark, [(None, "b", long), (None, "a", long)]), path, SMALL)
    assert sorted((r.record_type, r.refers_to, r.url) for r in warc.read_archive(spark, path).collect()) == [("response", None, "a"), ("revisit", None, "b")]


def test_far_apart_ids(spark):
    rows = [(-(1 << 63), "a", "x"), ((1 << 63) - 1, "b", "y"), (0, "c", "z" * 50)]
    path = staging_path(spark, "warc-test")
    warc.write_archive(pages(spark, rows), path, SMALL)
    assert sorted(map(tuple, digest_columns(warc.read_archive(spark, path)).collect())) == expected(rows)


def test_files_without_a_name_do_not_count_and_damage_is_noticed(spark):
    path = staging_path(spark, "warc-test")
    warc.write_archive(pages(spark, page_rows()), path, SMALL)
    names = list(files_of(path))
    with open(f"{path.removeprefix('file://')}/data/shard-999999-00000.warc.gz", "wb") as out:
        out.write(b"left by a lost task")
    assert warc.read_archive(spark, path).count() == len(page_rows())
    target = f"{path.removeprefix('file://')}/data/{names[0]}"
    data = open(target, "rb").read()
    with open(target, "wb") as out:
        out.write(data[:-40])
    with pytest.raises(Exception, match="ends inside|Error|zlib|EOF"):
        warc.read_archive(spark, path).collect()


def test_empty_table_and_query(spark, tmp_path):
    path = staging_path(spark, "warc-test")
    assert warc.write_archive(pages(spark, []), path).count() == 0 and warc.read_archive(spark, path).count() == 0
    rows = page_rows()
    pages(spark, rows).drop("shard", "digest", "keeper").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, queries.op12_warc(spark, str(tmp_path)).collect())) == expected(rows, 1000)
