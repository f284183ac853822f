import gzip
import hashlib
import io
import random
import zipfile

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from gleanery.llm import warc

PAGES = "page_id long, url string, html string, payload string, digest long, of string, head long, path string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y", 2, "z") for i, u, h in rows], PAGES)


def awkward():
    rng = random.Random(2)
    same = "<p>équal \U0001f600</p>" * 9
    rows = [(k, f"http://a.example/{k}", f"<html>{rng.random()}</html>" * rng.randrange(1, 40)) for k in range(40)]
    rows += [(50, "http://b.example/ö x\r\nEvil: y", same), (41, None, same), (None, "u", same), (41, None, same), (60, "", same)]
    rows += [(61, "u", "short"), (62, "u", "short"), (63, "u", None), (64, "u", ""), (None, None, None), (65, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (66, "v", "\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    return rows + [(None, "u", "without an id " * 20), (None, "w", "without an id " * 20), (70, "u", "y" * 2_000_000), (-9, "u", "y" * 99), (-8, "u", "y" * 99), (-7, "u", "z" * 100), (-6, "u", "z" * 100)]


def brute(rows):
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        ids = [j for j, _, other in rows if (other or "").encode() == raw and j is not None]
        again = len(raw) >= 100 and bool(ids) and i != min(ids)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(map(str, out))


def shown(df):
    return sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in df.collect())


def test_round_trip_equals_brute_force(spark):
    got = warc.round_trip(pages(spark, awkward()).repartition(3))
    assert shown(got) == brute(awkward())
    assert got.filter(~F.col("intact")).count() == 0
    assert {r["url"] for r in got.filter("page_id IN (41, 50, 60)").collect()} == {None, "http://b.example/ö%20x%0D%0AEvil:%20y", ""}


def test_small_packages_ranges_and_lookup(spark, tmp_path):
    packages = warc.write_packages(pages(spark, awkward()), f"file://{tmp_path}", package_bytes=2000)
    assert packages.count() > 3 and packages.agg(F.sum("records")).first()[0] == len(awkward())
    places = warc.read_index(packages)
    for size in (1, 100, 1 << 30):
        assert shown(warc.read_records(places, size)) == brute(awkward())
    found = warc.read_records(places.filter("url = 'http://a.example/7'")).collect()
    assert [bytes(r["payload"]).decode() for r in found] == [awkward()[7][2]]
    for row in packages.collect():  # what other readers make of a package
        with zipfile.ZipFile(row["path"].removeprefix("file://")) as z:
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            assert gzip.decompress(z.read(warc.DATA)).count(b"WARC/1.1\r\nWARC-Type") == row["records"]


def test_other_partitions_tell_the_same(spark):
    docs = pages(spark, awkward())
    assert shown(warc.round_trip(docs.repartition(1))) == shown(warc.round_trip(docs.repartition(11)))


@pytest.mark.parametrize("limit", [None, 50])
def test_directories_equal_those_of_the_standard_library(tmp_path, monkeypatch, limit):
    if limit:  # all sizes, places and counts beyond it go to ZIP64 fields
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.comment = b"a comment" * 30
        for k in range(30):
            info = zipfile.ZipInfo(f"archive/é{k}.warc" if k % 2 else f"n{k}")
            info.comment = b"c" * k
            z.writestr(info, b"line\n" * k * k, zipfile.ZIP_DEFLATED if k % 3 == 0 else zipfile.ZIP_STORED)
    with warc.source(f"file://{path}") as file, zipfile.ZipFile(path) as z:
        found = warc.members(file)
        assert {n: (m["method"], m["packed"], m["size"], m["header"]) for n, m in found.items()} == {i.filename: (i.compress_type, i.compress_size, i.file_size, i.header_offset) for i in z.infolist()}
        for name, m in found.items():
            if m["method"] == 0:
                assert warc.read_range(file, warc.data_start(file, m), m["size"]) == z.read(name)


def test_zip64_records_are_read_where_plain_ones_are_full(monkeypatch, tmp_path):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "y.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a", b"1" * 99)
        z.writestr("b", b"2" * 99)
    raw = path.read_bytes()
    assert warc.END64 in raw and warc.LOCATOR64 in raw
    with warc.source(f"file://{path}") as file:
        assert warc.directory(file)[2] == 2 and sorted(warc.members(file)) == ["a", "b"]


def test_a_comment_may_look_like_an_end(tmp_path):
    path = tmp_path / "c.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.comment = b"PK\x05\x06 is not the end" * 3
        z.writestr("a", b"1")
    with warc.source(f"file://{path}") as file:
        assert list(warc.members(file)) == ["a"]


def test_what_is_no_package_fails_with_a_reason(tmp_path):
    for raw, what in ((b"", "no end"), (b"x" * 100_000, "no end"), (b"PK\x05\x06" + b"\x00" * 6 + b"\x01\x00" + b"\x09\x00\x00\x00" + b"\x00" * 6, "no entry")):
        path = tmp_path / "z.zip"
        path.write_bytes(raw)
        with warc.source(f"file://{path}") as file, pytest.raises(ValueError, match=what):
            warc.members(file)


def test_a_changed_payload_is_not_intact():
    raw = warc.record("1", "u", b"body" * 50, hashlib.sha256(b"body" * 50).hexdigest(), None, None, "1970-01-01T00:00:00Z")
    assert warc.parsed(raw)[-1] and not warc.parsed(raw.replace(b"bodybody", b"bodyBody", 1))[-1]
    assert pafs.FileSystem.from_uri("file:///tmp")[1] == "/tmp" and io.BytesIO(warc.gzipped(raw, 9)).read(2) == b"\x1f\x8b"


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, []).limit(0)).collect() == []
