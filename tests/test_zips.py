"""Zips put together by many tasks are what zipfile reads."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.sources import archives, zips

SCHEMA = "archive string, path string, bytes binary"


def opened(pieces):
    return {r.archive: zipfile.ZipFile(io.BytesIO(bytes(r.data))) for r in zips.joined(pieces).collect()}


@pytest.mark.parametrize("large", [zips.LARGE, 1000, 0])
def test_one_zip_an_archive(spark, large):
    made = [("hot" if i % 4 else "b", f"d{i % 3}/p{i:03d}-é.txt", bytes([i % 256]) * i) for i in range(300)]
    pieces = zips.assembled(spark.createDataFrame(made, SCHEMA).repartition(5), large=large)
    assert pieces.filter("archive = 'hot'").select(F.shiftright("at", 33)).distinct().count() > 3  # ranges, directory and end
    got = opened(pieces)
    assert got.keys() == {"hot", "b"}
    for archive, z in got.items():
        assert z.testzip() is None
        want = sorted((p.split("/"), b) for a, p, b in made if a == archive)
        assert [(i.filename.split("/"), z.read(i)) for i in z.infolist()] == want
        assert {(i.compress_type, i.date_time, i.external_attr >> 16) for i in z.infolist()} == {(0, (1980, 1, 1, 0, 0, 0), 0o100644)}
    listed = {(r.archive, r.path): (r.crc, r.size, r.offset) for r in zips.directory(pieces).collect()}
    assert listed == {(a, i.filename): (i.CRC, i.file_size, i.header_offset) for a, z in got.items() for i in z.infolist()}
    again = zips.numbered(zips.contents(pieces)).collect()
    assert {(r.archive, r.idx): (r.path, bytes(r.bytes)) for r in again} == {(a, n): (i.filename, z.read(i)) for a, z in got.items() for n, i in enumerate(z.infolist())}


def test_folders_stand_before_what_they_hold(spark):
    made = [("a", "d/x/1", b"1"), ("a", "d.txt", b"2"), ("a", "d/z", b"3"), ("a", "b", None), ("a", "e/", b""), ("n", None, b""), (None, "p", b"")]
    z = opened(zips.assembled(zips.with_folders(spark.createDataFrame(made, SCHEMA))))
    assert list(z) == ["a"]
    assert z["a"].namelist() == ["b", "d/", "d/x/", "d/x/1", "d/z", "d.txt", "e/"]
    assert [z["a"].read(n) for n in z["a"].namelist()] == [b"", b"", b"", b"1", b"3", b"2", b""]


def test_repacking_keeps_an_archives_order(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as own:
        own.writestr("z\\y", b"1" * 5000)
        own.mkdir("f")
        own.writestr("a", b"2")
        own.writestr("./m/k", b"")
    table = spark.createDataFrame([("q", out.getvalue()), ("empty", None)], "archive string, data binary")
    z = opened(archives.acted("repack", table))
    assert list(z) == ["q"]
    assert [(i.filename, i.compress_type) for i in z["q"].infolist()] == [("z/y", 0), ("a", 0), ("m/k", 0)]


def test_odd_members(spark):
    empty = zips.assembled(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and zips.joined(empty).collect() == []
    twice = opened(zips.assembled(spark.createDataFrame([("a", "p", b"x")] * 3, SCHEMA)))["a"]
    assert twice.namelist() == ["p"] * 3
    many = zips.assembled(spark.range(70000).select(F.lit("a").alias("archive"), F.col("id").cast("string").alias("path"), F.lit(b"").alias("bytes")))
    assert len(opened(many)["a"].namelist()) == 70000
    with pytest.raises(Exception, match="name too long"):
        zips.assembled(spark.createDataFrame([("a", "p" * 65536, b"x")], SCHEMA)).collect()
    with pytest.raises(Exception, match="stays in pieces"):
        zips.joined(many, most_bytes=1000).collect()
