"""The archive source and sink against zipfile."""

import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestar.sources import archive, files

NAMES = ["checkout/a/One.plsql", "checkout/b/Two.ENTITY", "checkout/ü/Drei.views", "other/Lost.plsql", "checkout/notes.txt", "checkout/empty.plsql"]


def rows(spark, path, **options):
    found = archive.read_archives(spark, str(path), **options)
    return found, sorted((r.entry, bytes(r.content)) for r in found.collect())


def made(path, methods=(zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA), mode="w", n=40):
    want = []
    with zipfile.ZipFile(path, mode) as z:
        z.comment = b"PK\x05\x06 is no end here"
        z.mkdir("checkout")
        for i in range(n):
            name, body = f"{i}/{NAMES[i % len(NAMES)]}", b"" if i % 7 == 6 else os.urandom(50) + b"line of text\n" * (i * 37)
            z.writestr(name, body, compress_type=methods[i % len(methods)])
            want.append((name, body))
    return sorted(want)


def test_reads_what_zipfile_reads(spark, tmp_path):
    want = made(tmp_path / "x.zip")
    assert rows(spark, tmp_path / "x.zip")[1] == want
    assert rows(spark, f"file://{tmp_path}/x.zip")[1] == want
    found, got = rows(spark, tmp_path / "x.zip", partitionBytes=2000, batchBytes=1000)
    assert got == want and found.rdd.getNumPartitions() > 5
    assert found.select(F.spark_partition_id()).distinct().count() > 5
    assert {r.size for r in found.collect()} == {len(b) for _, b in want}


def test_folder_of_archives_and_empty_ones(spark, tmp_path):
    folder = tmp_path / "all"
    folder.mkdir()
    assert rows(spark, folder)[1] == []
    want = made(folder / "a.zip", n=5) + made(folder / "b.ZIP", n=3)
    zipfile.ZipFile(folder / "c.zip", "w").close()
    (folder / "notes.txt").write_text("no archive")
    assert rows(spark, folder)[1] == sorted(want)
    assert archive.read_archives(spark, str(folder)).select("archive").distinct().count() == 2


def test_offsets_beyond_four_gigabytes(spark, tmp_path):
    path = tmp_path / "far.zip"
    with open(path, "wb") as f:
        f.truncate(5 << 30)  # a hole: the archive's entries lie behind it
    want = made(path, mode="a", n=20)
    assert os.path.getsize(path) > 5 << 30
    found, got = rows(spark, path, partitionBytes=5000)
    assert got == want and found.rdd.getNumPartitions() > 2


def test_bytes_before_an_archive(spark, tmp_path):
    want = made(tmp_path / "plain.zip", n=6)
    (tmp_path / "shifted.zip").write_bytes(b"#!/bin/sh\nexit\n" + (tmp_path / "plain.zip").read_bytes())
    assert rows(spark, tmp_path / "shifted.zip")[1] == want
    n = archive.write_archive(spark.createDataFrame([(f"e{i}", b"x" * i) for i in range(9)], "entry string, content binary"), str(tmp_path / "wide.zip"))
    (tmp_path / "wide_shifted.zip").write_bytes(b"junk" + (tmp_path / "wide.zip").read_bytes())
    assert n == 9 and rows(spark, tmp_path / "wide_shifted.zip")[1] == [(f"e{i}", b"x" * i) for i in range(9)]


def test_damage_is_an_error(spark, tmp_path):
    path = tmp_path / "x.zip"
    made(path, methods=(zipfile.ZIP_STORED,), n=6)
    whole = bytearray(path.read_bytes())
    for change, message in (((whole.find(b"line of text"), b"LINE"), "damaged entry"), ((whole.rfind(b"PK\x01\x02") + 8, struct.pack("<H", 1)), "cannot be unpacked"), ((whole.find(b"PK\x01\x02"), b"XX"), "directory is damaged")):
        at, new = change
        path.write_bytes(whole[:at] + new + whole[at + len(new) :])
        with pytest.raises(Exception, match=message):
            rows(spark, path)
    path.write_bytes(b"no archive at all")
    with pytest.raises(Exception, match="no ZIP archive"):
        rows(spark, path)


def test_sources_only_and_unsafe_names(spark, tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name in NAMES:
            z.writestr(name, name)
    got = sorted((r.relative_path, bytes(r.content).decode()) for r in files.archive_entries(spark, str(path)).collect())
    assert got == [("a/One.plsql", NAMES[0]), ("b/Two.ENTITY", NAMES[1]), ("empty.plsql", NAMES[5]), ("ü/Drei.views", NAMES[2])]
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("checkout/../../Evil.plsql", "x")
    with pytest.raises(Exception, match="unsafe name in the archive"):
        files.archive_entries(spark, str(path)).collect()


def test_written_archives(spark, tmp_path):
    path = str(tmp_path / "w.zip")
    want = [(f"dir{i % 3}/ü{i}.txt", (f"row {i} " * (i % 50)).encode()) for i in range(400)]
    frame = spark.createDataFrame(want, "entry string, content binary").repartition(7)
    assert archive.write_archive(frame, path) == 400
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and sorted((n, z.read(n)) for n in z.namelist()) == sorted(want)
    assert rows(spark, path, partitionBytes=4000)[1] == sorted(want)
    assert os.listdir(tmp_path) == ["w.zip"]
    assert archive.write_archive(frame.limit(0), path) == 0 and rows(spark, path)[1] == []
    assert zipfile.ZipFile(path).namelist() == []
    with pytest.raises(ValueError, match="two entries"):
        archive.write_archive(frame.unionByName(frame.limit(1)), path)
