"""ZIP archives as a splittable source, and as a sink that tasks write side by side.

Reading: planning walks an archive's central directory once, in pieces, and cuts it where the entries' compressed bytes
reach a partition's share. A partition is a range of the directory; its task reads that range, then its entries' byte
ranges. Neither the driver nor a task ever holds an archive or a whole directory, and archives and offsets beyond 4 GB
(ZIP64) are read like any other. An entry is one row, so one task's.

Writing: tasks write segments of entries, the driver adds up their lengths, and tasks copy the segments to their places."""

from __future__ import annotations

import bz2
import lzma
import os
import re
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Suffixes of source files, the folder of an archive that holds them.
SUFFIXES = (".entity", ".plsql", ".views", ".storage", ".fragment", ".projection", ".client")
ARCHIVE_ROOT = "checkout/"

#: Fixed values of the ZIP format: signatures and the layout of its records.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
CENTRAL_FIELDS, LOCAL_FIELDS, END_FIELDS = "<4s6H3I5H2I", "<4s5H3I2H", "<4s4H2IH"
CENTRAL_SIZE, LOCAL_SIZE, END_SIZE = map(struct.calcsize, (CENTRAL_FIELDS, LOCAL_FIELDS, END_FIELDS))
STORED, DEFLATED, BZIP2, LZMA = 0, 8, 12, 14
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF

SCHEMA = "archive string, entry string, size long, content binary"
#: Compressed bytes of a partition, and bytes of a batch of rows, unless options say otherwise.
PARTITION_BYTES, BATCH_BYTES = 32 << 20, 8 << 20


def entry_path(name: str) -> str | None:
    """Where an archive's entry belongs below a version's source folder: None for entries that are no source files. A
    name that would leave the folder (absolute, with a drive or backslashes, or with ..) is an error."""
    if name.endswith("/") or not name.startswith(ARCHIVE_ROOT) and not re.match(r"[/\\]|[A-Za-z]:|.*\.\.", name):
        return None
    inner = name[len(ARCHIVE_ROOT) :] if name.startswith(ARCHIVE_ROOT) else name
    if os.path.splitext(inner)[1].lower() not in SUFFIXES:
        return None
    if inner.startswith("/") or "\\" in name or re.match("[A-Za-z]:", inner) or any(p in ("..", "", ".") for p in inner.split("/")):
        raise ValueError(f"unsafe name in the archive: {name!r}")
    return inner


@dataclass(frozen=True)
class Entry:
    name: str
    method: int
    encrypted: bool
    crc: int
    packed: int
    size: int
    offset: int


def opened(path: str) -> tuple[pa.NativeFile, int]:
    """A file of any store that Arrow knows, for reading at places, and its size."""
    store, inner = pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (pafs.LocalFileSystem(), path)
    return store.open_input_file(inner), store.get_file_info(inner).size


def archives(path: str) -> list[str]:
    """The archive at path, or those of a folder, in order."""
    uri = re.match(r"[a-z0-9]+:/", path)
    store, inner = pafs.FileSystem.from_uri(path) if uri else (pafs.LocalFileSystem(), path)
    if store.get_file_info(inner).type != pafs.FileType.Directory:
        return [path]
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(store.get_file_info(pafs.FileSelector(inner)), key=lambda f: f.path) if f.is_file and f.extension.lower() == "zip"]


def directory_place(file: pa.NativeFile, size: int) -> tuple[int, int, int]:
    """Where an archive's central directory begins and ends, and how far all its offsets are off: bytes may stand before
    the archive proper."""
    tail_at = max(0, size - END_SIZE - FULL16)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + END_SIZE > len(tail) or at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)  # the comment, which ends the file, may hold the signature
    if at < 0:
        raise ValueError("no ZIP archive")
    _, _, _, _, _, length, begin, _ = struct.unpack_from(END_FIELDS, tail, at)
    end = tail_at + at
    if end >= 20 and (locator := file.read_at(20, end - 20)).startswith(LOCATOR):
        place = struct.unpack_from("<Q", locator, 8)[0]
        record = file.read_at(56, place)
        if not record.startswith(END64):  # bytes before the archive shift it
            place = end - 20 - 56
            record = file.read_at(56, place)
        if not record.startswith(END64):
            raise ValueError("the archive's 64-bit end is damaged")
        length, begin = struct.unpack_from("<2Q", record, 40)
        end = place
    shift = end - length - begin
    if shift < 0:
        raise ValueError("the archive's directory is damaged")
    return end - length, end, shift


def entries(file: pa.NativeFile, begin: int, end: int, shift: int, piece: int = 1 << 20) -> Iterator[tuple[int, int, Entry]]:
    """The entries of a range of the central directory, with where each one's record begins and ends."""
    held, first, at = b"", begin, begin  # held: the directory's bytes from first on
    while at < end:
        left = len(held) - (at - first)
        if left < CENTRAL_SIZE or left < (need := _record_length(held, at - first)):
            more = file.read_at(min(piece, end - at - left), at + left)
            if not more:
                raise ValueError("the archive's directory is damaged")
            held, first = held[at - first :] + more, at
            continue
        yield at, at + need, _entry(held[at - first : at - first + need], shift)
        at += need


def _record_length(held: bytes, at: int) -> int:
    fields = struct.unpack_from(CENTRAL_FIELDS, held, at)
    if fields[0] != CENTRAL:
        raise ValueError("the archive's directory is damaged")
    return CENTRAL_SIZE + sum(fields[10:13])


def _entry(record: bytes, shift: int) -> Entry:
    _, _, _, flags, method, _, _, crc, packed, size, name, extra, _, _, _, _, offset = struct.unpack_from(CENTRAL_FIELDS, record)
    raw = record[CENTRAL_SIZE : CENTRAL_SIZE + name]
    more = record[CENTRAL_SIZE + name : CENTRAL_SIZE + name + extra]
    while len(more) >= 4:
        kind, n = struct.unpack_from("<2H", more)
        if kind == 1:  # 64-bit values of those fields that are full, in this order
            wide = iter(struct.unpack_from(f"<{n // 8}Q", more, 4))
            size, packed, offset = (next(wide, v) if v == FULL32 else v for v in (size, packed, offset))
        more = more[4 + n :]
    return Entry(raw.decode("utf-8" if flags & 0x800 else "cp437"), method, bool(flags & 1), crc, packed, size, offset + shift)


def content(file: pa.NativeFile, e: Entry) -> bytes:
    """An entry's bytes, checked against its length and checksum."""
    head = file.read_at(LOCAL_SIZE, e.offset)
    if len(head) < LOCAL_SIZE or not head.startswith(LOCAL):
        raise ValueError(f"damaged entry in the archive: {e.name!r}")
    if e.encrypted or e.method not in (STORED, DEFLATED, BZIP2, LZMA):
        raise ValueError(f"entry in the archive that cannot be unpacked: {e.name!r}")
    name, extra = struct.unpack_from("<2H", head, 26)
    packed = file.read_at(e.packed, e.offset + LOCAL_SIZE + name + extra)
    try:
        if e.method == DEFLATED:
            plain = zlib.decompress(packed, -15)
        elif e.method == BZIP2:
            plain = bz2.decompress(packed) if packed else b""
        elif e.method == LZMA:
            n, kind, window = struct.unpack_from("<HBI", packed, 2)  # kind: three small numbers in one
            chain = [{"id": lzma.FILTER_LZMA1, "dict_size": window, "lc": kind % 9, "lp": kind // 9 % 5, "pb": kind // 45}]
            plain = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=chain).decompress(packed[4 + n :])
        else:
            plain = packed
    except (zlib.error, OSError, lzma.LZMAError, struct.error) as x:
        raise ValueError(f"damaged entry in the archive: {e.name!r}") from x
    if len(plain) != e.size or zlib.crc32(plain) != e.crc:
        raise ValueError(f"damaged entry in the archive: {e.name!r}")
    return plain


@dataclass
class Slice(InputPartition):
    archive: str
    begin: int
    end: int
    shift: int


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.names = set(options["names"].split("\n")) if "names" in options else None
        self.sources_only = options.get("sourcesonly", "false").lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))

    def _named(self, name: str) -> str | None:
        if self.names is not None and name not in self.names:
            return None
        return entry_path(name) if self.sources_only else None if name.endswith("/") else name

    def partitions(self) -> list[Slice]:
        out = []
        for path in archives(self.path):
            file, size = opened(path)
            with file:
                begin, end, shift = directory_place(file, size)
                first, share = begin, 0
                for _, after, e in entries(file, begin, end, shift):
                    share += e.packed + LOCAL_SIZE if self._named(e.name) is not None else 0
                    if share >= self.partition_bytes:
                        out.append(Slice(path, first, after, shift))
                        first, share = after, 0
                if first < end:
                    out.append(Slice(path, first, end, shift))
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, int, bytes]] = []
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "entry", "size", "content"])
        if partition is None:  # a folder without archives
            return
        file, held = opened(partition.archive)[0], 0
        with file:
            for _, _, e in entries(file, partition.begin, partition.end, partition.shift):
                if (name := self._named(e.name)) is not None:
                    rows.append((partition.archive, name, e.size, content(file, e)))
                    held += e.size
                    if held >= self.batch_bytes:
                        yield batch()
                        rows.clear()
                        held = 0
        if rows:
            yield batch()


class ZipSource(DataSource):
    """spark.read.format("lodestar_zip").load(path): archive, entry, size and content of the entries of the archive at
    path, or of all archives of a folder, folders' own entries left out.

    Options: sourcesOnly (source files below the archive's root only, entry is the path below it, in any case of suffix;
    a name that would leave the root is an error), names (these entries only, a name a line; the bytes of others are not
    read), partitionBytes, batchBytes. An entry that is damaged, encrypted or of
    an unknown method is an error."""

    @classmethod
    def name(cls) -> str:
        return "lodestar_zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(ZipSource)
    return spark.read.format("lodestar_zip").options(**{k: str(v) for k, v in options.items()}).load(path)


# --- writing ------------------------------------------------------------------------------------------------------------------


def _heads(name: str, plain: int, packed: int, crc: int, offset: int) -> tuple[bytes, bytes]:
    """An entry's local header and its record in the directory, whose offset is a 64-bit one."""
    raw, date = name.encode(), 33  # the first of January 1980: equal contents make equal archives
    local = struct.pack(LOCAL_FIELDS, LOCAL, 20, 0x800, DEFLATED, 0, date, crc, packed, plain, len(raw), 0) + raw
    extra = struct.pack("<2HQ", 1, 8, offset)
    central = struct.pack(CENTRAL_FIELDS, CENTRAL, 45, 45, 0x800, DEFLATED, 0, date, crc, packed, plain, len(raw), len(extra), 0, 0, 0, 0, FULL32) + raw + extra
    return local, central


def _packed(plain: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(plain) + z.flush()


def write_archive(rows: DataFrame, path: str) -> int:
    """Write (entry, content binary) as one ZIP archive at path, a folder of which driver and executors share; how many
    entries there are. Every task packs its rows into a segment and a piece of directory beside path; the driver, which
    sees their lengths only, gives each its place, and tasks copy them there. Entries lie in the order of the partitions.
    The archive appears under its name when it is whole; a retried task leaves a segment that nobody names, which goes
    with the folder. Two entries of one name are an error."""
    spark = rows.sparkSession
    if rows.groupBy("entry").count().where("count > 1").limit(1).count():
        raise ValueError("two entries of one name")
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    os.makedirs(parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n, at, length = f"{parts}/{uuid.uuid4().hex}", 0, 0, 0
        with open(f"{place}.entries", "wb") as data, open(f"{place}.names", "wb") as names:
            for batch in batches:
                for name, plain in zip(batch["entry"].to_pylist(), batch["content"].to_pylist(), strict=True):
                    packed = _packed(plain)
                    local, central = _heads(name, len(plain), len(packed), zlib.crc32(plain), at)
                    data.write(local + packed)
                    names.write(central)
                    n, at, length = n + 1, at + len(local) + len(packed), length + len(central)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([place]), *[pa.array([x], pa.int64()) for x in (n, at, length)]], ["place", "n", "bytes", "names"])

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, to, names_to in zip(*[batch[c].to_pylist() for c in ("place", "to", "names_to")], strict=True):
                with open(f"{parts}/whole", "r+b") as out:
                    out.seek(to)
                    with open(f"{place}.entries", "rb") as data:
                        shutil.copyfileobj(data, out, 1 << 20)
                    out.seek(names_to)
                    with open(f"{place}.names", "rb") as names:
                        while head := names.read(CENTRAL_SIZE):
                            fields = struct.unpack(CENTRAL_FIELDS, head)
                            rest = names.read(fields[10] + fields[11])
                            out.write(head + rest[:-8] + struct.pack("<Q", struct.unpack("<Q", rest[-8:])[0] + to))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    try:
        numbered = rows.select("entry", F.col("content").cast("binary").alias("content")).mapInArrow(pack, "place string, n long, bytes long, names long")
        made = sorted(numbered.withColumn("p", F.spark_partition_id()).collect(), key=lambda r: r["p"])  # a row a task
        end, n, length = sum(r["bytes"] for r in made), sum(r["n"] for r in made), sum(r["names"] for r in made)
        places, to, names_to = [], 0, end
        for r in made:
            places.append((r["place"], to, names_to))
            to, names_to = to + r["bytes"], names_to + r["names"]
        with open(f"{parts}/whole", "wb") as out:
            out.seek(end + length)
            out.write(struct.pack("<4sQ2H2I4Q", END64, 44, 45, 45, 0, 0, n, n, length, end))
            out.write(struct.pack("<4sIQI", LOCATOR, 0, end + length, 1))
            out.write(struct.pack(END_FIELDS, END, 0, 0, min(n, FULL16), min(n, FULL16), FULL32, FULL32, 0))
        if places:
            spread = spark.createDataFrame(places, "place string, to long, names_to long").repartition(len(places), "place")
            spread.mapInArrow(copy, "n long").agg(F.sum("n")).collect()
        os.replace(f"{parts}/whole", path)
    finally:
        shutil.rmtree(parts, ignore_errors=True)
    return n
