"""What several operators share: scratch tables, byte views of Arrow columns, vectorised hashing.

The operators treat a document row as (doc_id, text). Conventions that hold unless an operator says otherwise:
a null text counts as the empty text, a null doc_id is an id of its own that sorts before all others, repeated rows
each keep their own result row, and columns other than the ones an operator names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise  # noqa: F401  used through this module

#: Stands for a null doc_id inside packed arrays; sorts first.
NULL_ID = -(2**63)
U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


#: Most bytes of an Arrow batch between the JVM and Python, unless the session asks for something else.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Spark's default of 64 MB a batch, copied on both sides by every task, to 8 MB; another setting is left alone."""
    if spark.conf.get(BATCH, "67108864b") == "67108864b":
        spark.conf.set(BATCH, str(BATCH_BYTES))


def narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, raw): raw is the whole text in UTF-8, a null text the empty one."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def total_bytes(docs: DataFrame) -> int:
    """Exact UTF-8 bytes of all texts: what bucket counts are derived from."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def raw_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in one array, and the n + 1 offsets of its rows."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes come to `most` at the most; a longer row is a block of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64, elementwise; x is uint64 and is overwritten."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, at least; kept for the next block unless it is very long."""
    if n <= len(_POWERS.get(base, ())):
        return _POWERS[base]
    out = np.full(max(n, 1 << 16), base, U64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= 3 << 20:
        _POWERS[base] = out
    return out


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def prefix_sums(values: np.ndarray, power: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * power[: len(values)], out=out[1:])
    return out


#: Random odd multipliers and a random value for each byte, from a fixed seed.
_RNG = np.random.default_rng(20240229)
BASES = [int(x) | 1 for x in _RNG.integers(2**62, 2**63, 4)]
BYTE_VALUES = _RNG.integers(1, 2**63, (2, 256)).astype(U64)
#: Bytes that separate words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of non-space bytes that stays within a row, and the row of each."""
    gap = np.ones(len(body) + 1, bool)
    gap[:-1] = IS_SPACE[body]
    before = np.ones(len(body) + 1, bool)
    before[1:] = gap[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(body))]
    before[inner] = True
    starts = np.flatnonzero(before[:-1] & ~gap[:-1])
    after = gap.copy()
    after[inner] = True
    ends = np.flatnonzero(after[1:] & ~gap[:-1]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: Words up to this many bytes are hashed together, eight bytes a step; longer ones by XXH3, one by one.
SHORT_WORD = 64


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0, short: int = SHORT_WORD) -> np.ndarray:
    """A 64-bit hash of each span's bytes; lanes are independent. Every step mixes, so no two words can be built to
    collide at all positions or lengths, as they can for sums of powers modulo 2 ** 64."""
    length = (ends - starts).astype(np.int64)
    h = mix(length.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(BASES[lane]))
    if not len(h):
        return h
    padded = np.zeros(len(body) + 8, np.uint8)
    padded[: len(body)] = body
    eight = np.ndarray(len(body) + 1, np.dtype("<u8"), padded, strides=(1,))  # the eight bytes from each place on
    left = np.minimum(length, short)
    at, todo = starts, np.arange(len(h))
    while len(todo):
        part = eight[at]
        last = np.flatnonzero(left < 8)
        part[last] &= (U64(1) << (left[last] * 8).astype(U64)) - U64(1)
        h[todo] = mix(h[todo] ^ (part + U64(BASES[lane + 2])))
        go = left > 8
        todo, at, left = todo[go], at[go] + 8, left[go] - 8
    for i in np.flatnonzero(length > short).tolist():
        h[i] = xxhash.xxh3_64_intdigest(body[starts[i] : ends[i]].tobytes(), BASES[lane])
    return h


def run_hashes(values: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each `width` consecutive hashes (len(values) - width + 1 of them), by doubling: a run of 2k is
    mixed from two runs of k, and the runs of width's binary digits are chained."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    run, size, at, out = values, 1, 0, None
    while True:
        if width & size:
            out = run[at : at + n].copy() if out is None else joined(out, run[at : at + n], lane)
            at += size
        if size * 2 > width:
            return mix(out + U64(BASES[lane + 2]))
        run = joined(run[: len(run) - size], run[size:], lane)
        size *= 2


def joined(left: np.ndarray, right: np.ndarray, lane: int) -> np.ndarray:
    """A hash of two hashes, in this order."""
    x = (left ^ U64(BASES[lane])) * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x += right
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


def byte_runs(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each `width` consecutive values, by sums of powers; for runs that are short, such as 20 bytes,
    and where a collision costs time only."""
    n = len(values)
    if n < width:
        return np.zeros(0, U64)
    prefix = prefix_sums(values, powers(BASES[2], n))
    run = prefix[width:] - prefix[:-width]
    run *= powers(inverse(BASES[2]), n + 1)[: len(run)]
    return mix(run)
