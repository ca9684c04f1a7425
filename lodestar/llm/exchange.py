"""Question and answer between chunks of documents and shards of keys.

Both exact duplicate searches (substrings, word windows) need to know of a key whether it occurs elsewhere. Documents
are dealt to chunks of bounded bytes. A chunk sends each shard one message with its distinct keys (so a key that stands in
a third of all rows is one entry per chunk, however hot it is); the shard merges the messages and answers each chunk with
a bitmap in the order of its keys. Nothing is collected or broadcast; chunks and shards stay as large as they are when
the input grows, only their numbers grow. The chunk's documents are shuffled once: every step reads the same exchange.

A step is a pure function of a chunk's rows, so a lost task can be run again. The same exchange gives a chunk's rows in
another order each time; steps that tell each other places put them in order first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, NULL_ID, U64, narrow, shuffle_partitions, total_bytes

MESSAGE = "shard int, chunk int, step int, payload binary"
NAMES = ["shard", "chunk", "step", "payload"]
#: Step of a message that a chunk sends to itself: it passes through a shard as it is and saves the chunk a second run.
OWN = 0
BLOCK_BYTES = 1 << 20


def chunked(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """(doc_id, d, raw, chunk) dealt by chunk, and how many chunks' worth of text there is. A partition for each chunk,
    so that a task reads as much of a large input as of a small one."""
    total = total_bytes(docs)
    n = max(1, -(-total // chunk_bytes))
    rows = narrow(docs).select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID + 1)).alias("d"), "raw")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "raw"), F.lit(n)).cast("int"))
    return rows.repartition(max(shuffle_partitions(docs.sparkSession), n), "chunk"), n


def ordered(table: pa.Table) -> pa.Table:
    """A chunk's rows in an order that does not depend on their arrival."""
    return table.take(pc.sort_indices(table, sort_keys=[("d", "ascending"), ("raw", "ascending")]))


def messages(chunk: int, step: int, shard: np.ndarray, shards: int, pack: Callable[[np.ndarray], bytes]) -> pa.Table:
    """One message per shard; pack(i) packs the keys with index i. Keys keep their order within a shard."""
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    rows = [(s, pack(order[a:b])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
    n = len(rows)
    return pa.table([pa.array([s for s, _ in rows], pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array([step] * n, pa.int32()), pa.array([p for _, p in rows], pa.binary())], NAMES)


def answered(table: pa.Table, step: int, shard: np.ndarray, shards: int) -> np.ndarray:
    """The answers' bits for keys whose shards are given, in the keys' order."""
    out = np.zeros(len(shard), bool)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for s, k, bits in zip(table["shard"].to_pylist(), table["step"].to_pylist(), table["payload"].to_pylist(), strict=True):
        if k == step:
            at = order[cut[s] : cut[s + 1]]
            out[at] = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(at)]
    return out


def asked(rows: DataFrame, step: Callable[[int, pa.Table, pa.Table | None], pa.Table], answers: DataFrame | None = None) -> DataFrame:
    if answers is None:
        return rows.groupBy("chunk").applyInArrow(lambda key, t: step(key[0].as_py(), t, None), MESSAGE)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda key, t, a: step(key[0].as_py(), t, a), MESSAGE)


def packed_bits(answer: np.ndarray) -> bytes:
    return np.packbits(answer).tobytes()


def merged(questions: DataFrame, shard: Callable[[list[bytes]], list], shards: int, pack: Callable[..., bytes] = packed_bits) -> DataFrame:
    """Each shard's messages to shard(payloads), which returns an answer per payload, a bit array unless pack() takes
    something else. A chunk's messages to itself come through as they are."""

    def f(key: tuple, t: pa.Table) -> pa.Table:
        own = pc.equal(t["step"], OWN)
        through, t = t.filter(own), t.filter(pc.invert(own))
        if not t.num_rows:
            return through
        answers = [pack(b) for b in shard([x.as_py() for x in t["payload"]])]
        return pa.concat_tables([pa.table([t["shard"], t["chunk"], t["step"], pa.array(answers, pa.binary())], NAMES), through])

    dealt = questions.repartition(max(shuffle_partitions(questions.sparkSession), shards), "shard")
    return dealt.groupBy("shard").applyInArrow(f, MESSAGE)


def own_message(chunk: int, shards: int, payload: bytes) -> pa.Table:
    return pa.table([pa.array([chunk % shards], pa.int32()), pa.array([chunk], pa.int32()), pa.array([OWN], pa.int32()), pa.array([payload], pa.binary())], NAMES)


def pack_arrays(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of whole numbers, compressed, each in the narrowest type that holds it."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if t is np.int64 or not len(a) or (a.min() >= 0 and a.max() <= np.iinfo(t).max))
        out += [np.array([np.dtype(kind).itemsize, len(a)], np.int64).tobytes(), a.astype(kind).tobytes()]
    plain = b"".join(out)
    return np.int64(len(plain)).tobytes() + pa.Codec("zstd", compression_level=level).compress(plain, asbytes=True)


def unpack_arrays(payload: bytes, wide: bool = True) -> list[np.ndarray]:
    """The arrays, as 64-bit integers or in the types they were packed in."""
    plain = pa.decompress(payload[8:], int(np.frombuffer(payload[:8], np.int64)[0]), codec="zstd", asbytes=True)
    out, at = [], 8
    for _ in range(int(np.frombuffer(plain[:8], np.int64)[0])):
        width, n = np.frombuffer(plain[at : at + 16], np.int64).tolist()
        a = np.frombuffer(plain[at + 16 : at + 16 + width * n], {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[width])
        out.append(a.astype(np.int64) if wide else a)
        at += 16 + width * n
    return out


class CountMin:
    """A count-min sketch cut into shards: a key's shard and its cell in each of the shard's rows. Partitions send their
    rows in sparse form, the cells that they count something in, in ascending order; a shard adds the rows up. Counts
    stop at 2, which is all that is asked."""

    DEPTH = 2

    def __init__(self, shards: int, cells: int) -> None:
        self.shards = shards
        self.bits = max(10, int(np.ceil(np.log2(max(cells, 2)))))

    def places(self, keys: np.ndarray, row: int) -> np.ndarray:
        """Shard and cell of each key in a row, as one number."""
        shard = (keys >> U64(32)) % U64(self.shards)
        return (shard << U64(self.bits)) | ((keys * U64(BASES[row])) >> U64(64 - self.bits))

    def sparse_rows(self, keys: np.ndarray, inverse: bool = False) -> list[tuple]:
        """Per row of this partition's own sketch: the cells counted, their counts, and with inverse each key's cell."""
        return [np.unique(self.places(keys, r), return_counts=True, return_inverse=inverse) for r in range(self.DEPTH)]

    def _cuts(self, cells: np.ndarray) -> np.ndarray:
        return np.searchsorted(cells, np.arange(self.shards + 1).astype(U64) << U64(self.bits))

    def messages(self, chunk: int, step: int, keys: np.ndarray) -> pa.Table:
        rows = [(cells, counts, self._cuts(cells)) for cells, counts in self.sparse_rows(keys)]
        low, out = U64((1 << self.bits) - 1), []
        for s in range(self.shards):
            if rows[0][2][s] < rows[0][2][s + 1]:
                parts = []
                for cells, counts, cut in rows:
                    own = (cells[cut[s] : cut[s + 1]] & low).astype(np.int64)
                    parts += [np.diff(own, prepend=0), np.packbits(counts[cut[s] : cut[s + 1]] > 1)]
                out.append((s, pack_arrays(*parts)))
        n = len(out)
        return pa.table([pa.array([s for s, _ in out], pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array([step] * n, pa.int32()), pa.array([p for _, p in out], pa.binary())], NAMES)

    def add_up(self, payloads: list[bytes]) -> list[np.ndarray]:
        """The sum of all partitions' rows; per payload and row, which of its cells hold two or more."""
        total = np.zeros((self.DEPTH, 1 << self.bits), np.uint8)
        every = []
        for p in payloads:
            parts = unpack_arrays(p)
            cells = [np.cumsum(d) for d in parts[::2]]
            for row, at, twice in zip(total, cells, parts[1::2], strict=True):
                row[at] = np.minimum(row[at] + 1 + np.unpackbits(twice.astype(np.uint8))[: len(at)], 2)
            every.append(cells)
        return [np.concatenate([row[at] >= 2 for row, at in zip(total, cells, strict=True)]) for cells in every]

    def estimated_repeated(self, table: pa.Table, step: int, keys: np.ndarray) -> np.ndarray:
        """Which keys the merged sketch estimates at two or more: those whose cell does so in every row."""
        rows = [(*x, self._cuts(x[0])) for x in self.sparse_rows(keys, inverse=True)]
        hot = [np.zeros(len(x[0]), bool) for x in rows]
        for s, k, bits in zip(table["shard"].to_pylist(), table["step"].to_pylist(), table["payload"].to_pylist(), strict=True):
            if k == step:
                flags, at = np.unpackbits(np.frombuffer(bits, np.uint8)), 0
                for of, (*_, cut) in zip(hot, rows, strict=True):
                    n = cut[s + 1] - cut[s]
                    of[cut[s] : cut[s + 1]] = flags[at : at + n]
                    at += n
        return np.logical_and.reduce([of[inv] for of, (_, inv, _, _) in zip(hot, rows, strict=True)])


def pack_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A partition's distinct keys: per key the low 39 bits and whether the partition has it twice or more."""
    v = ((keys & U64((1 << 39) - 1)) << U64(1)) | (counts > 1).astype(U64)
    return np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


#: Bytes of a key in a list.
KEY_BYTES = 5


def unpacked_keys(payloads: list[bytes]) -> list[np.ndarray]:
    """The lists of pack_keys() as numbers, whose lowest bit says twice or more."""
    parts = []
    for p in payloads:
        wide = np.zeros((len(p) // KEY_BYTES, 8), np.uint8)
        wide[:, :KEY_BYTES] = np.frombuffer(p, np.uint8).reshape(-1, KEY_BYTES)
        parts.append(wide.view(U64)[:, 0])
    return parts


def summed_keys(payloads: list[bytes], values: np.ndarray) -> list[np.ndarray]:
    """Per key of each list the sum of the values that all lists have for it. values: of all keys, list after list."""
    parts = unpacked_keys(payloads)
    _, inv = np.unique(np.concatenate(parts) >> U64(1), return_inverse=True)
    total = np.bincount(inv, values)
    return np.split(total[inv], np.cumsum([len(p) for p in parts])[:-1])


def repeated_keys(payloads: list[bytes]) -> list[np.ndarray]:
    """Which keys of each list two lists have, or one counts twice."""
    parts = unpacked_keys(payloads)
    every = np.concatenate(parts)
    return [x >= 2 for x in summed_keys(payloads, 1 + (every & U64(1)).astype(np.int64))]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the bits that pack_keys leaves out, so that they add to the keys' 39."""
    return ((keys >> U64(39)) % U64(shards)).astype(np.int64)


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each `width` consecutive values, the leftmost among equals (by their upper 40 bits)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if n > (step := 1 << 22):  # a place has 24 bits
        return np.concatenate([leftmost_least(values[i : min(i + step, n) + width - 1], width) + i for i in range(0, n, step)])
    low = U64((1 << 24) - 1)
    least = (values & ~low) | np.arange(len(values), dtype=U64)
    size = 1
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[width - size : width - size + n])
    return (least & low).astype(np.int64)
