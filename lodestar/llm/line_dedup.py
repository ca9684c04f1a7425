"""Line dedup over sorted line hashes.

1. Each document is cut at newlines; a line becomes the 128-bit hash of its key, with the document and its position.
2. The rows are range-partitioned by (hash, document) and sorted by (hash, document, position). Because the document is
   part of the range key, a line that stands in a third of all documents spreads over many partitions.
3. Each partition is streamed once. It holds the lines of the current key only until enough documents have been seen;
   from then on lines go straight out. What it knows of its first and last key may be incomplete, so it also emits how
   many documents it saw of those (two rows a partition) and holds their lines, fewer than `min_docs` documents, as
   pending; the sums over partitions decide on them.
4. The dropped positions of a document become a compressed keep bitmap. Only these bitmaps, not texts, come out of the
   dedup; they are then applied to the texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, blocks, bounded_batches, fresh, ids_of, materialise, narrow, raw_parts, shuffle_partitions

STRIPPED = b" \t\n\x0b\x0c\r"
BLOCK_BYTES = 1 << 20
LINES = "h1 long, h2 long, d long, rk long, pos int"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case (bytes.lower() touches ASCII letters only)."""
    return line.strip(STRIPPED).lower()


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end in blocks(raw_parts(batch["raw"])[1], BLOCK_BYTES):
            part = batch.slice(at, end - at)
            digests, counts, pos = [], [], []
            for raw in part["raw"].to_pylist():
                kept = [(i, k) for i, x in enumerate(raw.split(b"\n")) if (k := line_key(x))]
                digests += [xxhash.xxh3_128_digest(k) for _, k in kept]
                pos += [i for i, _ in kept]
                counts.append(len(kept))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [h[:, 0].copy(), h[:, 1].copy(), np.repeat(ids_of(part["d"]), counts), np.repeat(part["rk"].to_numpy(), counts), np.array(pos, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h1", "h2", "d", "rk", "pos"])


def _streamer(min_docs: int):
    names = ["kind", "h1", "h2", "d", "rk", "pos", "n"]

    def rows(kind: int, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), *[pa.array(x[:, i]) for i in range(4)], pa.array(x[:, 4].astype(np.int32)), pa.array(np.zeros(len(x), np.int64))], names)

    def total(key: np.ndarray, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([key[0]]), pa.array([key[1]]), pa.array([0]), pa.array([0]), pa.array([0], pa.int32()), pa.array([n])], names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), np.int64)  # lines of the last key so far, unless they are known to go
        before, last_doc, first = 0, None, True  # documents of that key seen in lines that are no longer held
        for batch in batches:
            x = np.column_stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2", "d", "rk", "pos")])
            if not len(x):
                continue
            x = np.concatenate([held, x]) if len(held) else x
            new_key = np.ones(len(x), bool)
            new_key[1:] = (x[1:, :2] != x[:-1, :2]).any(1)
            if before:
                new_key[0] = (x[0, :2] != key).any()
            new_doc = new_key.copy()
            new_doc[1:] |= x[1:, 2] != x[:-1, 2]
            if before and not new_key[0]:
                new_doc[0] = x[0, 2] != last_doc
            if before and new_key[0]:  # the key whose lines had all gone out has ended
                if first:
                    yield total(key, before)
                first, before = False, 0
            starts = np.flatnonzero(new_key)
            starts = starts if len(starts) and starts[0] == 0 else np.concatenate([[0], starts])
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            docs[0] += before
            sizes = np.diff(np.append(starts, len(x)))
            go = np.repeat(docs >= min_docs, sizes)
            closed = np.ones(len(x), bool)
            closed[starts[-1] :] = False
            if len(starts) > 1 and first:
                yield total(x[0, :2], int(docs[0]))
                if docs[0] < min_docs:
                    yield rows(1, x[: starts[1]])
                first = False
            elif first:
                closed[:] = False
            if (out := x[go]).size:
                yield rows(0, out)
            if docs[-1] >= min_docs:
                before, last_doc, key, held = int(docs[-1]), x[-1, 2], x[-1, :2], x[:0]
            else:
                before, held = 0, x[starts[-1] :]
        if len(held):
            n = int(np.count_nonzero(np.diff(held[:, 2])) + 1)
            yield total(held[0, :2], n)
            yield rows(1, held)
        elif before:
            yield total(key, before)

    return stream


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for positions in batch["positions"]:
            at = positions.values.to_numpy()
            keep = np.ones((int(at.max()) // 8 + 1) * 8, np.uint8)
            keep[at] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch["d"], batch["rk"], pa.array(maps, pa.binary())], ["d", "rk", "keep"])


def _keyed(docs: DataFrame) -> DataFrame:
    return narrow(docs).select("doc_id", "raw", F.coalesce("doc_id", F.lit(NULL_ID + 1)).alias("d"), F.xxhash64("raw").alias("rk"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(d, rk, keep) of each document that loses lines. d is the doc_id (a null one: the least id), rk tells rows with
    one doc_id and different texts apart, keep is a zlib-compressed bitmap of the lines that stay; lines past its end stay.

    A line goes if its key, not empty, stands in at least min_docs documents. A document is a doc_id: rows that share
    one (repeated rows, null ids) count once."""
    n = shuffle_partitions(docs.sparkSession)
    lines = materialise(_keyed(docs).select("d", "rk", "raw").mapInArrow(_lines, LINES), "lines")
    dealt = lines.repartitionByRange(n, "h1", "h2", "d").sortWithinPartitions("h1", "h2", "d", "pos")
    streamed = materialise(dealt.mapInArrow(_streamer(min_docs), "kind int, " + LINES + ", n long"), "line-runs")
    common = streamed.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    late = streamed.where("kind = 1").join(common.select("h1", "h2"), ["h1", "h2"], "left_semi")
    dropped = streamed.where("kind = 0").select("d", "rk", "pos").unionByName(late.select("d", "rk", "pos"))
    maps = dropped.groupBy("d", "rk").agg(F.collect_set("pos").alias("positions")).mapInArrow(_bitmaps, "d long, rk long, keep binary")
    return materialise(maps, "bitmaps")  # else the tasks that read texts would also make these


def _kept_lines(raw: bytes, keep: bytes | None) -> tuple[list[bytes], int]:
    lines = raw.split(b"\n")
    if keep is None:
        return lines, 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)]
    gone = set(np.flatnonzero(bits == 0).tolist())
    return [x for i, x in enumerate(lines) if i not in gone], len(gone)


def _apply(digest: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in blocks(raw_parts(batch["raw"])[1], BLOCK_BYTES):
                part = batch.slice(at, end - at)
                out, n_lines, n_dropped = [], [], []
                for raw, keep in zip(part["raw"].to_pylist(), part["keep"].to_pylist(), strict=True):
                    kept, gone = _kept_lines(raw, keep)
                    n_lines.append(len(kept) + gone)
                    n_dropped.append(gone)
                    text = b"\n".join(kept)
                    out.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return f


def drop_common_lines(docs: DataFrame, min_docs: int = 10, digest: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the text that is left, or with digest its SHA-256 in hex), a row per row.

    A null or empty text is one empty line; empty keys never go. Very long texts are handled whole, a row at a time.
    An empty table gives an empty result; other columns of docs, whatever their names, are not looked at."""
    maps = keep_bitmaps(docs, min_docs)
    joined = _keyed(docs).join(maps.hint("merge"), ["d", "rk"], "left").select("doc_id", "raw", "keep")
    return joined.mapInArrow(_apply(digest), "doc_id long, n_lines long, n_dropped long, kept string")


def without_common_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """docs, all columns, with the common lines taken out of `text`; n_chars, where there is one, follows. A null text
    stays null; a text all of whose lines go becomes empty."""
    bounded_batches(docs.sparkSession)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own, d, rk, md, mrk, keep = fresh(docs, "_raw", "_d", "_rk", "_md", "_mrk", "_keep")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], raw.alias(own), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID + 1)).alias(d), F.xxhash64(raw).alias(rk))
    maps = keep_bitmaps(docs, min_docs).toDF(md, mrk, keep)
    joined = rows.join(maps.hint("merge"), (F.col(d) == F.col(md)) & (F.col(rk) == F.col(mrk)), "left").drop(d, rk, md, mrk)
    at = docs.columns.index("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            for a, b in blocks(raw_parts(batch.column(n - 2))[1], BLOCK_BYTES):
                part = batch.slice(a, b - a)
                given = part.column(at).is_valid().to_pylist()
                texts = [b"\n".join(_kept_lines(raw, keep)[0]).decode() if ok else None for ok, raw, keep in zip(given, part.column(n - 2).to_pylist(), part.column(n - 1).to_pylist(), strict=True)]
                columns = part.columns[: n - 2]
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names[: n - 2])

    out = joined.mapInArrow(f, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
