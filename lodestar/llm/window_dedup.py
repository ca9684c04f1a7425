"""Exact removal of repeated word windows, behind a count-min prefilter.

Pass 1: every partition of documents (chunk) counts its windows (`width` words, each window's 64-bit hash) in a count-min
sketch of its own and sends the sketch's rows, in sparse form, to the shards that hold the merged sketch; a shard adds
the rows up and answers which of a chunk's cells hold two or more. Estimates are never too low, so no repeated window is
lost. Pass 2: only windows whose every cell is estimated repeated are grouped exactly, by a 128-bit hash of their word
sequence; a window that occurs once after all is left alone. The sketch is sharded rather than broadcast: its size grows
with the input, a shard's does not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, blocks, raw_parts, run_hashes, word_hashes, word_spans
from .exchange import BLOCK_BYTES, OWN, CountMin, answered, asked, chunked, merged, messages, ordered, own_message, pack_arrays, unpack_arrays


def _bodies(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of bounded bytes, with their bytes and offsets."""
    if not table.num_rows:
        return
    body, offsets = raw_parts(table["raw"].combine_chunks() if table["raw"].num_chunks != 1 else table["raw"].chunk(0))
    for i, j in blocks(offsets, BLOCK_BYTES):
        yield i, j, body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _windows(row: np.ndarray, width: int) -> np.ndarray:
    """First word of each window that stays within a document."""
    n = len(row) - width + 1
    return np.flatnonzero(row[width - 1 :] == row[:n]) if n > 0 else np.zeros(0, np.int64)


def _pairs_unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of a two-column array in sorted order, the place of each row among them, and their counts."""
    order = np.lexsort((h[:, 1], h[:, 0]))
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(1)
    rank = np.cumsum(new) - 1
    inv = np.empty(len(s), np.int64)
    inv[order] = rank
    return s[new], inv, np.bincount(rank, minlength=int(new.sum()))


def _exactly_repeated(payloads: list[bytes]) -> list[np.ndarray]:
    """Group the 128-bit hashes of all messages; a key repeats if two messages have it or one counts it twice."""
    parts = [np.frombuffer(p, U64).reshape(-1, 2) for p in payloads]
    twice = [p[:, 1] & U64(1) for p in parts]
    every = np.concatenate(parts) if parts else np.zeros((0, 2), U64)
    every[:, 1] |= U64(1)
    _, inv, _ = _pairs_unique(every)
    total = np.bincount(inv, 1 + np.concatenate(twice).astype(np.int64))
    hit = total[inv] >= 2
    return np.split(hit, np.cumsum([len(p) for p in parts])[:-1])


class Steps:
    def __init__(self, width: int, shards: int, cells: int) -> None:
        self.width, self.shards, self.count_min = width, shards, CountMin(shards, cells)

    def sketch(self, chunk: int, table: pa.Table, _: pa.Table | None) -> pa.Table:
        keys = [np.zeros(0, U64)]
        for _, _, body, offsets in _bodies(table):
            starts, ends, row = word_spans(body, offsets)
            keys.append(run_hashes(word_hashes(body, starts, ends), self.width)[_windows(row, self.width)])
        return self.count_min.messages(chunk, 1, np.concatenate(keys))

    def exact(self, chunk: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        """The 128-bit hashes of the suspected windows; for the chunk itself, where each of them starts and which it is."""
        table = ordered(table)
        keys, first, sizes, base = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [], 0
        for _, _, body, offsets in _bodies(table):
            starts, ends, row = word_spans(body, offsets)
            w = _windows(row, self.width)
            keys.append(run_hashes(word_hashes(body, starts, ends), self.width)[w])
            first.append(w + base)
            sizes.append(len(row))
            base += len(row)
        key, place = np.concatenate(keys), np.concatenate(first)
        suspect = np.flatnonzero(self.count_min.estimated_repeated(answers, 1, key))
        key, place = key[suspect], place[suspect]
        second, base = [np.zeros(0, U64)], 0
        for (_, _, body, offsets), n in zip(_bodies(table), sizes, strict=True):
            own = place[np.searchsorted(place, base) : np.searchsorted(place, base + n)] - base
            if len(own):
                starts, ends, _ = word_spans(body, offsets)
                second.append(run_hashes(word_hashes(body, starts, ends, 1), self.width, 1)[own])
            base += n
        h, inv, counts = _pairs_unique(np.column_stack([key, np.concatenate(second)]))
        shard = (h[:, 0] % U64(self.shards)).astype(np.int64)
        marked = h.copy()
        marked[:, 1] = (h[:, 1] & ~U64(1)) | (counts > 1).astype(U64)
        # the chunk reads its answers by shard, in the order of sending
        sent = np.argsort(shard, kind="stable")
        at = np.empty(len(sent), np.int64)
        at[sent] = np.arange(len(sent))
        state = pack_arrays(np.diff(place, prepend=0), at[inv], shard[sent])
        return pa.concat_tables([messages(chunk, 2, shard, self.shards, lambda i: marked[i].tobytes()), own_message(chunk, self.shards, state)])

    def result(self, table: pa.Table, answers: pa.Table, text: bool) -> pa.Table:
        table = ordered(table)
        state = [p for k, p in zip(answers["step"].to_pylist(), answers["payload"].to_pylist(), strict=True) if k == OWN]
        steps, which, shard = unpack_arrays(state[0]) if state else [np.zeros(0, np.int64)] * 3
        gone = np.cumsum(steps)[answered(answers, 2, shard, self.shards)[which]]
        base, n_words, n_removed, kept = 0, [], [], []
        for i, j, body, offsets in _bodies(table):
            starts, ends, row = word_spans(body, offsets)
            hit = gone[np.searchsorted(gone, base) : np.searchsorted(gone, base + len(row))] - base
            base += len(row)
            mark = np.zeros(len(row) + 1, np.int32)
            np.add.at(mark, hit, 1)
            np.subtract.at(mark, hit + self.width, 1)
            stay = np.cumsum(mark[:-1]) == 0
            words, left = np.bincount(row, minlength=j - i), np.bincount(row[stay], minlength=j - i)
            # every document with a space after it, so that each word has one byte after it that may become its space
            wide = np.full(len(body) + j - i, 32, np.uint8)
            wide[np.arange(len(body)) + np.repeat(np.arange(j - i), np.diff(offsets))] = body
            edge = np.zeros(len(wide) + 1, np.int8)
            edge[starts[stay] + row[stay]] += 1
            edge[ends[stay] + row[stay] + 1] -= 1
            wide[ends + row] = 32
            taken = np.cumsum(edge[:-1], dtype=np.int8) > 0
            out = wide[taken].tobytes()
            cut = np.concatenate([[0], np.cumsum(np.bincount(row[stay], ends[stay] - starts[stay] + 1, j - i).astype(np.int64))]).tolist()
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                joined = out[a : max(a, b - 1)]
                kept.append(joined.decode("utf-8", "replace") if text else hashlib.sha256(joined).hexdigest())
            n_words += words.tolist()
            n_removed += (words - left).tolist()
        return pa.table([table["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def drop_repeated_windows(docs: DataFrame, width: int = 35, digest: bool = False, chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space; with digest its SHA-256 in hex).

    Words are runs of bytes other than space and 0x09-0x0D. A word goes if a window of `width` consecutive words that
    covers it starts anywhere else too, in its own document or another row (a repeated row counts: its windows occur
    elsewhere). A null or empty text has no words; null ids are kept; an empty table gives an empty result. The sketch
    has a cell for each byte of text in each of its rows, five or six for each window."""
    rows, n = chunked(docs, chunk_bytes)
    shards = max(1, -(-n // 2))
    steps = Steps(width, shards, 2 * chunk_bytes)
    first = merged(asked(rows, steps.sketch), steps.count_min.add_up, shards)
    second = merged(asked(rows, steps.exact, first), _exactly_repeated, shards)
    return rows.groupBy("chunk").cogroup(second.groupBy("chunk")).applyInArrow(lambda t, a: steps.result(t, a, not digest), "doc_id long, n_words long, n_removed long, kept string")
