"""Exact removal of byte strings that also start in a document with a smaller id, with sharded suffix arrays.

1. Every `width`-byte window is represented by the least hash among its 20-byte grams; equal windows have equal
   representatives and neighbours mostly share one. Chunks of documents ask shards, with lists of 39 bits a key, which
   representatives are found in two documents or more; a false match costs time only. They also say how many different
   segments a representative has with them, and shards answer which ones have more than a bound in sum.
2. The windows of a document that share such a representative are one segment (at most 2 * width bytes). Each chunk
   sends its distinct segments, with the least doc_id of each, to the shard of their representative, so that all equal
   windows meet in one shard and a passage copied into a third of all documents is one entry per chunk. A representative
   above the bound (a short phrase with other text around it in every document) is given up: each of its windows is a
   segment of its own, whose hash is its key, so that they spread over all shards and equal ones still meet.
3. A shard concatenates the segments that have rivals under the same representative, builds the suffix array by induced
   sorting and the permuted common prefixes, and groups the windows whose common prefix reaches the width. The least
   doc_id of a group decides; the shard answers a bit per window: whether a smaller doc_id than the chunk's own has it.
4. The chunk marks the bytes its windows cover and cuts them out.

Strings are compared as bytes by the suffix array; a 128-bit hash only merges segments that are equal as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BYTE_VALUES, U64, blocks, byte_runs, mix, raw_parts, word_hashes
from .exchange import BLOCK_BYTES, KEY_BYTES, OWN, answered, asked, chunked, leftmost_least, merged, messages, ordered, own_message, pack_arrays, pack_keys, packed_bits, repeated_keys, shard_of, summed_keys, unpack_arrays
from .suffix import common_prefixes, suffix_array

GRAM = 20


def _pair_ranks(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order by the columns (first one most significant), and the group of each sorted place."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return order, np.cumsum(new) - 1


def _representatives(body: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and representative of each segment of some documents."""
    gram = min(GRAM, width)
    grams = byte_runs(BYTE_VALUES[0][body], gram)
    whole = np.zeros(max(0, len(body) - width + 1), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        whole[a : max(a, b - width + 1)] = True
    windows = np.flatnonzero(whole)
    chosen = leftmost_least(grams, width - gram + 1)[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    return windows[first], np.diff(np.append(first, len(windows))), grams[chosen[first]] if len(first) else np.zeros(0, U64)


def _raw(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return raw_parts(table["raw"].combine_chunks() if table["raw"].num_chunks != 1 else table["raw"].chunk(0))


class Segments:
    """All segments of a chunk: first byte (in the chunk's bytes), number of windows, representative, document. Made in
    blocks, of which only this is kept."""

    def __init__(self, table: pa.Table, width: int) -> None:
        self.body, offsets = _raw(table) if table.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))]
        for i, j in blocks(offsets, BLOCK_BYTES):
            start, count, key = _representatives(self.body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
            parts.append((start + offsets[i], count, key))
        self.start, self.count, self.key = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.doc = table["d"].to_numpy()[np.searchsorted(offsets, self.start, "right") - 1] if len(self.start) else np.zeros(0, np.int64)


def _gather(body: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of several stretches, one after the other."""
    ends = np.cumsum(length)
    return body[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)]


def pack_segments(key: np.ndarray, doc: np.ndarray, count: np.ndarray, body: np.ndarray) -> bytes:
    plain = np.int64(len(key)).tobytes() + key.tobytes() + doc.tobytes() + count.astype(np.uint8).tobytes() + body.tobytes()
    return np.int64(len(plain)).tobytes() + pa.compress(plain, codec="zstd", asbytes=True)


def unpack_segments(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    plain = pa.decompress(payload[8:], int(np.frombuffer(payload[:8], np.int64)[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(plain[:8], np.int64)[0])
    at = np.cumsum([8, 8 * n, 8 * n, n])
    return np.frombuffer(plain[at[0] : at[1]], U64), np.frombuffer(plain[at[1] : at[2]], np.int64), np.frombuffer(plain[at[2] : at[3]], np.uint8).astype(np.int64), np.frombuffer(plain[at[3] :], np.uint8)


def ask_keys(keys: np.ndarray, several: np.ndarray, kinds: np.ndarray) -> bytes:
    """A chunk's distinct representatives, whether two documents have each, and of those that have two kinds of segments
    or more how many."""
    many = np.flatnonzero(kinds > 1)
    return pack_arrays(np.frombuffer(pack_keys(keys, 1 + several), np.uint8), np.diff(many, prepend=0), kinds[many])


def answer_keys(most: int) -> Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]]:
    """Per list which of its keys two lists have or one has twice, and which have more than `most` kinds in sum."""

    def f(payloads: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        parts = [unpack_arrays(p, wide=False) for p in payloads]
        lists = [x[0].tobytes() for x in parts]
        kinds = [np.ones(len(x) // KEY_BYTES, np.int64) for x in lists]
        for k, (_, steps, n) in zip(kinds, parts, strict=True):
            k[np.cumsum(steps, dtype=np.int64)] = n
        hot = summed_keys(lists, np.concatenate(kinds))
        return [(r, h > most) for r, h in zip(repeated_keys(lists), hot, strict=True)]

    return f


def pack_answers(answer: tuple[np.ndarray, np.ndarray]) -> bytes:
    repeated, hot = answer
    return packed_bits(repeated) + np.flatnonzero(hot).astype(np.uint32).tobytes()


def answered_hot(table: pa.Table, step: int, shard: np.ndarray, shards: int) -> np.ndarray:
    """The keys that pack_answers() gives as hot, in the keys' order."""
    out = np.zeros(len(shard), bool)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for s, k, payload in zip(table["shard"].to_pylist(), table["step"].to_pylist(), table["payload"].to_pylist(), strict=True):
        if k == step:
            at = order[cut[s] : cut[s + 1]]
            out[at[np.frombuffer(payload[-(-len(at) // 8) :], np.uint32)]] = True
    return out


def _hashes(body: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> list[np.ndarray]:
    """Two 64-bit hashes of each stretch of body."""
    return [word_hashes(body, start, start + length, lane, 2 * width) for lane in (0, 1)]


def least_documents(key: np.ndarray, doc: np.ndarray, count: np.ndarray, body: np.ndarray, width: int) -> np.ndarray:
    """For every window of every segment, the least doc of the segments that hold an equal window."""
    length = count - 1 + width
    start = np.cumsum(length) - length
    h = _hashes(body, start, length, width)
    order, group = _pair_ranks(key, *h)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(doc[order], first) if len(first) else np.zeros(0, np.int64)
    of = np.empty(len(key), np.int64)
    of[order] = group  # distinct segment of each
    pick = order[first]
    owner = np.repeat(least, count[pick])
    # distinct segments that have a rival under their representative
    k = key[pick]
    rival = np.zeros(len(k), bool)
    rival[1:] |= k[1:] == k[:-1]
    rival[:-1] |= k[1:] == k[:-1]
    if rival.any():
        who = pick[rival]
        size = length[who] + 1
        text = np.ones(int(size.sum()) + 1, np.uint16)
        place = np.cumsum(size) - size
        inside = np.ones(len(text), bool)
        inside[place + size - 1] = inside[-1] = False
        text[inside] = _gather(body, start[who], length[who]).astype(np.uint16) + 2
        text[-1] = 0
        sa = suffix_array(text)
        lcp = common_prefixes(text, sa, width)
        spans = np.repeat(np.arange(len(who)), count[who])
        at = place[spans] + np.arange(len(spans)) - np.repeat(np.cumsum(count[who]) - count[who], count[who])
        window_of = np.full(len(text), -1, np.int64)
        window_of[at] = np.arange(len(at))
        sorted_windows = window_of[sa]
        equal = np.cumsum(lcp < width)[sorted_windows >= 0]
        windows = sorted_windows[sorted_windows >= 0]
        cut = np.flatnonzero(np.diff(equal, prepend=-1))
        docs = least[rival][spans][windows]
        best = np.repeat(np.minimum.reduceat(docs, cut), np.diff(np.append(cut, len(docs))))
        result = np.empty(len(windows), np.int64)
        result[windows] = best
        owner[np.repeat(rival, count[pick])] = result
    base = np.cumsum(count[pick]) - count[pick]
    return owner[np.arange(int(count.sum())) + np.repeat(base[of] - (np.cumsum(count) - count), count)]


def _shard(width: int):
    def f(payloads: list[bytes]) -> list[np.ndarray]:
        parts = [unpack_segments(p) for p in payloads]
        key, doc, count, body = (np.concatenate(x) for x in zip(*parts, strict=True))
        smaller = least_documents(key, doc, count, body, width) < np.repeat(doc, count)
        return np.split(smaller, np.cumsum([p[2].sum() for p in parts])[:-1])

    return f


class Steps:
    def __init__(self, width: int, shards: int) -> None:
        self.width, self.shards = width, shards

    def _kinds(self, g: Segments, order: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many different segments each key has, by their ends and lengths; equal ones count once, and a rare case
        of different ones with equal ends is no harm. order: the segments by key; first: where each key begins."""
        padded = np.zeros(len(g.body) + 8, np.uint8)
        padded[: len(g.body)] = g.body
        eight = np.ndarray(len(g.body) + 1, np.dtype("<u8"), padded, strides=(1,))  # the eight bytes from each place on
        last = g.start + g.count + self.width - 9
        ends = mix(mix(eight[g.start] + g.count.astype(U64)) ^ eight[last])[order]
        by = np.lexsort((ends, g.key[order])) if len(order) else order
        k, e = g.key[order][by], ends[by]
        new = np.ones(len(by), np.int64)
        new[1:] = (k[1:] != k[:-1]) | (e[1:] != e[:-1])
        return np.add.reduceat(new, first) if len(first) else new

    def keys(self, chunk: int, table: pa.Table, _: pa.Table | None) -> pa.Table:
        """The chunk's distinct representatives, and whether two of its documents have them."""
        g = Segments(table, self.width)
        order = np.argsort(g.key, kind="stable")
        k, doc = g.key[order], g.doc[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
        kinds = self._kinds(g, order, first)
        return messages(chunk, 1, shard_of(k[first], self.shards), self.shards, lambda i: ask_keys(k[first[i]], several[i].astype(np.int64), kinds[i]))

    def segments(self, chunk: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        """The chunk's distinct suspected segments with the least document of each, numbered as they first occur; for
        the chunk itself, where each occurs, so that it need not look for them again."""
        g = Segments(ordered(table), self.width)
        keys, inv = np.unique(g.key, return_inverse=True)
        of_keys = shard_of(keys, self.shards)
        hot = answered_hot(answers, 1, of_keys, self.shards)[inv]
        at = np.flatnonzero(answered(answers, 1, of_keys, self.shards)[inv] & ~hot)
        start, count, key, doc = g.start[at], g.count[at], g.key[at], g.doc[at]
        if hot.any():  # every window of these for itself
            n = g.count[hot]
            single = np.repeat(g.start[hot] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            own = word_hashes(g.body, single, single + self.width, 0, self.width)
            start, count, key, doc = (np.concatenate(x) for x in ((start, single), (count, np.ones(len(single), np.int64)), (key, own), (doc, np.repeat(g.doc[hot], n))))
            by = np.argsort(start, kind="stable")
            start, count, key, doc = start[by], count[by], key[by], doc[by]
        length = count - 1 + self.width
        order, group = _pair_ranks(*_hashes(g.body, start, length, self.width))
        first = np.flatnonzero(np.diff(group, prepend=-1))
        number = np.empty(len(first), np.int64)
        number[np.argsort(order[first])] = np.arange(len(first))
        of = np.empty(len(order), np.int64)
        of[order] = number[group]
        pick = np.sort(order[first])
        least = np.empty(len(first), np.int64)
        least[number] = np.minimum.reduceat(doc[order], first) if len(first) else np.zeros(0, np.int64)
        shard = shard_of(key[pick], self.shards)

        def pack(i: np.ndarray) -> bytes:
            who = pick[i]
            return pack_segments(key[who], least[i], count[who], _gather(g.body, start[who], length[who]))

        new = np.zeros(len(start), bool)
        new[pick] = True
        state = pack_arrays(np.diff(start, prepend=0), np.packbits(new), of[~new], np.packbits(doc > least[of]), count[pick], shard)
        return pa.concat_tables([messages(chunk, 2, shard, self.shards, pack), own_message(chunk, self.shards, state)])

    def result(self, table: pa.Table, answers: pa.Table, text: bool) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        if not table.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4 + [pa.array([], pa.binary() if text else pa.string())], names)
        table = ordered(table)
        state = [p for k, p in zip(answers["step"].to_pylist(), answers["payload"].to_pylist(), strict=True) if k == OWN]
        steps, new, again, later, count, shard = unpack_arrays(state[0])
        at = np.cumsum(steps)
        new, later = (np.unpackbits(x.astype(np.uint8))[: len(at)].astype(bool) for x in (new, later))
        of = np.cumsum(new) - 1
        of[~new] = again
        bits = answered(answers, 2, np.repeat(shard, count), self.shards)
        body, offsets = _raw(table)
        mark = np.zeros(len(body) + 1, np.int32)
        np.add.at(mark, at[later], 1)
        np.subtract.at(mark, at[later] + count[of[later]] - 1 + self.width, 1)
        own = np.flatnonzero(~later)
        reps = count[of[own]]
        step = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        base = np.cumsum(count) - count
        hit = bits[np.repeat(base[of[own]], reps) + step]
        place = (np.repeat(at[own], reps) + step)[hit]
        np.add.at(mark, place, 1)
        np.subtract.at(mark, place + self.width, 1)
        gone = np.cumsum(mark[:-1], dtype=np.int32) > 0
        del mark
        total = np.zeros(len(body) + 1, np.int32)
        np.cumsum(gone, out=total[1:])
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(body)]
        edge[inner] = gone[inner]
        spans = np.zeros(len(body) + 1, np.int32)
        np.cumsum(edge, out=spans[1:])
        kept = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            left = (body[a:b] if total[a] == total[b] else body[a:b][~gone[a:b]]).tobytes()
            kept.append(left if text else hashlib.sha256(left).hexdigest())
        columns = [np.diff(offsets), np.diff(total[offsets]), np.diff(spans[offsets])]
        return pa.table([table["doc_id"], *[pa.array(c.astype(np.int64)) for c in columns], pa.array(kept, pa.binary() if text else pa.string())], names)


def drop_repeated_strings(docs: DataFrame, width: int = 50, digest: bool = False, chunk_bytes: int = 4 << 20, most_segments: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes left, binary; with digest their
    SHA-256 in hex), a row per row of docs.

    A byte goes if a string of `width` bytes that covers it also starts in a document with a smaller doc_id. Strings
    stay within a document; all are judged on the input. A null text is empty. Rows with one doc_id (repeated rows) are
    one document as far as comparison goes; a null doc_id is smaller than all others. Chunks and shards are of bounded
    bytes, but for a single longer text; a task needs about 40 times chunk_bytes, so larger executors can take larger
    chunks, and on hundreds of terabytes they should, to keep the messages between chunks and shards few. An empty table
    gives an empty result. most_segments: of one representative, above which its windows go their own ways."""
    rows, n = chunked(docs, chunk_bytes)
    steps = Steps(width, n)
    first = merged(asked(rows, steps.keys), answer_keys(most_segments), n, pack_answers)
    second = merged(asked(rows, steps.segments, first), _shard(width), n)
    kind = "string" if digest else "binary"
    return rows.groupBy("chunk").cogroup(second.groupBy("chunk")).applyInArrow(lambda t, a: steps.result(t, a, not digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kind}")
