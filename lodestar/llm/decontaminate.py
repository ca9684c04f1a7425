"""Benchmark decontamination: a BM25 index of the test items, searched by every training passage with block-max WAND.

The index holds the items (not the corpus): per term a posting list in item order with the largest score of the list and
of each block of items. Documents are cut into passages of two item lengths that overlap by one, so that every stretch as
long as an item lies whole in some passage. A passage is a query of its distinct terms.

An item's threshold is the least BM25 score that a passage holding `overlap` of the item's shingles can have (the item's
score for itself, less its largest term scores for as many words as may be missing), so retrieval loses no match. Items
are numbered by their threshold, so that what an item asks for is asked for by all after it. Search moves one cursor per
term: with the cursors in item order, the pivot is the first item that the lists' largest scores up to it can bring to its
threshold; no item before it can reach its own. If the block maxima at the pivot do not reach the threshold either, all
cursors skip the block; if they do, the cursors before the pivot are moved up to it, and once they stand on it the item is
scored in full. A few thousand passages take their steps together, as rows of a matrix of cursors.

Every retrieved (passage, item) is verified: the distinct shingles (`shingle` words, lower-cased; all words of a shorter
text) of the item's question and, if it has one, of its answer must each be found in the passage to the share `overlap`.

Items are dealt to shards of at most `index_bytes` of text. A benchmark of one shard is one pass over the documents. Of a
larger one the driver builds, broadcasts and lets go of one shard's index after the other, each of them one pass, in which
a task loads and holds that index alone; what the passes find is written, and joined to the documents by their texts'
hashes. Document frequencies are those of the shard: they steer only the pruning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, fresh, materialise, raw_parts, run_hashes, word_hashes, word_spans

BLOCK_BYTES = 1 << 20
K1, B = 1.5, 0.75
#: ASCII letters to lower case; marks at a word's ends do not count.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MARK = np.zeros(256, bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def terms(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word: lower-cased (ASCII), without ASCII punctuation around it; bare punctuation is no word."""
    starts, ends, row = word_spans(body, offsets)
    plain = np.concatenate([[0], np.cumsum(~MARK[body])])
    real = plain[ends] > plain[starts]
    starts, ends, row = starts[real], ends[real], row[real]
    letters = np.flatnonzero(~MARK[body])
    starts = letters[np.searchsorted(letters, starts)] if len(starts) else starts
    ends = letters[np.searchsorted(letters, ends) - 1] + 1 if len(ends) else ends
    return word_hashes(LOWER[body], starts, ends), row


def _pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


class Index:
    """One shard of the test items: postings, largest scores, thresholds and shingles."""

    def __init__(self, items: list[tuple[int | None, str, str | None]], span: int | None = None, overlap: float = 0.8, shingle: int = 5, block_items: int = 8) -> None:
        self.overlap, self.block_items = overlap, block_items
        parts = [[self._shingles(t, shingle) for t in (q, a) if t] for _, q, a in items]
        kept = [i for i, p in enumerate(parts) if any(len(s) for _, s in p)]
        ids = [items[i][0] for i in kept]
        parts = [[(w, s) for w, s in parts[i] if len(s)] for i in kept]
        self.n = n = len(kept)
        h, row = terms(*_pack([f"{items[i][1] or ''}\n{items[i][2] or ''}".encode() for i in kept]))
        words = np.bincount(row, minlength=n)
        self.span = span or int(max(words.max(initial=1), shingle))
        self.vocabulary, term = np.unique(h, return_inverse=True)
        pair, tf = np.unique(term * max(n, 1) + row, return_counts=True)
        term, item = pair // max(n, 1), pair % max(n, 1)
        df = np.bincount(term, minlength=len(self.vocabulary))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        score = idf[term] * tf / (tf + K1 * (1 - B + B * words[item] / words.mean())) if n else np.zeros(0)
        # an item's scores from the largest on: what is left after as many terms as may be missing
        order = np.lexsort((-score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        missing = np.array([sum(int((1 - overlap) * len(s) + 1e-9) for _, s in p) for p in parts], np.int64)
        least = np.bincount(item[order], score[order] * (place >= missing[item[order]]), n) if n else np.zeros(0)
        by_least = np.argsort(least, kind="stable")
        self.ids, self.parts = [ids[i] for i in by_least], [parts[i] for i in by_least]
        self.least = np.append(least[by_least], np.inf)
        number = np.empty(n, np.int64)
        number[by_least] = np.arange(n)
        order = np.lexsort((number[item], term))
        term, self.item, self.score = term[order], number[item[order]], score[order]
        self.place = term * (n + 1) + self.item  # ascending: where a list reaches an item
        self.first = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        self.list_max = np.maximum.reduceat(self.score, self.first[:-1]) if n else np.zeros(0)
        self.blocks = n // block_items + 1
        self.cell, at = np.unique(term * self.blocks + self.item // block_items, return_index=True)
        self.cell_max = np.maximum.reduceat(self.score, at) if n else np.zeros(0)

    @staticmethod
    def _shingles(text: str, shingle: int) -> tuple[int, np.ndarray]:
        h, _ = terms(*_pack([text.encode()]))
        width = min(shingle, len(h))
        return width, np.unique(run_hashes(h, width)) if width else np.zeros(0, np.uint64)

    def search(self, h: np.ndarray, row: np.ndarray, together: int = 2048) -> Iterator[tuple[int, int, int]]:
        """(row, passage, item) of all items that reach their threshold. Passage p of a row: 2 spans from word p * span."""
        if not len(h) or not self.n:
            return
        serial = (np.arange(len(row)) - np.searchsorted(row, row)) // self.span
        name = (row << 32) + serial  # ascending
        p = np.cumsum(np.append(True, name[1:] != name[:-1])) - 1
        names = name[np.append(True, name[1:] != name[:-1])]
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == h
        again = known & (serial > 0)  # a word is in the passage before, too
        pairs = np.sort(np.concatenate([p[known], p[again] - 1]) * len(self.vocabulary) + np.concatenate([at[known], at[again]]))
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        p, term = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
        bound = np.bincount(p, self.list_max[term], len(names))
        count = np.bincount(p, minlength=len(names))
        start = np.cumsum(count) - count
        asked = np.flatnonzero(bound >= self.least[0] - 1e-9)
        asked = asked[np.argsort(count[asked], kind="stable")]  # passages with as many terms share a matrix
        for i in range(0, len(asked), together):
            who = asked[i : i + together]
            column = np.arange(count[who].max())
            inside = column < count[who][:, None]
            lists = term[np.minimum(start[who][:, None] + column, len(term) - 1)]
            for k, item in self._wand(who, lists, inside):
                yield int(names[k]) >> 32, int(names[k]) & 0xFFFFFFFF, item

    def _wand(self, who: np.ndarray, lists: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
        """(who, item) of the rows of a matrix of posting lists; inside tells lists from padding."""
        cursor = np.where(inside, self.first[lists], 0)
        item = np.where(inside, self.item[cursor], self.n)  # n: the list is at its end
        most = np.where(inside, self.list_max[lists], 0.0)
        while True:
            order = np.argsort(item, axis=1)
            ahead = np.take_along_axis(item, order, 1)
            reach = np.cumsum(np.take_along_axis(most, order, 1), 1) >= self.least[ahead] - 1e-9
            go = reach.any(1)
            if not go.all():
                who, lists, cursor, item, most, ahead, reach = (x[go] for x in (who, lists, cursor, item, most, ahead, reach))
            if not len(who):
                return
            pivot = ahead[np.arange(len(who)), reach.argmax(1)]
            upto = item <= pivot[:, None]
            r, c = np.nonzero(upto)
            cell = lists[r, c] * self.blocks + pivot[r] // self.block_items
            k = np.minimum(np.searchsorted(self.cell, cell), len(self.cell) - 1)
            in_block = np.bincount(r, np.where(self.cell[k] == cell, self.cell_max[k], 0.0), len(who))
            worth = in_block >= self.least[pivot] - 1e-9
            full = worth & (ahead[:, 0] == pivot)
            if full.any():
                r, c = np.nonzero((item == pivot[:, None]) & full[:, None])
                total = np.bincount(r, self.score[cursor[r, c]], len(who))
                hit = full & (total >= self.least[pivot] - 1e-9)
                yield from zip(who[hit].tolist(), pivot[hit].tolist(), strict=True)
            beyond = np.minimum((pivot // self.block_items + 1) * self.block_items, np.where(upto, self.n, item).min(1))
            target = np.where(full, pivot + 1, np.where(worth, pivot, beyond))
            r, c = np.nonzero(item < target[:, None])
            to = np.searchsorted(self.place, lists[r, c] * (self.n + 1) + target[r])
            end = to >= self.first[lists[r, c] + 1]
            to = np.minimum(to, len(self.item) - 1)
            cursor[r, c], item[r, c] = to, np.where(end, self.n, self.item[to])

    def matches(self, body: np.ndarray, offsets: np.ndarray) -> dict[int, dict[int, float]]:
        """Verified items of each row, with the least overlap of their parts."""
        h, row = terms(body, offsets)
        first = np.searchsorted(row, np.arange(len(offsets)))
        out: dict[int, dict[int, float]] = {}
        seen: dict[tuple[int, int, int], np.ndarray] = {}
        for r, p, i in self.search(h, row):
            share = 1.0
            for width, own in self.parts[i]:
                if (r, p, width) not in seen:
                    if len(seen) > 64:
                        seen.clear()
                    a = first[r] + p * self.span
                    seen[r, p, width] = run_hashes(h[a : min(a + 2 * self.span, first[r + 1])], width)
                share = min(share, float(np.isin(own, seen[r, p, width]).mean()))
            if share >= self.overlap - 1e-9:
                found = out.setdefault(r, {})
                found[i] = max(found.get(i, 0.0), share)
        return out


def _shards(benchmark: DataFrame, index_bytes: int, overlap: float, shingle: int) -> tuple[int, Callable[[int], Index]]:
    """How many shards there are, and what builds the index of one; the driver holds one shard's items."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("q"), answer.alias("a")).where("q is not null or a is not null")
    size = items.agg(F.sum(F.coalesce(F.octet_length("q"), F.lit(0)) + F.coalesce(F.octet_length("a"), F.lit(0)))).first()[0] or 0
    n = max(1, -(-size // index_bytes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, row = terms(*raw_parts(batch["raw"]))
            yield pa.RecordBatch.from_arrays([pa.array([int(np.bincount(row).max(initial=0))], pa.int64())], ["n"])

    both = items.select(F.concat_ws("\n", "q", "a").cast("binary").alias("raw"))
    span = max(both.mapInArrow(count, "n long").agg(F.max("n")).first()[0] or 1, shingle)  # the same for all shards

    def build(s: int) -> Index:
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "q", "a"), F.lit(n)) == s)
        return Index(sorted(((r["i"], r["q"] or "", r["a"]) for r in part.collect()), key=repr), span, overlap, shingle)

    return n, build


def with_matches(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.8, shingle: int = 5, index_bytes: int = 16 << 20) -> DataFrame:
    """docs with two more columns, which come last: the ids of the items found in the row's text (array<long>, ascending)
    and their overlaps (array<double>). They are called _items and _overlaps unless docs has such columns.

    benchmark: (item_id, text) and, optionally, answer. A null text counts as empty and holds nothing; items without
    words match nothing; a repeated item_id counts once. Any rows, ids and other columns of docs come through as they
    are; an empty table on either side gives no matches."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n, build = _shards(benchmark, index_bytes, overlap, shingle)
    own, items, overlaps, h1, h2 = fresh(docs, "_raw", "_items", "_overlaps", "_h1", "_h2")
    columns, text = [F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col("text"), F.lit(""))
    none = [F.array().cast("array<long>").alias(items), F.array().cast("array<double>").alias(overlaps)]
    if n == 1:
        out = docs.select(*columns, text.cast("binary").alias(own), *none)
        return out.mapInArrow(_search(spark.sparkContext.broadcast(build(0))), out.schema).drop(own)
    hashes = [F.xxhash64(text).alias(h1), F.xxhash64(F.lit(1), text).alias(h2)]
    given = docs.select(*hashes, text.cast("binary").alias(own), *none)
    found = []
    for s in range(n):
        index = spark.sparkContext.broadcast(build(s))
        found.append(materialise(given.mapInArrow(_search(index), given.schema).where(F.size(items) > 0).select(h1, h2, F.explode(F.arrays_zip(items, overlaps)).alias("x")), f"hits-{s}"))
        index.destroy()
    hits = reduce(DataFrame.unionByName, found).groupBy(h1, h2, F.col(f"x.{items}").alias("i")).agg(F.max(f"x.{overlaps}").alias("o"))
    listed = hits.groupBy(h1, h2).agg(F.sort_array(F.collect_list(F.struct(F.col("i").isNull(), "i", "o"))).alias("x"))  # at most a list of all items
    listed = listed.select(h1, h2, F.col("x.i").alias(items), F.col("x.o").alias(overlaps))
    joined = docs.select(*columns, *hashes).join(listed, [h1, h2], "left")
    return joined.select(*columns, F.coalesce(items, none[0]).alias(items), F.coalesce(overlaps, none[1]).alias(overlaps))


def _search(shared: Broadcast):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            n = batch.num_columns
            body, offsets = raw_parts(batch.column(n - 3))
            items, shares = batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()
            for i, j in blocks(offsets, BLOCK_BYTES):
                for r, found in index.matches(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).items():
                    best: dict[int | None, float] = {}
                    for k, s in found.items():
                        best[index.ids[k]] = max(s, best.get(index.ids[k], 0.0))
                    items[i + r] = sorted(best, key=lambda x: (x is None, x or 0))
                    shares[i + r] = [best[x] for x in items[i + r]]
            columns = [*batch.columns[: n - 2], pa.array(items, pa.list_(pa.int64())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return f


def contamination(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """A row per row of docs: doc_id, contaminated, n_items, items (ids, ascending), overlap (the highest; 0 if none).
    Null, empty and very long texts, repeated rows and empty tables as in with_matches()."""
    found = with_matches(docs.select("doc_id", "text"), benchmark, **kw)
    return found.select("doc_id", (F.size("_items") > 0).alias("contaminated"), F.size("_items").cast("long").alias("n_items"), F.col("_items").alias("items"), F.coalesce(F.array_max("_overlaps"), F.lit(0.0)).alias("overlap"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of docs in which no item is found, with their columns as they were; rows with a null or empty text stay,
    repeated rows are judged each. Empty tables and clashing names as in with_matches()."""
    found = with_matches(docs, benchmark, **kw)
    items, overlaps = found.columns[-2:]
    return found.where(F.size(items) == 0).drop(items, overlaps)
