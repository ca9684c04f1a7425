"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Features of a text: its distinct words (exact bytes, hashed to `dims` slots; log counts, scaled to unit length), its
structure statistics, each binned at quantiles of the training sample (case, symbols, digits, word and line lengths,
repetition), and its own size as the only metadata. Labels, lang, source and doc_id are never inputs of a score.

score = sigmoid(bias + sum w_f x_f + 1/2 sum_r [(sum_f v_fr x_f)^2 - sum_f v_fr^2 x_f^2]): the sum-of-squares identity
gives all pairwise interactions in time linear in the features. Training (on the driver) sees at most `train_rows`
labelled rows, those with the smallest hashed ids; scoring runs over every whole text, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, fresh, narrow, raw_parts, word_hashes, word_spans

BLOCK_BYTES = 2 << 20
#: Classes of bytes: 1 lower, 2 upper, 3 digit, 4 sentence marks, 5 other ASCII symbols, 6 white space, 7 beyond ASCII.
CLASS = np.zeros(256, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 1, 2, 3
CLASS[[33, *range(35, 39), 42, 43, 47, *range(60, 63), 64, *range(91, 97), *range(123, 127), *range(0, 9)]] = 5
CLASS[[34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 4
CLASS[[32, 9, 10, 11, 12, 13]] = 6
CLASS[128:] = 7
STATS = 14


def _sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, n)[:n]


def features(body: np.ndarray, offsets: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of the hashed words, and the structure statistics, of the texts in a block."""
    n = len(offsets) - 1
    starts, ends, row = word_spans(body, offsets)
    length = np.diff(offsets)
    classes = CLASS[body]
    of = [np.diff(np.concatenate([[0], np.cumsum(classes == c)])[offsets]) for c in range(1, 8)]
    lines = np.diff(np.concatenate([[0], np.cumsum(body == 10)])[offsets]) + 1
    words = np.bincount(row, minlength=n)[:n]
    hashes = word_hashes(body, starts, ends)
    symbol = np.concatenate([[0], np.cumsum(classes == 5)])
    upper = np.concatenate([[0], np.cumsum(classes == 2)])
    lower = np.concatenate([[0], np.cumsum(classes == 1)])
    has_symbol = symbol[ends] > symbol[starts]
    shouted = (upper[ends] > upper[starts]) & (lower[ends] == lower[starts])
    bare = (symbol[ends] - symbol[starts]) == ends - starts
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    key = (row.astype(np.uint64) << np.uint64(32)) | (hashes & np.uint64(dims - 1))
    slots, counts = np.unique(key, return_counts=True)
    at, slot = (slots >> np.uint64(32)).astype(np.int64), (slots & np.uint64(0xFFFFFFFF)).astype(np.int64)
    value = np.log1p(counts)
    norm = np.sqrt(_sums(value**2, at, n))
    value = value / norm[at]
    w, c = np.maximum(words, 1), np.maximum(length, 1)
    letters = np.maximum(of[0] + of[1], 1)
    stats = np.column_stack(
        [
            np.log1p(length), np.log1p(words), of[1] / letters, of[4] / c, of[2] / c, of[3] / c, of[6] / c,
            (ends - starts).sum() * 0 + _sums((ends - starts).astype(float), row, n) / w, _sums(has_symbol, row, n) / w,
            _sums(shouted, row, n) / w, _sums(bare, row, n) / w, _sums(again, row, n) / w, np.bincount(at, minlength=n)[:n] / w, lines / w,
        ]
    )
    return at, slot, value, stats


@dataclass
class Machine:
    """dims word slots, then STATS x bins slots of binned statistics."""

    dims: int
    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def rows(self, at: np.ndarray, slot: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features of a block, words and bins, in row order."""
        n, bins = len(stats), self.edges.shape[1] + 1
        bin_ = np.column_stack([np.searchsorted(self.edges[i], stats[:, i], "right") + i * bins for i in range(STATS)]) + self.dims
        at = np.concatenate([at, np.repeat(np.arange(n), STATS)])
        order = np.argsort(at, kind="stable")
        return at[order], np.concatenate([slot, bin_.ravel()])[order], np.concatenate([value, np.ones(n * STATS)])[order]

    def margins(self, at: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The raw score of each row and its factor sums. Every row has features (its bins), so no segment is empty."""
        first = np.searchsorted(at, np.arange(n))
        scaled = self.factors[slot] * value[:, None]
        sums = np.add.reduceat(scaled, first, axis=0)
        squares = np.add.reduceat((scaled**2).sum(1), first)
        return self.bias + np.add.reduceat(self.linear[slot] * value, first) + 0.5 * ((sums**2).sum(1) - squares), sums

    def score(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        m, _ = self.margins(*self.rows(*features(body, offsets, self.dims)), n) if n else (np.zeros(0), None)
        return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], dims: int, rank: int = 8, bins: int = 8, epochs: int = 12, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss, in batches. Without examples every score is 0.5."""
    rng = np.random.default_rng(seed)
    size = dims + STATS * bins
    stats = np.array([e[2] for e in examples]).reshape(-1, STATS)
    edges = np.quantile(stats, np.arange(1, bins) / bins, axis=0).T if len(stats) else np.zeros((STATS, bins - 1))
    m = Machine(dims, edges, 0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    if not examples:
        m.factors[:] = 0
        return m
    y_all = np.array([e[3] for e in examples], float)
    base = np.clip(y_all.mean(), 0.02, 0.98)
    m.bias = float(np.log(base / (1 - base)))
    g_bias, g_linear, g_factors = 1e-3, np.full(size, 1e-3), np.full((size, rank), 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for lo in range(0, len(order), 64):
            part = order[lo : lo + 64]
            n = len(part)
            counts = [len(examples[i][0]) for i in part]
            at, slot, value = m.rows(np.repeat(np.arange(n), counts), np.concatenate([examples[i][0] for i in part]), np.concatenate([examples[i][1] for i in part]), stats[part])
            margin, sums = m.margins(at, slot, value, n)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y_all[part]) / n
            pull = error[at] * value
            used, inv = np.unique(slot, return_inverse=True)
            dw = np.bincount(inv, pull, len(used)) + decay * m.linear[used]
            order_ = np.argsort(inv, kind="stable")
            dv_all = pull[:, None] * (sums[at] - m.factors[slot] * value[:, None])
            dv = np.add.reduceat(dv_all[order_], np.searchsorted(inv[order_], np.arange(len(used))), axis=0) + decay * m.factors[used]
            g_linear[used] += dw**2
            g_factors[used] += dv**2
            g_bias += error.sum() ** 2
            m.linear[used] -= rate * dw / np.sqrt(g_linear[used])
            m.factors[used] -= rate * dv / np.sqrt(g_factors[used])
            m.bias -= rate * error.sum() / np.sqrt(g_bias)
    m.linear, m.factors = m.linear.astype(np.float32), m.factors.astype(np.float32)
    return m


def _featurise(dims: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = raw_parts(batch["raw"])
            for i, j in blocks(offsets, BLOCK_BYTES):
                at, slot, value, stats = features(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], dims)
                cut = np.searchsorted(at, np.arange(j - i + 1))
                cols = [[x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)] for x in (slot.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch["h"].slice(i, j - i), batch["y"].slice(i, j - i), *[pa.array(c, pa.binary()) for c in cols], pa.array([s.tobytes() for s in stats], pa.binary())], ["h", "y", "slots", "vals", "stats"])

    return f


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = 4000, dims: int = 1 << 15, **kw) -> Machine:
    """Fit on the labelled documents whose crc32(doc_id as text) mod 5 is not 0: those `train_rows` rows at the most
    whose hashed ids are smallest. Null ids and labels are left out; of several labels of an id the largest counts."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = usable.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(train_rows)
    sample = narrow(docs).join(F.broadcast(chosen), "doc_id").select("h", "y", "raw")
    rows = sample.mapInArrow(_featurise(dims), "h long, y int, slots binary, vals binary, stats binary").orderBy("h", "slots").limit(train_rows).collect()
    examples = [(np.frombuffer(r["slots"], np.int32).astype(np.int64), np.frombuffer(r["vals"], np.float32).astype(float), np.frombuffer(r["stats"], float), r["y"]) for r in rows]
    return fit(examples, dims, **kw)


def score_documents(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text. A null text scores as the empty one; held_out is
    whether crc32(doc_id as text) mod 5 is 0 (false for a null id). An empty table gives an empty result."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # dims x (rank + 1) numbers, whatever the input

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = raw_parts(batch["raw"])
            for i, j in blocks(offsets, BLOCK_BYTES):
                s = model.value.score(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), batch["held_out"].slice(i, j - i), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return narrow(docs).withColumn("held_out", held).mapInArrow(f, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all their columns, whose score reaches the threshold; texts and ids as they were. A null text
    scores as the empty one; very long texts are scored whole; repeated rows get equal scores, so they stay or go
    together; columns with clashing names stay; an empty table gives an empty result."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = raw_parts(batch.column(batch.num_columns - 1))
            scores = [model.value.score(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets, BLOCK_BYTES)]
            keep = np.concatenate(scores) >= threshold if scores else np.zeros(0, bool)
            yield batch.filter(pa.array(keep)).select(list(range(batch.num_columns - 1)))

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias(fresh(docs, "raw")[0])
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], raw).mapInArrow(f, docs.schema)
