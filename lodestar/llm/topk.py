"""Exact top-k by inner product: columnar branch-and-bound.

Candidates and queries are dealt to blocks of bounded size, and each (candidate block, query block) pair is one task: a
stated query set against all rows. In a task the candidates lie in vertical layout (a row of the matrix per dimension).
Partial scores are accumulated one block of dimensions at a time; after each block a candidate survives only if its
partial score plus the most that the remaining dimensions can add (Cauchy-Schwarz on the remaining norms) reaches the
k-th best score that is certain. Survivors are compacted before the next block. Bounds are widened by a rounding margin
and only prune; the scores themselves are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEP = 16


def long_product(a: np.ndarray, b: np.ndarray) -> int:
    """The exact inner product; beyond the range of a long its end."""
    return min(max(sum(x * y for x, y in zip(a.tolist(), b.tolist(), strict=True)), -(2**63)), 2**63 - 1)


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, list[int]]]:
    """For each query its k best of the candidates (ids ascending). Bounds are in doubles, widened by what rounding can
    add; scores are whole numbers, exact whatever their size, and those beyond the range of a long count as its ends."""
    n, dims = vectors.shape
    largest = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    most = largest(vectors) * largest(queries) * max(dims, 1)
    margin = 0.0 if most < 2**52 else most * 2.0**-46  # sums below 2 ** 52 are exact in doubles
    tall = np.ascontiguousarray(vectors.T.astype(np.float64))
    cuts = [*range(0, dims, STEP), dims]
    rest = [np.sqrt((tall[c:] ** 2).sum(0)) for c in cuts]
    for whole in queries:
        q = whole.astype(np.float64)
        alive = np.arange(n)
        part = np.zeros(len(alive))
        for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = part + (q[lo:hi] @ tall[lo:hi] if len(alive) == n else q[lo:hi] @ tall[lo:hi, alive])
            if len(alive) <= k:
                continue
            slack = np.sqrt((q[hi:] ** 2).sum()) * rest[b + 1][alive] * (1 + 1e-9) + 1e-6 + 2 * margin
            best = np.argpartition(-part, min(4 * k, len(alive) - 1))[: 4 * k]
            sure = part[best] + q[hi:] @ tall[hi:, alive[best]]
            floor = np.partition(sure, len(sure) - min(k, len(sure)))[len(sure) - min(k, len(sure))]
            keep = part + slack >= min(floor, 2.0**63)  # scores beyond a long's range all tie
            alive, part = alive[keep], part[keep]
        if margin:
            exact = [long_product(vectors[i], whole) for i in alive]
            at = sorted(range(len(alive)), key=lambda i: (-exact[i], alive[i]))[:k]
            yield ids[alive[at]], [exact[i] for i in at]
        else:
            at = np.lexsort((alive, -part))[:k]
            yield ids[alive[at]], part[at].astype(np.int64).tolist()


#: What tells queries apart: rows that share a vec_id are queries each.
QUERY = ["query_id", "h1", "h2", "copies"]


def _block(k: int):
    def vectors(table: pa.Table, ids: str) -> tuple[np.ndarray, pa.Table]:
        n = table.num_rows
        flat = table["v"].combine_chunks().flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 0), np.int64)
        order = np.argsort(table[ids].to_numpy(), kind="stable")
        return flat[order], table.take(pa.array(order))

    def f(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        v, rows = vectors(rows, "vec_id")
        q, queries = vectors(queries, "query_id")
        at: list[int] = []
        found: list[list[int]] = [[], [], []]
        if len(v):
            for i, (best, scores) in enumerate(search_block(v, rows["vec_id"].to_numpy(), q, k)):
                at += [i] * len(best)
                found[0] += best.tolist()
                found[1] += scores
                found[2] += [long_product(q[i], q[i])] * len(best)
        own = queries.select(QUERY).take(pa.array(at, pa.int64()))
        return pa.table([*own.columns, *[pa.array(x, pa.int64()) for x in found]], [*QUERY, "vec_id", "score", "own"])

    return f


def quantised(vectors: DataFrame, scale: int = 256, every_row: bool = False) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as long (beyond its range: its ends). Other columns are not looked
    at; an empty vector is a vector. Vectors that are null or hold null or non-finite
    components, and rows without a vec_id, are left out; rows that share a vec_id count once, with the least vector,
    or with every_row each."""
    x = F.col("embedding")
    fit = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))
    return rows if every_row else rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, row_block: int = 16_384, query_block: int = 2_048) -> DataFrame:
    """The k highest inner products of each query over all rows but its own: query_id, rank, vec_id, score.

    rows: (vec_id, v array<long>); queries: some of these rows. Ties go to the smaller vec_id; a query is compared with
    vectors of its own length only. Rows that share a vec_id are candidates each, for one another too, and queries each.
    Scores beyond the range of a long count as its ends. An empty side gives an empty result. Nothing is broadcast; a
    task holds one block of either side.

    A query's own row needs no number: among the k + 1 best of all rows one that has the query's vec_id and its product
    with itself is taken out; rows that share both give the same result row. Equal queries are searched once."""
    n, m = max(1, -(-rows.count() // row_block)), max(1, -(-queries.count() // query_block))
    deal = lambda df, ids, mine, of, other, upto: df.withColumn("dims", F.size("v")).withColumn(mine, F.pmod(F.xxhash64(ids, "v"), F.lit(of)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(upto - 1))))
    asked = queries.groupBy(F.col("vec_id").alias("query_id"), "v").agg(F.count("*").alias("copies"))
    asked = asked.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    left, right = deal(rows.select("vec_id", "v"), "vec_id", "rb", n, "qb", m), deal(asked, "query_id", "qb", m, "rb", n)
    keys = ["dims", "rb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block(k + 1), "query_id long, h1 long, h2 long, copies long, vec_id long, score long, own long")
    each = Window.partitionBy("query_id", "h1", "h2")
    found = found.withColumn("place", F.row_number().over(each.orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("place"))).over(each)
    found = found.withColumn("gone", F.coalesce(own, F.lit(k + 2))).where("place <> gone")
    found = found.withColumn("rank", F.when(F.col("place") > F.col("gone"), F.col("place") - 1).otherwise(F.col("place"))).where(F.col("rank") <= k)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return found.select("query_id", "rank", "vec_id", "score", copies.alias("copy")).drop("copy")
