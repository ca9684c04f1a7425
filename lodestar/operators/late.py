"""EXTENSION: late interaction. A document has several vectors, and so has a query; the score is the sum, over the query's
vectors, of the largest inner product with one of the document's.

Documents and queries are dealt to blocks, and a pair of blocks is one task. In a task a document is first bounded by its
mean vector and its radius (no vector of it has a larger product with q than the mean's plus |q| times the radius), for
all documents by one matrix product; a query then measures documents in the order of their bounds, a few at a time, until
the next bound cannot reach the k-th best score. Bounds only prune; what is measured is measured in full."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents that a query measures between two looks at the bounds.
STEP = 64


def token_vectors(rows: DataFrame, doc: str, place: str, vector: str) -> DataFrame:
    """(doc_id, vectors) of rows that hold one vector each, in the order of their places; null vectors are left out. A
    document's vectors are one row, so they must be few, as the words of a passage are."""
    both = F.struct(F.col(place).alias("p"), F.col(vector).cast("array<double>").alias("v"))
    listed = rows.where(F.col(vector).isNotNull()).groupBy(F.col(doc).alias("doc_id")).agg(F.sort_array(F.collect_list(both)).alias("x"))
    return listed.select("doc_id", F.col("x.v").alias("vectors"))


def _stacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All vectors of some rows, one below the other, and where each row's begin."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.append(0, np.cumsum(np.array(column.value_lengths().fill_null(0))))
    inner = column.flatten()
    dims = len(inner[0]) if len(inner) else 0
    return inner.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), ends


def best_of_block(vectors: np.ndarray, first: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int, own: object = None) -> tuple[list[int], list[float], int]:
    """Places of the k best documents (ids ascending, vectors[first[i] : first[i + 1]] those of one) but for `own`, their
    scores, and how many were measured."""
    n = len(ids)
    count = np.diff(first)
    mean = np.add.reduceat(vectors, first[:-1]) / count[:, None]
    radius = np.sqrt(np.maximum.reduceat(((vectors - np.repeat(mean, count, 0)) ** 2).sum(1), first[:-1]))
    bound = (mean @ query.T + radius[:, None] * np.linalg.norm(query, axis=1)).sum(1) + 1e-9
    order = np.argsort(-bound, kind="stable")
    order = order[ids[order] != own]
    scores, at, measured = np.zeros(0), np.zeros(0, np.int64), 0
    for i in range(0, len(order), STEP):
        if len(scores) == k and bound[order[i]] < scores[-1] - 1e-6:
            break
        some = np.sort(order[i : i + STEP])
        rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in some])
        edges = np.append(0, np.cumsum(count[some]))[:-1]
        new = np.round(np.maximum.reduceat(vectors[rows] @ query.T, edges).sum(1), 9)
        measured += len(some)
        scores, at = np.append(scores, new), np.append(at, some)
        keep = np.lexsort((at, -scores))[:k]
        scores, at = scores[keep], at[keep]
    return at.tolist(), scores.tolist(), min(measured, n)


def _block(k: int):
    def f(key: tuple, docs: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if docs.num_rows and queries.num_rows:
            docs = docs.take(np.argsort(docs["doc_id"].to_numpy(), kind="stable"))
            ids = docs["doc_id"].to_numpy()
            v, first = _stacked(docs["vectors"])
            q, at = _stacked(queries["vectors"])
            for i, name in enumerate(queries["query_id"].to_pylist()):
                best, scores, _ = best_of_block(v, first, ids, q[at[i] : at[i + 1]], k, name)
                out[0] += [name] * len(best)
                out[1] += ids[best].tolist()
                out[2] += scores
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "doc_id", "score"])

    return f


def max_sim(docs: DataFrame, queries: DataFrame, k: int, doc_block: int = 16_384, query_block: int = 512) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query by late interaction, the query's own document
    apart, ties by the smaller doc_id; scores are rounded to 1e-9. docs: (doc_id long, vectors), queries likewise, one row
    each, all vectors of one length; rows without an id or vectors take no part. Nothing is broadcast; a task holds a
    block of either side."""
    fit = lambda df: df.where("doc_id is not null and size(vectors) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "vectors")
    docs, queries = fit(docs), fit(queries).withColumnRenamed("doc_id", "query_id")
    n, m = max(1, -(-docs.count() // doc_block)), max(1, -(-queries.count() // query_block))
    deal = lambda df, key, mine, of, other, upto: df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(of)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(upto - 1))))
    left, right = deal(docs, "doc_id", "db", n, "qb", m), deal(queries, "query_id", "qb", m, "db", n)
    found = left.groupBy("db", "qb").cogroup(right.groupBy("db", "qb")).applyInArrow(_block(k), "query_id long, doc_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

