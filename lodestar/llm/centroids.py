"""Centroid clustering of integer vectors by partial-distance search.

Every vector is compared with all centroids over the dimensions of the highest variance first. The centroid that is
nearest there is measured in full and sets the current best; of the others, those whose partial sum of squares is strictly
above it are abandoned after each block of dimensions, and the survivors finish all dimensions. Sums of squares of whole
numbers only grow, so nothing that could win or tie is ever abandoned, and the result is that of a full comparison.

A round is one pass over the vectors as they lie, without a shuffle of vectors: a task adds up its vectors by centroid and
sends a row per centroid. What the driver holds is the centroids and, per round, their k rows of sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Dimensions between two looks at which centroids are out, and vectors that are compared at a time.
STEP, ROWS = 8, 4096
#: Components up to this size have distances and sums of ROWS vectors within 64 bits; others are Python's integers.
EXACT = 1 << 26
LONG = 2**63 - 1


def integer_vectors(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of `dims` components, none null or non-finite, and floor(scale * x) of these; components
    beyond the range of a long count as its ends."""
    fit = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False)
    flat = column.filter(pa.array(fit)).flatten()
    x = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims) * scale  # null becomes NaN
    finite = np.isfinite(pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, dims).all(1)
    x = np.floor(x[finite])
    fit[np.flatnonzero(fit)[~finite]] = False
    big = np.abs(x) >= 2.0**63
    v = np.where(big, 0, x).astype(np.int64)
    v[big] = np.where(x[big] > 0, LONG, -LONG - 1)
    return fit, v


def _safe(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are, or as Python's integers where 64 bits may not do."""
    small = all(not a.size or (a.max() <= EXACT and a.min() >= -EXACT) for a in arrays)
    return [a.astype(np.int64) if small else a.astype(object) for a in arrays]


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector, the smaller among equals, and the squared distance. order: the
    dimensions, that of the highest variance first."""
    cluster, distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(vectors), ROWS):
        c, d = _nearest(*_safe(vectors[at : at + ROWS][:, order], centroids[:, order]))
        cluster.append(c)
        distance.append(d)
    return np.concatenate(cluster), np.concatenate(distance)


def _nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, dims = v.shape
    part = np.zeros((n, len(c)), v.dtype)
    for k in range(min(STEP, dims)):
        part += (v[:, k, None] - c[None, :, k]) ** 2
    cluster = part.argmin(1)
    best = part[np.arange(n), cluster] + ((v[:, STEP:] - c[cluster, STEP:]) ** 2).sum(1)
    alive = part <= best[:, None]
    alive[np.arange(n), cluster] = False
    row, to = np.nonzero(alive)
    part = part[row, to]
    for k in range(STEP, dims, STEP):
        part = part + ((v[row, k : k + STEP] - c[to, k : k + STEP]) ** 2).sum(1)
        keep = np.flatnonzero(part <= best[row])
        row, to, part = row[keep], to[keep], part[keep]
    # what has finished all dimensions is as near as the current best or nearer: the least, then the smallest number
    for d in range(len(c)):
        mine = to == d
        r, p = row[mine], part[mine]
        better = (p < best[r]) | ((p == best[r]) & (d < cluster[r]))
        cluster[r[better]], best[r[better]] = d, p[better]
    return cluster, best


class Vectors:
    """The vectors of a table that are fit for clustering, as the queries below read them."""

    def __init__(self, table: DataFrame, dims: int, scale: int) -> None:
        bounded_batches(table.sparkSession)
        self.rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
        self.dims, self.scale = dims, scale

    def initial(self, k: int, seed: int) -> np.ndarray:
        """The k vectors with the least hex SHA-256 of `seed:vec_id`, the smaller vector first where ids repeat. Every
        task sends its own k least, of which Spark takes the least: k rows reach the driver."""
        dims, scale = self.dims, self.scale

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least: list[tuple[str, list[int]]] = []
            for batch in batches:
                fit, v = integer_vectors(batch["embedding"], dims, scale)
                ids = batch["vec_id"].filter(pa.array(fit)).to_pylist()
                keys = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i in ids]
                bound = least[-1][0] if len(least) == k else "g"
                least = sorted(least + [(h, v[i].tolist()) for i, h in enumerate(keys) if h <= bound])[:k]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in least], pa.string()), pa.array([x for _, x in least], pa.list_(pa.int64()))], ["h", "v"])

        found = self.rows.mapInArrow(f, "h string, v array<long>").orderBy("h", "v").limit(k).collect()
        return np.array([r["v"] for r in found], np.int64).reshape(-1, dims)

    def order(self) -> np.ndarray:
        """The dimensions by falling variance over all vectors. It decides how soon centroids are abandoned, not which
        one is nearest, so doubles do."""
        dims, scale = self.dims, self.scale

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, first, second = 0, np.zeros(dims), np.zeros(dims)
            for batch in batches:
                v = integer_vectors(batch["embedding"], dims, scale)[1].astype(float)
                n, first, second = n + len(v), first + v.sum(0), second + (v**2).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array([n] * dims, pa.int64()), pa.array(first), pa.array(second)], ["dim", "n", "first", "second"])

        sums = self.rows.mapInArrow(f, "dim long, n long, first double, second double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("first").alias("a"), F.sum("second").alias("b"))
        variance = F.round(F.coalesce(F.try_divide("b", "n") - F.pow(F.try_divide("a", "n"), F.lit(2)), F.lit(0.0)), 6)
        rows = sums.select("dim", variance.alias("v")).orderBy(F.desc("v"), "dim").collect()
        return np.array([r["dim"] for r in rows], np.int64) if rows else np.arange(dims)

    def moved(self, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The floor of the mean of each centroid's vectors, componentwise and exact; a centroid without vectors stays."""
        dims, scale = self.dims, self.scale

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = np.zeros(len(centroids), np.int64)
            total = np.zeros((len(centroids), dims), object)
            for batch in batches:
                v = integer_vectors(batch["embedding"], dims, scale)[1]
                for at in range(0, len(v), ROWS):
                    some = _safe(v[at : at + ROWS])[0]
                    cluster, _ = nearest(v[at : at + ROWS], centroids, order)
                    for c in np.unique(cluster).tolist():
                        count[c] += int((cluster == c).sum())
                        total[c] += some[cluster == c].sum(0)
            used = np.flatnonzero(count)
            sums = pa.array([total[c].tolist() for c in used.tolist()], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), sums], ["cluster", "n", "sums"])

        parts = self.rows.mapInArrow(f, "cluster long, n long, sums array<decimal(38,0)>").groupBy("cluster")
        out = centroids.copy()
        for r in parts.agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).cast("decimal(38,0)").alias(f"s{i}") for i in range(dims)]).collect():
            out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
        return out

    def assigned(self, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
        """vec_id, cluster, distance of every vector; a distance beyond the range of a long counts as its end."""
        dims, scale = self.dims, self.scale

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fit, v = integer_vectors(batch["embedding"], dims, scale)
                if len(v):
                    cluster, distance = nearest(v, centroids, order)
                    yield pa.RecordBatch.from_arrays([batch["vec_id"].filter(pa.array(fit)), pa.array(cluster.astype(np.int32)), pa.array(np.minimum(distance, LONG).astype(np.int64))], ["vec_id", "cluster", "distance"])

        return self.rows.mapInArrow(f, "vec_id long, cluster int, distance long")


def fit_centroids(vectors: Vectors, k: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The centroids after so many rounds, and the order of dimensions. Fewer vectors than k give as many centroids."""
    centroids, order = vectors.initial(k, seed), vectors.order()
    for _ in range(rounds if len(centroids) else 0):
        centroids = vectors.moved(centroids, order)
    return centroids, order


def clusters(table: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every fit vector of (vec_id, embedding), and the final centroids.

    Vectors that are null, of another length, or hold null or non-finite components take no part; rows that share a
    vec_id are vectors each, and a null vec_id is drawn as the empty one. Equal distances go to the smaller number.
    Results are exact for components up to the ends of a long, as which larger ones count. Other columns are not looked
    at; an empty table gives no row and no centroid."""
    vectors = Vectors(table, dims, scale)
    centroids, order = fit_centroids(vectors, k, rounds, seed)
    return vectors.assigned(centroids, order), centroids
