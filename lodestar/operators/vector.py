"""Dense vectors as array columns: validity, normalisation, exact inner-product search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.where(F.col(column).isNotNull() & (F.size(column) > 0))


def dimension_mode(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row (dim, n): the most frequent dimension, the smaller one among equals."""
    return valid(vectors, column).groupBy(F.size(column).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(c: Column) -> Column:
    """The vector divided by its length; the zero vector stays."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def build(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Valid vectors of the most frequent dimension, normalised."""
    mode = dimension_mode(vectors, column).select("dim")
    return valid(vectors, column).join(F.broadcast(mode), F.size(column) == F.col("dim")).drop("dim").withColumn(column, normalised(F.col(column)))


def search(vectors: DataFrame, query: list[float], k: int, column: str = "embedding", positive: bool = True) -> DataFrame:
    """(vec_id, score): the k largest inner products with a query, a scan with a top-k of k rows a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("vec_id", inner_product(F.col(column), q).alias("score"))
    return (scored.where("score > 0") if positive else scored).orderBy(F.desc("score"), "vec_id").limit(k)


def search_like(vectors: DataFrame, vec_id: int, k: int, column: str = "embedding") -> DataFrame:
    """search() with a stored vector as the query, itself apart."""
    query = vectors.where(F.col("vec_id") == vec_id).select(F.col(column).alias("_q")).limit(1)
    scored = vectors.where(F.col("vec_id") != vec_id).join(F.broadcast(query)).select("vec_id", inner_product(F.col(column), F.col("_q")).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)
