"""Fusion of lexical and vector hits: importance boost, quotas, merge, rerank, cut, threshold, explanations.

Hits are rows (path, score, source, match_type, ...). Every order has a total tie-breaker, the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def importance(ranked: DataFrame) -> DataFrame:
    """(path, boost): scores of ranked files, clipped to [0, 1]; the path is the relative one where there is one."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("pagerank_score")))
    return ranked.select(F.coalesce("relative_path", "file_path").alias("path"), score.alias("boost"))


def boosted(hits: DataFrame, boosts: DataFrame) -> DataFrame:
    """score * (1 + boost); files without a boost keep their score. Hits are few, boosts as many as files: an ordinary
    left join, whose smaller side Spark chooses at run time."""
    return hits.join(boosts, "path", "left").withColumn("score", F.col("score") * (1 + F.coalesce("boost", F.lit(0.0)))).drop("boost")


def quotas(lexical_weight: float, vector_weight: float, k: int) -> tuple[int, int]:
    lexical = int(lexical_weight / (lexical_weight + vector_weight) * k)
    return lexical, k - lexical


def take(hits: DataFrame, quota: int) -> DataFrame:
    """The best `quota` hits."""
    return hits.orderBy(F.desc("score"), "path").limit(max(quota, 0))


def take_batch(hits: DataFrame, quota: Column, by: str = "query_id") -> DataFrame:
    """take() for a table of queries, each with its own quota."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "path")
    return hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= quota).drop("_n")


def merged(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """One row per path. A path in both lists averages its scores and becomes hybrid / mixed; other fields stay those of
    the lexical hit. Repeated paths within the lexical list count once."""
    v = vector.groupBy("path").agg(F.max_by(F.struct(*[F.col(c) for c in vector.columns]), "score").alias("v"))
    x = lexical.groupBy("path").agg(F.max_by(F.struct(*[F.col(c) for c in lexical.columns]), "score").alias("x"))
    both = F.col("x").isNotNull() & F.col("v").isNotNull()
    out = x.join(v, "path", "full_outer")
    fields = [c for c in lexical.columns if c not in ("path", "score", "source", "match_type", "explanation")]
    extra = [F.when(both, F.concat_ws("", F.col("x.explanation"), F.lit(" + "), F.col("v.source"), F.lit(" match"))).otherwise(F.coalesce("x.explanation", "v.explanation")).alias("explanation")] if "explanation" in lexical.columns else []
    return out.select(
        "path",
        F.when(both, (F.col("x.score") + F.col("v.score")) / 2).otherwise(F.coalesce("x.score", "v.score")).alias("score"),
        F.when(both, "hybrid").otherwise(F.coalesce("x.source", "v.source")).alias("source"),
        F.when(both, "mixed").otherwise(F.coalesce("x.match_type", "v.match_type")).alias("match_type"),
        *[F.when(F.col("x").isNotNull(), F.col(f"x.{c}")).otherwise(F.col(f"v.{c}")).alias(c) for c in fields],
        *extra,
    )


def combined(lexical: DataFrame, vector: DataFrame, lexical_weight: float, vector_weight: float) -> DataFrame:
    """The alternative fusion: scores divided by the list's largest and weighted; a path in both lists gets its lexical
    score plus half its vector score."""

    def scaled(hits: DataFrame, weight: float) -> DataFrame:
        best = hits.agg(F.max("score").alias("_best"))
        return hits.join(F.broadcast(best)).withColumn("score", F.col("score") / F.col("_best") * weight).drop("_best")  # one row

    a = scaled(lexical, lexical_weight).select("path", F.col("score").alias("a"))
    b = scaled(vector, vector_weight).select("path", F.col("score").alias("b"))
    out = a.join(b, "path", "full_outer")
    source = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "hybrid").when(F.col("a").isNotNull(), "lexical").otherwise("vector")
    return out.select("path", F.when(F.col("a").isNull(), F.col("b")).otherwise(F.col("a") + 0.5 * F.coalesce("b", F.lit(0.0))).alias("score"), source.alias("source"))


def cut(hits: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """The k best, then those of them that reach the threshold (if it is over 0)."""
    top = take(hits, k)
    return top.where(F.col("score") >= threshold) if threshold > 0 else top


def explained(hits: DataFrame) -> DataFrame:
    how = F.when(F.col("match_type") == "exact", "Exact match found in source code").when(F.col("match_type") == "semantic", "Semantic similarity to your query").otherwise("Found through both exact and semantic matching")
    where = F.when(F.col("source") == "lexical", "Matched through lexical search").when(F.col("source") == "vector", "Matched through embedding similarity").when(F.col("source").contains("reranked"), "Reranked for relevance")
    high = F.when(F.col("rank") <= 10, F.concat(F.lit("High importance file (rank #"), F.col("rank").cast("string"), F.lit(")")))
    return hits.withColumn("explanation", F.concat_ws(" • ", how, where, high))


def passage(api_name: Column, title: Column, snippet: Column) -> Column:
    """What a reranker reads."""
    plain = F.concat(title, F.lit(". "), snippet)
    return F.when(F.coalesce(api_name, F.lit("")) != "", F.concat(F.lit("API: "), api_name, F.lit(". "), plain)).otherwise(plain)
