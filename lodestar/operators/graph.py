"""The call graph of a corpus and the importance of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, numbered


def last_by_name(files: DataFrame, order: str = "file_order") -> DataFrame:
    """(api_key, path): of files with the same API name the last one counts. A grouped maximum, combined on the map side."""
    return files.groupBy(F.upper("api_name").alias("api_key")).agg(F.max_by("relative_path", order).alias("path"))


def reference_edges(files: DataFrame, order: str = "file_order") -> DataFrame:
    """(src, dst): distinct calls between files; unresolved calls and self-calls are dropped."""
    calls = files.select(F.col("relative_path").alias("src"), F.explode("api_calls").alias("api_key"))
    return calls.join(last_by_name(files, order), "api_key").where("src <> path").select("src", F.col("path").alias("dst")).distinct()


def reference_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, targets): every node, with the sorted targets of its calls."""
    targets = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))
    return nodes.select(F.col("node").alias("src")).join(targets, "src", "left").select("src", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def in_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, reference_count), 0 for nodes without callers."""
    counts = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("reference_count"))
    return nodes.select("node").join(counts, "node", "left").select("node", F.coalesce("reference_count", F.lit(0).cast("long")).alias("reference_count"))


def ranked(scores: DataFrame, score: str, tie: str = "node", name: str = "rank") -> DataFrame:
    """Rank 1.. by score, ties by `tie`; no task holds all rows."""
    out = numbered(scores, F.desc(score), F.asc(tie), name="_at")
    return out.select(*scores.columns, (F.col("_at") + 1).cast("int").alias(name))


def top_by_calls(files: DataFrame, k: int = 10) -> DataFrame:
    """(file_name, calls) of the k files with the most calls; ties by path. A top-k of k rows a task."""
    calls = files.select("relative_path", "file_name", F.coalesce(F.size("api_calls"), F.lit(0)).alias("calls"))
    return calls.orderBy(F.desc("calls"), "relative_path").limit(k).select("file_name", "calls")


def unlinked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many nodes have no caller, and how many call nothing."""
    no_in = nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti").agg(F.count("*").alias("no_incoming"))
    no_out = nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti").agg(F.count("*").alias("no_outgoing"))
    return no_in.crossJoin(no_out)  # one row each


def _step(nodes: DataFrame, weighted: DataFrame, scores: DataFrame, n: int, damping: float) -> DataFrame:
    flow = weighted.join(scores.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
    return nodes.join(flow, "node", "left").select("node", (F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("flow", F.lit(0.0))).alias("score"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6, cut_every: int = 5, redistribute: bool = False) -> DataFrame:
    """(node, score). The mass of nodes that call nothing is dropped, or with redistribute spread evenly. Edges from or to
    what is no node do not count, not even in an out-degree.

    With a tolerance every step is evaluated (and cached) and the loop ends once the scores move by less than that in sum;
    without one the steps are unrolled. Either way the plan is cut by a written table every few steps, so that a lost
    executor costs a few steps at the most. Edges carry 1 / out-degree, so that a step is one
    join and one aggregation that is combined on the map side."""
    cut_every = 1 if redistribute else cut_every  # a step then reads the scores twice
    nodes = nodes.select("node").distinct()
    n = nodes.count()
    scores = nodes.withColumn("score", F.lit(1.0 / max(n, 1)))
    if not n:
        return scores
    ends = lambda end: nodes.select(F.col("node").alias(end))
    edges = edges.select("src", "dst").join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi")
    out = edges.groupBy("src").agg((F.lit(1.0) / F.count("*")).alias("share"))
    weighted = edges.join(out, "src")
    if tolerance is not None or iterations > cut_every:
        nodes, weighted = materialise(nodes, "nodes"), materialise(weighted, "edges")
    sinks = nodes.join(out.select(F.col("src").alias("node")), "node", "left_anti") if redistribute else None
    for i in range(iterations):
        new = _step(nodes, weighted, scores, n, damping)
        if sinks is not None:
            lost = scores.join(sinks, "node").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
            new = new.crossJoin(lost).select("node", (F.col("score") + F.col("lost") * (damping / n)).alias("score"))
        cut = (i + 1) % cut_every == 0 and i + 1 < iterations
        if tolerance is not None:
            new = materialise(new, "rank") if cut else new.persist()
            moved = new.join(scores.withColumnRenamed("score", "old"), "node").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
            scores.unpersist()
            scores = new
            if moved < tolerance:
                break
        else:
            scores = materialise(new, "rank") if cut else new
    if tolerance is not None:  # nothing stays cached
        cached, scores = scores, materialise(scores, "rank")
        cached.unpersist()
    return scores
